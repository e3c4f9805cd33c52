"""First-wins and last-wins dedupe, clusters, merges, nearest and range joins, and diffs. Each keeps ties in a stated
order; nothing depends on the order of rows in a partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 1 << 16  # rows of a partition among which those of equal keys are kept side by side


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The same by one aggregate, which combines before it shuffles: for keys that may be hot."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_first._row.{c}").alias(c) for c in df.columns])


def clusters(df: DataFrame, key: Column, member: str, label: str) -> DataFrame:
    """(key, representative, members, labels): the smallest member stands for its cluster."""
    return df.groupBy(key.alias("key")).agg(F.min(member).alias("representative"), F.count(F.lit(1)).alias("members"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"))


def merged(df: DataFrame, keys: Sequence[Column], best: Mapping[str, Column], unions: Mapping[str, Column]) -> DataFrame:
    """One row a key: the given aggregates, and sorted distinct unions of values."""
    sets = [F.array_join(F.sort_array(F.collect_set(c.cast("string"))), ",").alias(n) for n, c in unions.items()]
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in best.items()], *sets)


def outer_diff(base: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key with `introduced`, `resolved` or `residual`."""
    b, c = base.select(*keys).distinct().withColumn("_b", F.lit(True)), candidate.select(*keys).distinct().withColumn("_c", F.lit(True))
    state = F.when(F.col("_b").isNull(), "introduced").when(F.col("_c").isNull(), "resolved").otherwise("residual")
    return b.join(c, list(keys), "full_outer").select(*keys, state.alias("state"))


def nearest(points: DataFrame, targets: DataFrame, by: str, at: str, target_id: str) -> DataFrame:
    """Each point with the nearest target of its group, the earlier one on a tie; null without one.

    One sort of the union and two running values find the neighbours, so no pairs are built."""
    t = targets.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.struct(F.col(at).alias("at"), F.col(target_id).alias("id")).alias("_t"), F.lit(None).alias("_p"))
    p = points.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(None).cast(t.schema["_t"].dataType).alias("_t"), F.struct(*points.columns).alias("_p"))
    both = t.withColumn("_p", F.lit(None).cast(p.schema["_p"].dataType)).unionByName(p)
    line = Window.partitionBy("_by").orderBy("_at")
    back = F.max("_t").over(line.rangeBetween(Window.unboundedPreceding, 0))  # the latest; of equal ones the largest id
    ahead = F.min("_t").over(line.rangeBetween(0, Window.unboundedFollowing))
    df = both.withColumns({"_back": back, "_ahead": ahead}).filter("_p is not null")
    gap = lambda c: F.abs(F.col(f"{c}.at").cast("double") - F.col("_at").cast("double"))
    pick = F.when(F.col("_ahead").isNull() | (gap("_back") <= gap("_ahead")), F.col("_back")).otherwise(F.col("_ahead"))
    return df.select("_p.*", pick.alias("_near")).select("*", F.col("_near.at").alias("nearest_at"), F.col("_near.id").alias("nearest_id")).drop("_near")


def _side_by_side(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows of equal keys as arrays `name` of what else they hold; an array spans NEIGHBOURS rows of a partition at most, so that
    hot keys give many arrays and no long one."""
    rest = [c for c in df.columns if c not in keys]
    near = F.floor(F.monotonically_increasing_id() / NEIGHBOURS)
    return df.withColumn("_near", near).groupBy(*keys, "_near").agg(F.collect_list(F.struct(*rest, *([] if rest else [F.lit(0).alias("_none")]))).alias(name)).drop("_near")


def in_spans(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of points and spans of their group with start <= at <= end, by an equal join on (group, bucket): a span is
    listed in each bucket of `width` that it touches. Points of one place and spans of the same ends are compared together,
    and pairs are written out only where they meet."""
    cell = lambda c: F.floor(F.col(c) / width)
    p = _side_by_side(points.filter(F.col(by).isNotNull() & F.col(at).isNotNull()), [by, at], "_p").withColumn("_cell", cell(at))
    s = _side_by_side(spans.filter(F.col(start) <= F.col(end)), [by, start, end], "_s").withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    met = p.join(s, [by, "_cell"]).filter(F.col(at).between(F.col(start), F.col(end)))
    each = met.select(by, at, start, end, "_s", F.inline("_p")).select("*", F.inline("_s"))
    return each.select(by, *[c for c in [*points.columns, *spans.columns] if c != by])


def near_names(names: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b), a < b, of distinct names at edit distance 1, by an equal join on names with one letter left out."""
    n = names.select(F.col(column).alias("name")).filter("name is not null").distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring(F.col("name"), F.lit(1), i - 1), F.substring(F.col("name"), i + 1, F.length("name"))))
    keys = n.select("name", F.explode(F.array_union(F.array("name"), F.when(F.length("name") > 0, cuts).otherwise(F.array().cast("array<string>")))).alias("key"))
    a, b = keys.select(F.col("name").alias("a"), "key"), keys.select(F.col("name").alias("b"), "key")
    return a.join(b, "key").filter("a < b").select("a", "b").distinct().filter(F.levenshtein("a", "b") == 1)


def by_precedence(events: DataFrame, key: str, verdict: str, precedence: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the strongest verdict and the sorted list of all, for a left join to what they are about."""
    rank = F.array_position(F.array(*[F.lit(p) for p in precedence]), F.col(verdict))
    best = F.min_by(verdict, F.when(rank > 0, rank)).alias("decision")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(verdict).alias("_v")))), lambda x: x["_v"]), ",")
    return events.groupBy(key).agg(best, listed.alias("verdicts"), F.count(F.lit(1)).alias("n_events"))


def zero_filled(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Counts of a closed domain, zeros included."""
    names = df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def union_first_wins(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of several sources; a key belongs to the earliest source that has it."""
    both = None
    for i, f in enumerate(frames):
        f = f.withColumn("_source", F.lit(i))
        both = f if both is None else both.unionByName(f)
    return first_by(both, keys, ["_source", *order]).drop("_source")


def evicted(entries: DataFrame, limit: int, keep: float, order: Sequence[Column]) -> DataFrame:
    """The entries that stay: all up to `limit`, else `keep` of it, by the given order of worth."""
    total = entries.count()
    return entries if total <= limit else entries.orderBy(*order).limit(int(limit * keep))


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """State rows (key, seen, first_at, last_at, validated) after new sightings (key, at, validated): counts add up, a
    validation stays."""
    add = new.select(key, F.lit(1).cast("long").alias("seen"), F.col("at").alias("first_at"), F.col("at").alias("last_at"), "validated")
    return state.unionByName(add).groupBy(key).agg(F.sum("seen").alias("seen"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("validated").alias("validated"))


def where(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on columns with long definitions. The flag comes out of a generator, so the filter
    stays above it and those definitions aren't put in again for each mention."""
    return df.select("*", F.explode(F.array(condition)).alias("_met")).filter("_met").drop("_met")
