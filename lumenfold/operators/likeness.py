"""Joins of rows that are alike: TF-IDF vectors by cosine, sets by Jaccard, scopes that overlap and share a name, frontiers of
calls, and rows left over by a diff.

No join builds the pairs of a group. Terms are put in a global order, rare ones first; what two rows share first in that
order must lie in the beginnings of both, where the beginning of a row ends as soon as the rest can't reach the threshold
alone. Equal rows are one class while candidates are searched. Nulls: a null text has no terms and is like nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import predicates
from lumenfold.sources.tables import cut_lineage

# Fixed values.
NOISE = ("is", "not", "in", "true", "false", "none", "null", "and", "or", "the", "len", "type", "isinstance")
WORD = r"\w\w+"
NAME = r"\b[a-z_][a-z0-9_]*\b"
STEPS = (0.8, 0.4, 0.2, 0.1)  # thresholds at which a top-k search looks, before it goes down to the least score asked for
SHORT = 32  # items of a set that goes along to where it meets others
BAND = 8  # lines of a band in which overlapping scopes meet
NEIGHBOURS = 1 << 16  # rows of a partition among which like scopes are kept side by side


def grams(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """The words of two characters or more of a lower-cased text without stop words, and their neighbouring pairs."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*stop_words) if stop_words else F.lit(True))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def classes(df: DataFrame, key: str, terms: Column) -> tuple[DataFrame, DataFrame]:
    """(members (class, key), kinds (class, terms, n)): rows with equal terms are one class, named by their digest."""
    rows = cut_lineage(df.select(F.col(key).alias("key"), terms.alias("terms")).filter(F.size("terms") > 0).withColumn("class", F.sha2(F.concat_ws("\x1f", F.array_sort("terms")), 256)))
    kinds = rows.groupBy("class").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n"))
    return rows.select("class", "key"), cut_lineage(kinds)


def weighted(kinds: DataFrame) -> DataFrame:
    """(class, term, weight, rank): counts times smoothed inverse document frequency, at unit length. Frequencies count every
    row; rank orders a class's terms by the global order."""
    rows = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = kinds.select("class", "n", F.explode("terms").alias("term")).groupBy("class", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = cut_lineage(counts)
    seen = counts.groupBy("term").agg(F.sum("n").alias("df"))
    raw = counts.join(seen, "term").withColumn("raw", F.col("tf") * (F.log((1 + F.lit(rows)) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy("class").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    order = Window.partitionBy("class").orderBy("df", "term")
    return raw.join(norms, "class").select("class", "term", (F.col("raw") / F.col("norm")).alias("weight"), F.row_number().over(order).alias("rank"))


def cosines(vectors: DataFrame, least: float, asking: DataFrame | None = None) -> DataFrame:
    """(a, b, score) of different classes with a cosine of `least` or more; both ways where `asking` (class) is None, else from
    these classes to all. Candidates share a term in the beginnings of both; at the first one that they share, its product and
    the lengths of what comes after bound the score from above. Scores are rounded to six digits."""
    line = Window.partitionBy("class").orderBy("rank")
    square = F.col("weight") * F.col("weight")
    rest = F.coalesce(F.sum(square).over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    # A term is in the beginning if it and what follows can reach the threshold; the margin is for rounding.
    parts = cut_lineage(vectors.withColumn("rest", rest).filter(F.sqrt(F.col("rest") + square) >= least - 1e-6))
    x = parts.select(F.col("class").alias("a"), "term", F.col("weight").alias("wa"), F.col("rest").alias("ra"))
    if asking is not None:
        x = x.join(asking.select(F.col("class").alias("a")), "a", "left_semi")
    y = parts.select(F.col("class").alias("b"), "term", F.col("weight").alias("wb"), F.col("rest").alias("rb"))
    met = x.join(y, "term").filter((F.col("a") < F.col("b")) if asking is None else (F.col("a") != F.col("b")))
    # The bound holds at the first shared term; at a later one it may reject the pair, which the first has kept.
    met = cut_lineage(met.filter(F.col("wa") * F.col("wb") + F.sqrt(F.col("ra") * F.col("rb")) >= least - 1e-6).select("a", "b").distinct())
    whole = vectors.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("vector"))
    p, q = whole.toDF("a", "va"), whole.toDF("b", "vb")
    product = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    scored = met.join(p, "a").join(q, "b").select("a", "b", F.round(product, 6).alias("score")).filter(F.col("score") >= least)
    return scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")) if asking is None else scored


def most_alike(df: DataFrame, key: str, text: str, k: int, least: float, stop_words: Sequence[str] = ()) -> DataFrame:
    """(a, b, rank, score): the k rows most like each row by TF-IDF cosine, ties to the smaller key.

    The search starts at a high threshold; rows that have found k others are done, and the rest looks again at the next lower
    one. Rows of one class come to it as its first k + 1 keys, as no row needs more of them."""
    members, kinds = classes(df, key, grams(F.col(text), stop_words))
    vectors = cut_lineage(weighted(kinds))
    nth = F.row_number().over(Window.partitionBy("class").orderBy("key"))
    firsts = cut_lineage(members.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("class", "key"))
    held = firsts.groupBy("class").agg(F.count(F.lit(1)).alias("held"))  # k + 1 at most
    done, asking = None, kinds.select("class")
    for step in [*[s for s in STEPS if s > least], least]:
        found = cut_lineage(cosines(vectors, step, asking))
        if step > least:
            total = found.join(held.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("held").alias("others"))
            full = asking.join(held, "class").join(total, F.col("class") == F.col("a"), "left").filter(F.col("held") - 1 + F.coalesce("others", F.lit(0)) >= k).select("class")
            found = found.join(full, F.col("a") == F.col("class"), "left_semi")
            asking = cut_lineage(asking.join(full, "class", "left_anti"))
        done = found if done is None else done.unionByName(found)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    near = done.join(firsts.withColumnRenamed("class", "b"), "b").select("a", F.col("key").alias("b"), "score").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    own = firsts.select(F.col("class").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("score"))
    pairs = members.join(near.unionByName(own), members["class"] == F.col("a")).filter(F.col("key") != F.col("b")).select(F.col("key").alias("a"), "b", "score")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("a", "b", "rank", "score")


def alike_sets(df: DataFrame, key: str, items: str, least: float, scope: Sequence[str] = ()) -> DataFrame:
    """(a, b, score), a < b, of rows of one scope whose sets have a Jaccard similarity of `least` or more. A set's beginning
    is as long as two sets that similar must share something in; sets of too different sizes don't meet."""
    rows = cut_lineage(df.select(*scope, F.col(key).alias("key"), F.array_distinct(items).alias("items")).filter(F.size("items") > 0))
    each = rows.select(*scope, "key", F.size("items").alias("n"), F.explode("items").alias("item"))
    rare = each.groupBy(*scope, "item").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(*scope, "key").orderBy("df", "item")
    begin = each.join(rare, [*scope, "item"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    begin = cut_lineage(begin.join(rows.filter(F.size("items") <= SHORT), [*scope, "key"], "left").select(*scope, "key", "n", "item", "rank", "items"))
    x, y = begin.toDF(*scope, "a", "na", "item", "pa", "ia"), begin.toDF(*scope, "b", "nb", "item", "pb", "ib")
    both = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1  # the most that they share from here on
    fit = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & (both >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - F.least("pa", "pb") + 1 - 1e-9)
    shared = F.size(F.array_intersect("ia", "ib"))
    score = shared / (F.size("ia") + F.size("ib") - shared)
    # Two short sets are compared where they meet, so no candidates are stored; those of a long one are, each once.
    short = x.filter(F.col("na") <= SHORT).join(y.filter(F.col("nb") <= SHORT), [*scope, "item"]).filter((F.col("a") < F.col("b")) & fit & (score >= least)).select(*scope, "a", "b", score.alias("score")).distinct()
    some = lambda side, n: side.filter(F.col(n) > SHORT * least - 1).drop("ia", "ib")  # noqa: E731  (of a size to meet a long one)
    met = some(x, "na").join(some(y, "nb"), [*scope, "item"]).filter((F.col("a") < F.col("b")) & fit & (F.greatest("na", "nb") > SHORT)).select(*scope, "a", "b").distinct()
    p, q = rows.toDF(*scope, "a", "ia"), rows.toDF(*scope, "b", "ib")
    long = met.join(p, [*scope, "a"]).join(q, [*scope, "b"]).withColumn("score", score).filter(F.col("score") >= least).select(*scope, "a", "b", "score")
    return short.unionByName(long)


def roots(names: Column, expression: Column) -> Column:
    """What a statement is about: the first parts of its names, or where it has none the names in its text but for noise."""
    of_names = F.transform(names, lambda v: F.substring_index(F.lower(v), ".", 1))
    of_text = F.filter(F.regexp_extract_all(F.lower(F.coalesce(expression, F.lit(""))), F.lit(NAME), F.lit(0)), lambda w: ~w.isin(*NOISE))
    return F.array_distinct(F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, of_names).otherwise(of_text))


def _ordered(rows: DataFrame, unit: str) -> DataFrame:
    """`rows` with `roots` sorted rare ones first, by how many rows of the unit have them."""
    each = rows.select(unit, "id", F.explode("roots").alias("root"))
    seen = each.groupBy(unit, "root").agg(F.count(F.lit(1)).alias("_n"))
    ranked = each.join(seen, [unit, "root"]).groupBy(unit, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "root"))), lambda x: x["root"]).alias("roots"))  # one row's own names
    return rows.drop("roots").join(ranked, [unit, "id"])


def overlapping(rows: DataFrame, unit: str = "file") -> DataFrame:
    """(unit, a, b, shared), a < b: rows (unit, id, lo, hi, roots) whose lines overlap and that share a root. Of two that overlap,
    the later one begins on a line of the other. Rows of the same roots and lines meet together, by unit, root and band of
    lines, and count once: at the rarest root that both have, in the band where the later ones begin. Pairs are written out
    only where they meet. Without lines (null) a row overlaps nothing."""
    known = _ordered(rows.select(unit, "id", "lo", "hi", "roots").filter("lo <= hi"), unit)
    r = cut_lineage(known.repartition(unit, "roots", "lo").sortWithinPartitions(unit, "roots", "lo", "hi"))
    r = r.withColumn("near", F.floor(F.monotonically_increasing_id() / NEIGHBOURS))  # like rows are neighbours; hot ones give many arrays
    band = lambda c: F.floor(F.col(c) / BAND)
    x = r.groupBy(unit, "roots", "lo", "hi", "near").agg(F.collect_list("id").alias("x")).withColumn("root", F.explode("roots")).withColumn("band", F.explode(F.sequence(band("lo"), band("hi"))))
    y = r.groupBy(unit, "roots", "lo", "near").agg(F.collect_list("id").alias("y")).withColumn("root", F.explode("roots")).withColumn("band", band("lo"))
    x, y = x.select(unit, "root", "band", F.col("roots").alias("rx"), "lo", "hi", "x"), y.select(unit, "root", "band", F.col("roots").alias("ry"), F.col("lo").alias("at"), "y")
    met = x.join(y, [unit, "root", "band"]).filter(F.col("at").between(F.col("lo"), F.col("hi")))
    both = F.when(F.least(F.size("rx"), F.size("ry")) == 1, F.array("root")).otherwise(F.array_intersect("rx", "ry"))
    met = met.select("*", F.explode(F.array(both)).alias("both")).filter(F.get("both", 0) == F.col("root"))
    each = met.select(unit, F.array_sort("both").alias("shared"), (F.col("lo") < F.col("at")).alias("later"), "y", F.explode("x").alias("i")).select("*", F.explode("y").alias("j"))
    each = each.filter((F.col("i") < F.col("j")) | (F.col("later") & (F.col("i") > F.col("j"))))
    return each.select(unit, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "shared")


def frontier_conflicts(frontiers: DataFrame, facts: DataFrame) -> DataFrame:
    """(caller, callee, a, b): facts (function, id, predicate, roots) of a caller and of what it calls that share a root and of
    which one denies the other. Facts meet by function and root, once for each pair; predicates that can't be read deny none."""
    known = cut_lineage(_ordered(facts.select("function", "id", "predicate", "roots"), "function").withColumns({"says": predicates.plain(F.col("predicate")), "denies": predicates.negated(F.col("predicate"))}))
    e = known.select("function", "id", "roots", "says", "denies", F.explode("roots").alias("root"))
    x = frontiers.select("caller", "callee").distinct().join(e.toDF("caller", "a", "ra", "sa", "da", "root"), "caller")
    met = x.join(e.toDF("callee", "b", "rb", "sb", "db", "root"), ["callee", "root"])
    first = F.get(F.array_intersect("ra", "rb"), 0) == F.col("root")
    return met.filter(first & (F.col("a") != F.col("b")) & ((F.col("da") == F.col("sb")) | (F.col("db") == F.col("sa")))).select("caller", "callee", "a", "b")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`df` with the place of each row among those of its key, from 1, for keys that may be hot: rows are range-sorted by key
    and order, numbered inside each partition, and moved on by what the partitions before hold of the key."""
    parts = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    here = parts.withColumn("_here", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    sizes = parts.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))  # a row a key and partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_n")
    same = here["_part"] == sizes["_part"]
    for k in keys:
        same &= here[k].eqNullSafe(sizes[k])
    return here.join(sizes, same).select(*[here[c] for c in df.columns], (F.col("_here") + F.col("_before")).alias(name))


def shifted(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str], identity: str, order: Sequence[str]) -> DataFrame:
    """(keys, baseline, candidate, state): what an exact diff left over, matched one to one by a key of likeness. Each baseline
    row, in order, takes the first candidate of its key that is still free; as keys are equal, that is the one in its own
    place. Candidates with one identity count once. State is `shifted`, `resolved` (no candidate left) or `introduced`."""
    mine = numbered(baseline.select(*keys, identity, *[c for c in order if c != identity]), keys, order, "_nth")
    theirs = numbered(candidate.select(*keys, identity, *[c for c in order if c != identity]).dropDuplicates([*keys, identity]), keys, order, "_nth")
    x = mine.select(*[F.col(k).alias(f"_x_{k}") for k in keys], F.col(identity).alias("baseline"), F.col("_nth").alias("_x"))
    y = theirs.select(*[F.col(k).alias(f"_y_{k}") for k in keys], F.col(identity).alias("candidate"), F.col("_nth").alias("_y"))
    same = F.col("_x") == F.col("_y")
    for k in keys:
        same &= F.col(f"_x_{k}").eqNullSafe(F.col(f"_y_{k}"))
    state = F.when(F.col("_y").isNull(), "resolved").when(F.col("_x").isNull(), "introduced").otherwise("shifted")
    both = x.join(y, same, "full_outer").withColumn("state", state)
    return both.select(*[F.when(F.col("_x").isNotNull(), F.col(f"_x_{k}")).otherwise(F.col(f"_y_{k}")).alias(k) for k in keys], "baseline", "candidate", "state")
