"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down the tree domain - language - source. At every node it is split among the children by weight;
a child that can't use its share (its whole subtree repeated `max_epochs` times) gets what it can use, and the shortage
goes to its siblings, and only what all siblings together can't use was never given to their parent: so shortages move
among siblings before they move among ancestors. Each leaf then takes whole epochs and a token prefix of one more, in an
order seeded by leaf epoch; the document at the end is cut.

Every number is an integer, so results don't depend on how rows are dealt out. The prefix is found by descending a radix
of the order key, 256 buckets at a time until BUCKET rows are left, so a leaf with a third of all rows is never sorted and never meets in a task.

Nulls: a null text has no tokens, and documents without tokens are never taken; null languages and sources count as ''.
A null doc_id is ordered as an empty one. Empty tables give empty results. Rows that repeat a doc_id in a leaf are taken
or left together, and share a cut evenly, rounded down. Extra columns are ignored by `selected` and kept by
`mix_documents`. JVM expressions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import words, written

LEAF = ("domain", "lang", "source")
BUCKET = 10_000  # rows of a leaf's last bucket that may be sorted in one task; the descent goes on until there are no more


@dataclass(frozen=True)
class Plan:
    """Weights by name (whole numbers; `other` for names without one; 0 leaves a name out), the budget in percent of all
    tokens, and seeds. `domain` names the column that holds the domain; without one, `domain_of` the source stands in."""

    domains: dict[str, int] = field(default_factory=lambda: {"domain0": 40, "domain1": 30, "domain2": 20, "domain3": 10})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 10
    percent: int = 100
    max_epochs: int = 2
    seed: int = 42
    domain: str | None = None


def domain_of(source: Column) -> Column:
    """The tables have no domain; a source's number, modulo four, stands for it (0 where it has none)."""
    number = F.substring(F.regexp_extract(source, r"([0-9]+)$", 1), -9, 9)
    return F.concat(F.lit("domain"), (F.coalesce(F.try_to_number(F.when(number != "", number), F.lit("999999999")).cast("long"), F.lit(0)) % 4).cast("string"))


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def _leaf_columns(plan: Plan) -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    domain = domain_of(source) if plan.domain is None else F.coalesce(F.col(plan.domain).cast("string"), F.lit(""))
    return [domain.alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), source.alias("source")]


def share_out(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """`given` for each node of (group, name, weight, cap, budget): the budget of a group by weight, no node over its cap."""
    by = Window.partitionBy(*group)
    # The order of cap / weight in whole numbers: the quotient, then the rest, whose share of the weight is below one. A
    # weight of 0 has a cap of 0, so such nodes come first, are full and get nothing.
    one = F.greatest("weight", F.lit(1))
    up = by.orderBy(F.expr("cap div greatest(weight, 1)"), (F.col("cap") % one) / one, name).rowsBetween(Window.unboundedPreceding, -1)
    df = nodes.withColumns({"cap_before": F.coalesce(F.sum("cap").over(up), F.lit(0)), "weight_from": F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(up), F.lit(0))})
    df = df.withColumn("full", F.col("cap") * F.col("weight_from") <= (F.col("budget") - F.col("cap_before")) * F.col("weight"))
    open_weight = F.when(~F.col("full"), F.col("weight")).otherwise(0)
    df = df.withColumns({"left": F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by), "open_weight": F.sum(open_weight).over(by)})
    df = df.withColumn("base", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * weight) div nullif(open_weight, 0)")))
    df = df.withColumns({"odd": F.col("left") - F.sum(F.when(~F.col("full"), F.col("base")).otherwise(0)).over(by), "place": F.row_number().over(by.orderBy("full", name))})
    return df.withColumn("given", F.col("base") + F.when(~F.col("full") & (F.col("place") <= F.col("odd")), 1).otherwise(0)).drop("cap_before", "weight_from", "full", "left", "open_weight", "base", "odd", "place", "budget")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens, given) from leaf sizes (domain, lang, source, tokens)."""
    leaves = leaves.filter("tokens > 0").withColumn("weight", _weight(F.col("source"), plan.sources, plan.other))
    leaves = leaves.withColumn("cap", F.when(F.col("weight") > 0, F.col("tokens") * plan.max_epochs).otherwise(0))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(F.col("lang"), plan.languages, plan.other))
    langs = langs.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(F.col("domain"), plan.domains, plan.other))
    domains = domains.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    # The root's children, one row a domain, are the only rows that meet in one task.
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    domains = domains.withColumns({"root": F.lit(0), "total": total}).withColumn("budget", F.expr(f"total * {plan.percent} div 100"))
    domains = share_out(domains, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    langs = share_out(langs.drop("tokens").join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("given").alias("budget"))
    return share_out(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", "given")


def order_key(doc_id: Column, epoch: Column, plan: Plan) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def ends(docs: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Per leaf (domain, lang, source, epochs, end_key, end_take): whole epochs, then the documents of one more with a
    smaller key and `end_take` tokens of the one at `end_key`; and the thin rows (doc_id, leaf, tokens)."""
    spark = docs.sparkSession
    thin = written(docs.select("doc_id", *_leaf_columns(plan), F.size(words(F.col("text"))).cast("long").alias("n")), spark)
    leaves = leaf_budgets(thin.groupBy(*LEAF).agg(F.sum("n").alias("tokens")), plan)
    leaves = written(leaves.select(*LEAF, F.expr("given div tokens").alias("epochs"), F.expr("given % tokens").alias("rest")), spark)
    keyed = written(thin.join(leaves, list(LEAF)).filter("rest > 0").select(*LEAF, order_key(F.col("doc_id"), F.col("epochs"), plan).alias("key"), "n"), spark)
    before, depth, most = leaves.filter("rest > 0").select(*LEAF, "rest", F.lit("").alias("prefix")), 0, None
    while depth < 32 and (most is None or most > BUCKET):  # two more hexadecimal digits each time
        at = keyed.join(before, list(LEAF)).filter(F.col("key").startswith(F.col("prefix")))
        sums = at.groupBy(*LEAF, "rest", F.substring("key", 1, depth + 2).alias("prefix")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        run = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("prefix"))
        before = written(sums.withColumn("run", run).filter("run >= rest and run - n < rest").select(*LEAF, (F.col("rest") - F.col("run") + F.col("n")).alias("rest"), "prefix", "rows"), spark)
        most, before, depth = before.agg(F.max("rows")).first()[0] or 0, before.drop("rows"), depth + 2
    at = keyed.join(before, list(LEAF)).filter(F.col("key").startswith(F.col("prefix")))
    at = at.groupBy(*LEAF, "rest", "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    run = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("key"))
    last = at.withColumn("run", run).filter("run >= rest and run - n < rest")
    last = last.select(*LEAF, F.col("key").alias("end_key"), F.expr("(rest - run + n) div rows").alias("end_take"))
    # As a table its size is known: a row a leaf is small enough to be sent to the documents, and where it isn't, the
    # planner sees that and joins by shuffles.
    return written(leaves.join(last, list(LEAF), "left").select(*LEAF, "epochs", "end_key", "end_take"), spark), thin


def _epochs(df: DataFrame, plan: Plan) -> DataFrame:
    """Adds `epoch` and `cut` (null: the whole document) to rows that hold their leaf's end, a row for each epoch taken."""
    key = order_key(F.col("doc_id"), F.col("epochs"), plan)
    whole = F.when(F.col("epochs") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1), lambda e: F.struct(e.cast("int").alias("epoch"), F.lit(None).cast("long").alias("cut"))))
    more = F.when(key < F.col("end_key"), F.array(F.struct(F.col("epochs").cast("int").alias("epoch"), F.lit(None).cast("long").alias("cut"))))
    more = F.when(key == F.col("end_key"), F.array(F.struct(F.col("epochs").cast("int").alias("epoch"), F.col("end_take").alias("cut")))).otherwise(more)
    none = F.array().cast("array<struct<epoch:int,cut:bigint>>")
    return df.withColumn("_taken", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(more, none))))


def selected(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, tokens, take): what the mixture takes of every document in every epoch."""
    plan = plan or Plan()
    end, thin = ends(docs, plan)
    rows = _epochs(thin.filter("n > 0").join(end, list(LEAF)), plan)
    rows = rows.select("doc_id", F.col("_taken.epoch").alias("epoch"), *LEAF, F.col("n").alias("tokens"), F.least("n", F.coalesce("_taken.cut", "n")).alias("take"))
    return rows.filter("take > 0")


def mix_documents(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The mixture itself: columns as they come, a row for each epoch that takes the document, the last one of a leaf
    cut after its last token. The text isn't shuffled; a leaf's end, one row a leaf, is joined to it."""
    plan = plan or Plan()
    end, _ = ends(docs, plan)
    end = end.select(*[F.col(c).alias(f"_{c}") for c in LEAF], F.col("epochs").alias("_epochs"), F.col("end_key").alias("_end_key"), F.col("end_take").alias("_end_take"))
    has_word = F.coalesce(docs["text"], F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    df = docs.filter(has_word).select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("doc_id"), *_leaf_columns(plan))
    df = df.join(end, [F.col(c) == F.col(f"_{c}") for c in LEAF]).select("_row", "doc_id", F.col("_epochs").alias("epochs"), F.col("_end_key").alias("end_key"), F.col("_end_take").alias("end_take"))
    df = _epochs(df, plan).select("_row", F.col("_taken.cut").alias("_cut")).filter("_cut is null or _cut > 0")
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){0,"), F.col("_cut").cast("string"), F.lit("}+"))
    text = F.when(F.col("_cut").isNull(), F.col("_row.text")).otherwise(F.call_function("regexp_extract", F.col("_row.text"), pattern, F.lit(0)))
    df = df.select("_row", "_cut", text.alias("_text"))
    n = lambda c: F.when(F.col("_cut").isNull(), F.col("_row")[c]).otherwise(F.length("_text").cast(docs.schema[c].dataType))
    return df.select(*[(F.col("_text") if c == "text" else n(c) if c == "n_chars" else F.col("_row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _levels() -> str:
    """The budget at each level, in DuckDB's SQL; integer arithmetic as in `share_out`."""
    plan = Plan()

    def weight(name: str, weights: dict[str, int]) -> str:
        return f"CASE {' '.join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items())} ELSE {plan.other} END" if weights else str(plan.other)

    def level(table: str, nodes: str, group: str, name: str) -> str:
        return f"""
{table}_a AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {group} ORDER BY cap // greatest(weight, 1), (cap % greatest(weight, 1)) / greatest(weight, 1), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (PARTITION BY {group}) - coalesce(sum(weight) OVER (PARTITION BY {group} ORDER BY cap // greatest(weight, 1), (cap % greatest(weight, 1)) / greatest(weight, 1), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_from FROM ({nodes})),
{table}_b AS (SELECT *, cap * weight_from <= (budget - cap_before) * weight AS full_ FROM {table}_a),
{table}_c AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {group}) AS left_, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (PARTITION BY {group}) AS open_ FROM {table}_b),
{table}_d AS (SELECT *, CASE WHEN full_ THEN cap ELSE (left_ * weight) // nullif(open_, 0) END AS base FROM {table}_c),
{table}_e AS (SELECT *, left_ - sum(CASE WHEN full_ THEN 0 ELSE base END) OVER (PARTITION BY {group}) AS odd, row_number() OVER (PARTITION BY {group} ORDER BY full_, {name}) AS place FROM {table}_d),
{table} AS (SELECT *, base + CASE WHEN NOT full_ AND place <= odd THEN 1 ELSE 0 END AS given FROM {table}_e)"""

    return ",".join(
        [
            level("doms", f"SELECT domain, sum(cap) AS cap, {weight('domain', plan.domains)} AS weight, (SELECT sum(tokens) * {plan.percent} // 100 FROM leaves) AS budget FROM leaves GROUP BY domain", "1", "domain"),
            level("lans", f"SELECT l.domain, l.lang, sum(l.cap) AS cap, {weight('l.lang', plan.languages)} AS weight, any_value(d.given) AS budget FROM leaves l JOIN doms d USING (domain) GROUP BY l.domain, l.lang", "domain", "lang"),
            level("srcs", f"SELECT l.domain, l.lang, l.source, l.tokens, l.cap, {weight('l.source', plan.sources)} AS weight, n.given AS budget FROM leaves l JOIN lans n USING (domain, lang)", "domain, lang", "source"),
        ]
    )


def oracle_sql() -> str:
    plan = Plan()
    return f"""
WITH thin AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9), '') AS BIGINT), 0) % 4)::VARCHAR AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n)::HUGEINT AS tokens, sum(n)::HUGEINT * {plan.max_epochs} AS cap FROM thin GROUP BY ALL HAVING sum(n) > 0),
{_levels().lstrip()},
ends AS (SELECT domain, lang, source, given // tokens AS epochs, given % tokens AS rest FROM srcs),
keyed AS (SELECT t.*, e.epochs, e.rest, md5('{plan.seed}:' || e.epochs::VARCHAR || ':' || coalesce(t.doc_id::VARCHAR, '')) AS key FROM thin t JOIN ends e USING (domain, lang, source) WHERE t.n > 0),
runs AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) - n AS before FROM keyed),
taken AS (
  SELECT doc_id, domain, lang, source, n, unnest(range(0, epochs::BIGINT)) AS epoch, n AS take FROM runs
  UNION ALL
  SELECT doc_id, domain, lang, source, n, epochs::BIGINT AS epoch, least(n, rest - before)::BIGINT AS take FROM runs WHERE before < rest)
SELECT doc_id, epoch::INTEGER AS epoch, domain, lang, source, n::BIGINT AS tokens, take::BIGINT AS take FROM taken WHERE take > 0
"""
