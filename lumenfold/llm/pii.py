"""Personal data: base patterns, and contextual extraction that is bootstrapped from them.

Bootstrapping: base matches (seeds) and looser identifier shapes (candidates) are instances; the words beside an instance
are its lexical patterns. On the graph of patterns and instances Spark scores in rounds: a pattern is as good for a kind
as the share of its instances' scores among all instances that stand in it, an instance as good as a noisy-or of its
patterns. Candidates in patterns of high confidence become spans and count as seeds of further patterns, until nothing
new is accepted. General contexts hold every kind of seed and stay weak.

Nulls: a null text is an empty text; a null doc_id stays null. Empty tables give empty results; each repeated row gets
its row. Extra columns are ignored. Spans are code points, end exclusive. JVM expressions only, and the text is never
shuffled: what leaves the scan is spans and a few words beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import MATCHES, SPAN_TYPE, bound, of_kind, regex_spans, span_list, written

KINDS = ("email", "ip", "card", "phone")
# A match can only begin where a run of its first class begins, or where the last match ended (\G); saying so spares
# long runs a start at each character. Possessive counts never change these matches, as the classes that follow differ.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes of the same kinds: spelled-out or defanged addresses, numbers that fail the base tests. Groups without a
#: bound are possessive: the JVM matches others by recursion, and a text with thousands of parts would exhaust its stack.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++)++|\x20?[\[({]?(?:(?i)at|@)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?[\[({]?(?:\.|(?i)dot)[\])}]?\x20?[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9+])[0-9](?:[\x20./-]?[0-9]){11,19}(?![0-9])",
    "phone": r"(?<![0-9+.])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){2,5}(?![0-9.])",
}
LOOSE_MARKS = {"email": r"(?i)[\[({]?(?:at|@)[\])}]|\x20at\x20[a-z0-9-]++\x20dot\x20", "ip": r"[0-9](?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]", "card": r"[0-9](?:[\x20./-]?[0-9]){11}", "phone": r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}"}
ROUNDS = 3
MIN_SEEDS = 5  # distinct seeds that a pattern needs
MIN_SCORE = 0.8
CHUNK = 4096  # characters of a chunk of a text
CONTEXT = 48  # characters beside an instance that its patterns are made of; equal neighbours give equal patterns


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit test."""
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def base_spans(text: Column) -> Column:
    """All base matches that pass their tests."""
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    n = lambda s: F.length(_digits(s["value"]))
    tests = {
        "email": None,
        "ip": lambda s: s["value"].rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": lambda s: F.when(n(s).between(14, 19), luhn(_digits(s["value"]))).otherwise(F.lit(False)),
        "phone": lambda s: n(s).between(10, 15),
    }
    found = []
    for i, kind in enumerate(KINDS):
        spans = regex_spans(text, BASE[kind], kind, i)
        found.append(F.filter(spans, tests[kind]) if tests[kind] else spans)
    return F.concat(*found)


def loose_spans(text: Column) -> Column:
    return F.concat(*[F.when(text.rlike(LOOSE_MARKS[k]), regex_spans(text, LOOSE[k], k, i)).otherwise(F.array().cast(SPAN_TYPE)) for i, k in enumerate(KINDS)])


def contexts(chunks: Column, span: Column) -> Column:
    """The lexical patterns beside one span: two words before, one before, and one on either side."""
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    cut = lambda at, n: F.substring(F.get(chunks, F.floor(at / CHUNK).cast("int")), at % CHUNK + 1, n)
    left, right = cut(first, span["start"] - first), cut(span["end"], F.lit(CONTEXT))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[0-9]+", "0")
    one = plain(F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    two = plain(F.regexp_extract(left, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$", 1))
    after = plain(F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    return F.array(F.concat(F.lit("b\x1f"), two, F.lit("\x1f"), one), F.concat(F.lit("l\x1f"), one), F.concat(F.lit("c\x1f"), one, F.lit("\x1f"), after))


def beside(text: Column, spans: Column) -> Column:
    """Each span with its patterns. A substring is counted from a text's start, so that of a long text with many spans is
    cut into chunks first, each of which holds CONTEXT characters of the next one."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK + CONTEXT)))
    found = bound(chunks, lambda c: F.transform(spans, lambda s: F.struct(s.alias("span"), contexts(c, s).alias("patterns"))))
    return F.when(F.size(spans) > 0, found).otherwise(F.array().cast(f"array<struct<span:{SPAN_TYPE[6:-1]},patterns:array<string>>>"))


def apart(loose: Column, base: Column) -> Column:
    """The loose spans that meet no base span. Base spans are looked through in blocks of MATCHES by their ends."""
    ordered = F.array_sort(base)
    meets = lambda c, b: (c["start"] < b["end"]) & (b["start"] < c["end"])
    parts = lambda o: F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / MATCHES).cast("int")), lambda i: F.slice(o, i * MATCHES + 1, F.lit(MATCHES)))
    block = lambda p: F.struct(F.get(p, 0)["start"].alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("all"))
    free = lambda blocks: F.filter(loose, lambda c: ~F.exists(blocks, lambda b: F.when(meets(c, b), F.exists(b["all"], lambda x: meets(c, x))).otherwise(F.lit(False))))
    return F.when((F.size(loose) == 0) | (F.size(base) == 0), loose).otherwise(bound(bound(ordered, lambda o: F.transform(parts(o), block)), free))


def scored(edges: DataFrame) -> DataFrame:
    """(kind, value, score) of candidates, from edges (pattern, kind, value, seed)."""
    spark = edges.sparkSession
    edges = edges.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    # Only patterns that hold a candidate can say anything.
    asked = edges.filter(~F.col("seed")).select("pattern").distinct()
    edges = written(edges.join(asked, "pattern", "left_semi"), spark)
    total = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all_instances")), spark)
    scores = edges.filter(~F.col("seed")).select("kind", "value").distinct().withColumn("score", F.lit(0.0))
    accepted, n = scores.filter("false").select("kind", "value", F.lit(True).alias("taken")), 0
    while True:
        held = written(edges.join(accepted, ["kind", "value"], "left").withColumn("taken", F.col("seed") | F.coalesce("taken", F.lit(False))), spark)
        for _ in range(ROUNDS):
            known = held.join(scores, ["kind", "value"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
            good = known.groupBy("pattern", "kind").agg(F.sum("score").alias("got"), F.count_if("taken").alias("seeds")).filter(F.col("seeds") >= MIN_SEEDS)
            good = good.join(total, "pattern").select("pattern", "kind", (F.col("got") / F.col("all_instances")).alias("p"))
            miss = F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))
            scores = written(held.filter(~F.col("seed")).join(good, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(miss))).alias("score")), spark)
        # Seeds only become more, and with them the scores: what was accepted stays so.
        accepted = scores.filter(F.col("score") >= MIN_SCORE).select("kind", "value", F.lit(True).alias("taken"))
        was, n = n, accepted.count()
        if n <= was:
            return scores


def extracted(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans, and those with the discovered ones."""
    spark = docs.sparkSession
    df = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({"base": base_spans(F.col("text")), "loose": loose_spans(F.col("text"))})
    df = df.withColumn("loose", apart(F.col("loose"), F.col("base")))
    thin = written(df.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", beside(F.col("text"), F.col("base")).alias("seeds"), beside(F.col("text"), F.col("loose")).alias("cands")), spark)
    seeds = thin.select(F.explode("seeds").alias("x"), F.lit(True).alias("seed"))
    cands = thin.select(F.explode("cands").alias("x"), F.lit(False).alias("seed"))
    edges = seeds.union(cands).select(F.explode("x.patterns").alias("pattern"), F.col("x.span.kind").alias("kind"), F.lower("x.span.value").alias("value"), "seed")
    good = scored(edges).filter(F.col("score") >= MIN_SCORE).select("kind", "value")
    asked = thin.filter(F.size("cands") > 0).select("row", F.explode("cands.span").alias("span"))
    taken = asked.withColumns({"kind": F.col("span.kind"), "value": F.lower("span.value")}).join(good, ["kind", "value"], "left_semi")
    more = taken.groupBy("row").agg(F.collect_list("span").alias("more"))  # one document's own spans
    out = thin.join(more, "row", "left")
    return out.select("doc_id", "base", F.concat("base", F.coalesce("more", F.array().cast(SPAN_TYPE))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = extracted(docs)
    return found.select("doc_id", *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
