"""Pattern rules over text: redaction, first matches by line, soft-404 pages, hashed word vectors, row contracts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scores import tokens

# Fixed values.
REDACTIONS = {
    r"(?i)(bearer)\s+[A-Za-z0-9._~+/=-]+": "$1 [REDACTED]",
    r"(?i)(password|passwd|secret|token|api_?key)(\s*[:=]\s*)[^\s,;]+": "$1$2[REDACTED]",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+": "[EMAIL]",
}
LINE_PATTERNS = {"script": r"<script", "link": r"<a\s", "heading": r"<h[1-6]", "list": r"<li", "paragraph": r"<p[ >]"}
MISSING_PAGE = r"(?i)page not found|not found|404|does not exist|no longer available"
DIMENSIONS = 1024
ROLES = ("system", "user", "assistant")
MAX_CONTENT = 10_000


def redacted(text: Column, rules: Mapping[str, str] = REDACTIONS) -> Column:
    for pattern, to in rules.items():
        text = F.regexp_replace(text, pattern, to)
    return text


def matcher(pattern: str):
    return lambda line: line.rlike(pattern)


def first_lines(df: DataFrame, key: str, text: str, patterns: Mapping[str, str] = LINE_PATTERNS) -> DataFrame:
    """(key, pattern, line): the number of the first line that matches each pattern. No line rows are made."""
    lines = F.split(F.col(text), "\n", -1)
    at = [F.struct(F.lit(n).alias("pattern"), F.array_position(F.transform(lines, matcher(p)), F.lit(True)).alias("line")) for n, p in patterns.items()]
    return df.select(key, F.explode(F.array(*at)).alias("_m")).select(key, "_m.pattern", "_m.line").filter("line > 0")


def soft_missing(status: Column, text: Column, least: int = 512) -> Column:
    """Whether a page that was served all the same is an error page: too short, or it says so."""
    return (status == 200) & ((F.length(text) < least) | text.rlike(MISSING_PAGE))


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dim, weight): words hashed to dimensions by the first 8 hex digits of their MD5, counts at unit length."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("w"))
    dims = words.select(key, (F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % DIMENSIONS).alias("dim"))
    counts = dims.groupBy(key, "dim").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "dim", (F.col("n") / F.col("norm")).alias("weight"))


def most_similar(vectors: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """The k most similar other rows of each row by shared dimensions: (a, b, rank, score), ties to the smaller b."""
    x, y = vectors.select(F.col(key).alias("a"), "dim", F.col("weight").alias("wa")), vectors.select(F.col(key).alias("b"), "dim", F.col("weight").alias("wb"))
    score = F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("score")
    pairs = x.join(y, "dim").filter("a <> b").groupBy("a", "b").agg(score).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def turn_issues(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, turn, issue): a row for each broken rule of a training turn."""
    order = Window.partitionBy(conversation).orderBy(turn)
    before = F.lag(role).over(order)
    rules = {
        "empty_content": F.coalesce(F.trim(F.col(text)), F.lit("")) == "",
        "long_content": F.length(text) > MAX_CONTENT,
        "unknown_role": ~F.col(role).isin(*ROLES),
        "late_system": (F.col(role) == "system") & before.isNotNull(),
        "repeated_role": before.eqNullSafe(F.col(role)),
        "secret": F.col(text).rlike(r"(?i)(password|secret|token|api_?key)\s*[:=]"),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return turns.withColumn("_found", found).select(conversation, turn, F.explode("_found").alias("issue"))
