"""Secret scans with a blob ledger: every text version is addressed by its content, each unseen pair of blob and rule
version is scanned once, and findings are joined back to every path that holds the blob.

Base rules are the three of the contract; further rules add spans for well-known credential formats. Spans are code
points, end exclusive.

Nulls: a null text is an empty text and so one blob; a null doc_id is a path like any other. Empty tables give empty
results. Copies share one scan and each get the findings. Extra columns are ignored by `scan` and kept by
`redact_documents`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import SPAN_TYPE, of_kind, regex_spans, span_list, written

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The last value of an assignment: what follows the first `:` or `=`, blanks and a quote.
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# Runs are taken whole and too short ones have no long enough rest, so a least length says the same as a filter.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Formats of well-known credentials, after the base rules (fixed values).
MORE_RULES = (
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack", r"\bxox[abposr]-[A-Za-z0-9-]{10,}"),
    ("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    ("url", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++://[A-Za-z0-9._~-]++:[^\x20\x09-\x0D/@]{4,}+@"),
)
#: One scan for all of MORE_RULES' literal parts; texts without any of them skip those rules.
MORE_MARKS = r"gh[pousr]_|xox[abposr]-|[rs]k_(?:live|test)_|AIza|eyJ|PRIVATE KEY|://"
#: Findings hold for the rules that made them: the version is a digest of all patterns.
RULES_VERSION = hashlib.sha256(repr((ASSIGN, ASSIGN_VALUE, ACCESS, HEX, MORE_RULES, MORE_MARKS)).encode()).hexdigest()[:16]
FINDINGS = "blob string, rules string, spans " + SPAN_TYPE


def find(text: Column) -> Column:
    """All spans of one text, base rules first. Matches that fail a length are dropped, without a second try."""
    assign = F.filter(regex_spans(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_VALUE, 1)) >= 8)
    access = regex_spans(text, ACCESS, "access", 1)
    hexes = regex_spans(text, HEX, "hex", 2)
    more = F.concat(*[regex_spans(text, p, k, i + 3) for i, (k, p) in enumerate(MORE_RULES)])
    return F.concat(assign, access, hexes, F.when(text.rlike(MORE_MARKS), more).otherwise(F.array().cast(SPAN_TYPE)))


def blobs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2(F.col("text"), 256))


def scanned(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """The paths (doc_id, blob), and findings of the blobs that the ledger (blob, rules) hasn't seen under these rules: one
    row per blob, with an empty list where nothing was found. Both are written to the shared folder.

    Which path carries a blob to the scan is settled on thin rows: the one with the smallest doc_id. Texts are then scanned
    where they stand, but for the paths that are left out, or only those that are wanted, whichever list is shorter; the
    planner sends a short list to the texts and shuffles only for a long one. Where doc_ids are null or repeated, the list
    holds blobs, too; rows that repeat a doc_id and its text can't be told apart and are each scanned."""
    spark = docs.sparkSession
    paths = written(blobs(docs).select("doc_id", "blob"), spark)
    first = paths.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    if ledger is not None:
        first = first.join(ledger.filter(F.col("rules") == rules).select("blob").distinct(), "blob", "left_anti")
    once = paths.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    wanted = F.col("known") & F.col("doc_id").eqNullSafe(F.col("first_id"))
    marked = paths.distinct().join(first.withColumn("known", F.lit(True)), "blob", "left").select("doc_id", "blob", F.coalesce(wanted, F.lit(False)).alias("wanted"))
    marked = written(marked if once else marked.select("doc_id", "blob", "wanted"), spark)
    few, many = marked.agg(F.count_if("wanted"), F.count_if(~F.col("wanted"))).first()
    # A table of its own, so that its size is known.
    chosen = written(marked.filter("wanted" if few < many else "not wanted").select("doc_id", *([] if once else ["blob"])), spark)
    at = blobs(docs)
    meets = at["doc_id"].eqNullSafe(chosen["doc_id"]) if not once else at["doc_id"] == chosen["doc_id"]
    texts = at.join(chosen, meets if once else meets & (at["blob"] == chosen["blob"]), "left_semi" if few < many else "left_anti")
    new = texts.select("blob", F.lit(rules).alias("rules"), find(F.col("text")).alias("spans"))
    return paths, written(new if once else new.dropDuplicates(["blob"]), spark)


def with_ledger(new: DataFrame, ledger: DataFrame | None, rules: str) -> DataFrame:
    return new if ledger is None else new.unionByName(ledger.filter(F.col("rules") == rules).select("blob", "rules", "spans").dropDuplicates(["blob"]))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, spans) for every path, and the new ledger rows (blob, rules, spans); append those to the ledger."""
    paths, new = scanned(docs, ledger, rules)
    return paths.join(with_ledger(new, ledger, rules).select("blob", "spans"), "blob", "left"), new


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The documents with every found secret replaced by `[SECRET]`; columns as they come, `n_chars` counted anew
    where a text changes. Findings come from the blob ledger, by content."""
    known = with_ledger(scanned(docs, ledger)[1], ledger, RULES_VERSION)
    hits = written(known.filter(F.size("spans") > 0).select("blob", F.array_sort("spans").alias("found")), docs.sparkSession)
    # A row's own columns lie in a struct, so that they never meet the names used here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    df = rows.join(hits, F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("blob"), "left")

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).cast("int").alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate("found", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    df = df.select("row", F.col("found").isNotNull().alias("hit"), F.when(F.col("found").isNotNull(), cut).otherwise(text).alias("clean"))
    n = lambda c: F.when(F.col("hit"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c])
    return df.select(*[(F.col("clean") if c == "text" else n(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "blob",
        *[of_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an empty ledger, so every distinct text is scanned once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paths, new = scanned(docs)
    return paths.join(digest(new), "blob", "left").drop("blob")
