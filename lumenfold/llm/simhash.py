"""SimHash near-duplicates by meeting in the middle: fingerprints emit the variants within half the radius, shuffle on
the variants, and colliding pairs are deduplicated and verified.

The radius is 3 bits, so half of it is one bit, rounded down. Two steps make that exact:

1. Whole fingerprints emit themselves and their 64 one-bit variants. Two that meet differ in at most two bits, so a
   variant's members need no check and are tied to their smallest one (a bucket has at most 65 distinct members).
2. Of two fingerprints at 3 bits, one half of 32 bits differs in at most one bit. Each half is emitted with its 32
   one-bit variants and meets the halves equal to a variant; the pair is verified on all 64 bits. Only pairs from
   different components of step 1 are looked at, and buckets with one component never leave their grouping.

Emitting all variants within two bits of 64 (2,081 rows a fingerprint) gives the same links at 16 times the rows.
Copies collapse to one fingerprint before anything is emitted, so a large group of copies costs one row. All joins sort:
packed tables of some hundred thousand fingerprints look small enough to broadcast, and each would stay on the driver.

Nulls: a null text is an empty text, with fingerprint zero, linked like any other. A null doc_id belongs to its
component but never names it, unless it has no other; then component_id is null. Empty tables give empty results;
repeated rows each get a row. Extra columns are ignored by `query` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import written
from lumenfold.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    at = np.cumsum([0, *map(len, tokens)]) + np.arange(len(tokens) + 1)
    starts, ends = at[:-1].tolist(), (at[1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(tokens) < SHINGLE:
        hashes = np.array([digest(joined, SEED)], dtype="<u8")
    else:
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), dtype="<u8", count=len(tokens) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k : k + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t) for t in b["text"]]})


def _prints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), a row per document. Ids cross Python as text: a null among longs would make doubles of them."""
    thin = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return thin.mapInPandas(_fingerprints, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _flips(value, bits: int):
    return F.explode(F.array(value, *[value.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(bits)]))


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) within two bits that join all fingerprints which such links join."""
    balls = prints.select("fp", _flips(F.col("fp"), 64).alias("variant"))
    low = balls.groupBy("variant").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("variant", "low")
    return balls.join(low.hint("merge"), "variant").filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def far_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the components `comp` of fingerprints within RADIUS bits of each other."""
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = prints.select("fp", "comp", F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("half")), F.struct(F.lit(1).alias("side"), low.alias("half")))).alias("h"))
    halves = halves.select("fp", "comp", F.col("h.half").alias("half"), F.col("h.side").alias("side"))
    sent = halves.select("fp", "comp", "side", "half", _flips(F.col("half"), 32).alias("variant"))
    sent = sent.select("fp", "comp", F.shiftleft(F.col("side").cast("long"), 32).bitwiseOR(F.col("variant")).alias("key"), (F.col("variant") == F.col("half")).alias("own"))
    mixed = sent.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("own").alias("any_own")).filter("lo < hi and any_own").select("key")
    met = written(sent.join(mixed.hint("merge"), "key", "left_semi"), prints.sparkSession)
    x, y = met.filter("own").select("key", F.col("fp").alias("f1"), F.col("comp").alias("a")), met.select("key", F.col("fp").alias("f2"), F.col("comp").alias("b"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("f1").bitwiseXOR(F.col("f2"))) <= RADIUS)
    return x.join(y.hint("merge"), (x["key"] == y["key"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rooted(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, whole) for every document; whole is a fingerprint that stands for the component."""
    spark = docs.sparkSession
    rows = written(fingerprints(docs), spark)
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), spark)
    first = components(near_links(prints))
    comp = prints.join(first.hint("merge"), prints["fp"] == first["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("comp"))
    comp = written(comp, spark)
    second = components(far_links(comp))
    joined = comp.join(second.hint("merge"), comp["comp"] == second["node"], "left").select("fp", "first_id", F.coalesce("root", "comp").alias("whole"))
    joined = written(joined, spark)
    names = joined.groupBy("whole").agg(F.min("first_id").alias("component_id"))
    named = joined.join(names.hint("merge"), "whole").select(F.col("fp").alias("fp2"), "component_id", "whole")
    return rows.join(named.hint("merge"), rows["fp"] == named["fp2"]).select("doc_id", "fp", "component_id", "whole")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every document: the smallest doc_id that links reach, itself included."""
    return rooted(docs).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; columns as they come. A doc_id tells rows
    apart only where it is neither null nor repeated; elsewhere the fingerprint is taken anew and met with it."""
    spark = docs.sparkSession
    found = written(rooted(docs), spark)
    best = found.groupBy("whole").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("best"))
    best = written(best.select(F.col("best.doc_id").alias("named"), F.col("best.fp").alias("print")), spark)
    ids = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    repeated = written(ids.filter("n > 1").select("id"), spark)
    once = best.filter("named is not null").join(repeated.hint("merge"), F.col("named") == F.col("id"), "left_anti")
    # A row's own columns lie in a struct, so that they never meet the names used here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("row_id"))
    unpacked = lambda df: df.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    single = unpacked(rows.join(once.hint("merge"), F.col("row_id") == F.col("named")))
    if repeated.isEmpty() and found.filter("doc_id is null").isEmpty():
        return single
    unclear = rows.filter("row_id is null").unionByName(rows.join(repeated.hint("merge"), F.col("row_id") == F.col("id"), "left_semi"))
    unclear = unclear.withColumn("own", F.pandas_udf(_prints, "long")(F.col("row.text")))
    met = unclear.join(best.hint("merge"), F.col("row_id").eqNullSafe(F.col("named")) & (F.col("own") == F.col("print")))
    # Rows with one doc_id and one fingerprint are of one component.
    return single.unionByName(unpacked(met.dropDuplicates(["named", "print"])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
