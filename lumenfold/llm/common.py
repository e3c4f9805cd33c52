"""Shared parts of the corpus operators: words, regular-expression spans, span digests and shared scratch tables.

Columns are picked by name, so extra input columns never reach an operator's own names.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java class.
SPACE = r"[\x20\x09-\x0D]"
MATCHES = 128  # matches of a text that are located in one go
SPAN_TYPE = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one of this machine serves a local
    master; on a cluster each executor would write to its own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs
    only a read. The folder goes when the application ends."""
    path = f"{scratch_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def filtered_in_place(df: DataFrame, flag: str) -> DataFrame:
    """The rows with a true `flag`, and without that column. The filter reads a generator's output, which the optimizer
    leaves where it is; it would move a plain one below the columns that the flag is made of and put in all their
    definitions for their names, again for each mention."""
    rest = [df[c] for c in df.columns if c != flag]
    return df.select(*rest, F.explode(F.array(flag)).alias(flag)).filter(flag).drop(flag)


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def regex_spans(text: Column, pattern: str, kind: str, order: int) -> Column:
    """All leftmost non-overlapping matches of `pattern` (one that never matches emptily), as SPAN_TYPE.

    Starts are code points: the pieces between the matches and the matches alternate, so a running sum of their
    lengths gives them. JVM regular expressions only.
    """
    def located(pairs: Column) -> Column:
        """(at, out) of pieces and matches in a row, counted from the first piece."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN_TYPE).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            first = (acc["at"] + x["g"]).cast("int")
            last = (first + F.length(x["h"])).cast("int")
            found = F.struct(first.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), last.alias("end"), x["h"].alias("value"))
            return F.struct(last.alias("at"), F.array_append(acc["out"], found).cast(SPAN_TYPE).alias("out"))

        return F.aggregate(pairs, start, step)

    def shifted(block: Column, by: Column) -> Column:
        moved = lambda s: F.struct((s["start"] + by).cast("int").alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["end"] + by).cast("int").alias("end"), s["value"].alias("value"))
        return F.transform(block["out"], moved)

    def blocks(pairs: Column) -> Column:
        """Appending copies what is there, so many matches are located in blocks of MATCHES, and these put one after the
        other by their lengths."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / MATCHES).cast("int")), lambda i: located(F.slice(pairs, i * MATCHES + 1, F.lit(MATCHES))))
        lengths = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, (F.element_at(acc, -1) + x["at"]).cast("int")))
        return bound(parts, lambda p: bound(lengths(p), lambda n: F.flatten(F.zip_with(p, F.slice(n, F.lit(1), F.size(p)), shifted))))

    def spans(hits: Column) -> Column:
        pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
        return bound(pairs, lambda p: F.when(F.size(p) <= MATCHES, located(p)["out"]).otherwise(blocks(p)))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Most texts have no match at all; they stop at the first of the two scans.
    return F.when(text.rlike(pattern), spans(hits)).otherwise(F.array().cast(SPAN_TYPE))


def span_list(spans: Column) -> Column:
    """`kind:start:end` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def chunks(sizes: list[int], rows: int, total: int) -> Iterator[slice]:
    """Slices of consecutive rows, at most `rows` of them and of `total` size together; a larger row comes alone."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and (k - first == rows or held + n > total):
            yield slice(first, k)
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield slice(first, len(sizes))
