"""Reading the driver tables, and cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The setting by which a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one of this machine serves a local
    master; on a cluster each executor would write to its own disk, so that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="lumenfold-"))
    return context.getCheckpointDir()


def _stored(df: DataFrame) -> str:
    """Write `df` as a table in the shared folder, which goes when the application ends. Its plan runs once and never again,
    so what it shuffled goes from the disks as soon as it is written."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    held = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, held)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _read(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """A packed file says little of its rows' size, so the planner isn't to broadcast what is made of it."""
    return spark.read.schema(schema).parquet(*paths).hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: it is computed once, kept packed by columns, and joined by sorting, so that the
    driver holds none of it."""
    return _read(df.sparkSession, [_stored(df)], df.schema)


class Growing:
    """A table in the shared folder that rounds add rows to; what is there isn't written again."""

    def __init__(self, df: DataFrame):
        self.spark, self.schema, self.paths = df.sparkSession, df.schema, []
        self.add(df)

    def add(self, df: DataFrame) -> DataFrame:
        """The added rows, as stored."""
        self.paths.append(_stored(df.select(*self.schema.names)))
        return _read(self.spark, self.paths[-1:], self.schema)

    def rows(self) -> DataFrame:
        """All rows so far."""
        return _read(self.spark, self.paths, self.schema)
