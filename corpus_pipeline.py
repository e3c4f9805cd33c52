"""A training corpus from raw documents: quality rules, near-duplicates, secrets, mixture, packing.

Each stage takes all that the one before kept, as Parquet in the shared folder, and all but the last return the columns
of documents: (doc_id, text, lang, source, n_chars), whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import mixing, packing, quality, secrets, simhash
from lumenfold.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the quality rules reject."""
    return quality.clean_documents(docs.select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secrets.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture under target weights; a document comes once for each epoch that takes it."""
    return mixing.mix_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("quality", clean),
    ("near duplicates", one_of_each),
    ("secrets", without_secrets),
    ("mixture", mixed),
    ("packing", packed),
]

#: Fingerprints and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
