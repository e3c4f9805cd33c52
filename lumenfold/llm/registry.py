"""Queries of this subpackage by name, and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import lexical, licenses, media, mixing, packing, passages, pii, quality, secrets, simhash, topk, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.query,
        "op2_pii": pii.query,
        "op3_simhash": simhash.query,
        "op4_quality_rules": quality.query,
        "op5_packing": packing.query,
        "op6_toxicity": toxicity.query,
        "op7_secrets": secrets.query,
        "op8_topk": topk.query,
        "op9_licenses": licenses.query,
        "op10_passages": passages.query,
        "op11_media": media.query,
        "op12_lexical": lexical.query,
        "op13_whitening": whitening.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.oracle_sql(), "op4_quality_rules": quality.ORACLE_SQL, "op8_topk": topk.ORACLE_SQL, "op12_lexical": lexical.ORACLE_SQL}
