"""Bundles of deltas with verdicts, conflicts and chains, read from whole JSON files (path, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scores import DELTA_CUTS, cut

DELTA = "struct<id:string,delta_type:string,category:string,description:string,vector:map<string,double>,file:string,line:int,route:string,cwe:array<string>>"
VERDICT = "struct<delta_ref:string,result:string,tested:boolean,human_validated:boolean,weight:double>"
CONFLICT = "struct<delta_ref:string,divergence_score:double,resolution:string>"
CHAIN = "struct<chain_id:string,delta_refs:array<string>,combined_severity:double>"
BUNDLE = f"struct<meta:struct<format_version:int>,deltas:array<{DELTA}>,verdicts:array<{VERDICT}>,conflicts:array<{CONFLICT}>,chains:array<{CHAIN}>>"
#: What a verdict says of a delta (fixed values).
OUTCOMES = {"confirmed": "validated_candidate", "bypassed": "bypassed", "blocked": "enforced", "enforced": "enforced", "refuted": "false_positive", "false_positive": "false_positive"}


def parsed(raw: DataFrame) -> DataFrame:
    return raw.select("path", F.from_json("text", BUNDLE).alias("b")).filter("b.deltas is not null")


def deltas(raw: DataFrame) -> DataFrame:
    """A finding a delta: severity by its vector's largest value, with its sorted verdicts and how many conflicts it has.

    All parts of a bundle stand in one row, so verdicts meet their delta without a join."""
    rows = parsed(raw).select("path", F.explode("b.deltas").alias("d"), "b.verdicts", "b.conflicts")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    mine = F.filter(F.coalesce("verdicts", none(VERDICT)), lambda v: v["delta_ref"] == F.col("d.id"))
    against = F.filter(F.coalesce("conflicts", none(CONFLICT)), lambda c: c["delta_ref"] == F.col("d.id"))
    most = F.coalesce(F.array_max(F.map_values("d.vector")), F.lit(0.0))
    outcome = F.lit("unresolved")
    for k, v in OUTCOMES.items():
        outcome = F.when(F.array_contains(F.transform(mine, lambda x: x["result"]), k), v).otherwise(outcome)
    return rows.select(
        "path", F.col("d.id").alias("id"), F.col("d.category").alias("category"), F.coalesce("d.file", "d.route", F.lit("")).alias("file"), F.col("d.line").alias("line"),
        cut(most, DELTA_CUTS, "info").alias("severity"), F.array_sort(F.transform(mine, lambda v: v["result"])).alias("verdicts"), outcome.alias("outcome"), F.size(against).alias("n_conflicts"),
    )


def chains(raw: DataFrame) -> DataFrame:
    """A row a step of a chain, with its delta where the bundle has it."""
    steps = parsed(raw).select("path", "b.deltas", F.explode("b.chains").alias("c")).select("path", "deltas", F.col("c.chain_id").alias("chain_id"), F.posexplode("c.delta_refs").alias("step", "ref"))
    delta = F.get(F.filter("deltas", lambda d: d["id"] == F.col("ref")), 0)
    return steps.select("path", "chain_id", "step", "ref", delta["category"].alias("category"), delta.isNotNull().alias("known"))
