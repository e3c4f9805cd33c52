"""Findings become cases: categories, priorities, semantic clusters, merges across tools, scores, and exports.

A finding has the columns of the report readers. A case adds case_id, category, status, priority and score."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import scores as S
from lumenfold.operators import audit as A
from lumenfold.operators import guards
from lumenfold.operators.relational import first_by

# Fixed values.
PRIORITY = {"critical": "critical", "high": "high", "error": "high", "medium": "medium", "warning": "medium", "low": "low", "note": "low"}
SKIPPED_PARTS = ("tests", "test", "fixtures", "fixture", "vendor", "generated", "examples")
HIGH_IMPACT = ("command_injection", "unsafe_deserialization", "path_traversal", "access_control", "ssrf")


def category() -> Column:
    return A.external_category(F.col("cwe"), F.concat_ws(" ", "rule_id", "title", "evidence"))


def in_skipped_path(file: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(file), "/"), F.array(*[F.lit(p) for p in SKIPPED_PARTS]))


def cases(findings: DataFrame) -> DataFrame:
    """A case for each finding; the id is a digest of what the case is about, so equal ones share it."""
    df = findings.withColumn("category", category())
    key = S.key_of(F.col("category"), F.col("file"), F.coalesce("line", F.lit(0)), F.col("rule_id"))
    status = S.first_match([(in_skipped_path(F.col("file")), "false_positive_likely"), (F.col("confidence") >= 0.8, "actionable")], "needs_review")
    return df.withColumns({"case_id": key, "status": status, "priority": S.lookup(F.col("severity"), PRIORITY, "info")})


def case_order() -> list[Column]:
    return [S.lookup(F.col("status"), S.STATUS_RANK, 9), S.lookup(F.col("priority"), S.PRIORITY_RANK, 5), F.desc("confidence"), F.col("file"), F.coalesce("line", F.lit(0)), F.col("category"), F.col("case_id")]


def first_cases(df: DataFrame) -> DataFrame:
    """One case for each id, the best supported one."""
    ranked = df.withColumns({"_c": -F.col("confidence"), "_s": F.col("source"), "_r": F.col("rule_id")})
    return first_by(ranked, ["case_id"], ["_c", "_s", "_r"]).drop("_c", "_s", "_r")


def correlated(df: DataFrame) -> DataFrame:
    """Cases of one category, file and band of ten lines are one: best status and priority, highest confidence, first
    line, and which tools and rules agree."""
    band = F.floor(F.coalesce("line", F.lit(0)) / 10)
    best = lambda c, table, rest: F.min(F.struct(S.lookup(F.col(c), table, rest).alias("r"), F.col(c).alias("v")))["v"].alias(c)
    listed = lambda c, n: F.array_sort(F.collect_set(c)).alias(n)
    return df.groupBy("category", "file", band.alias("band")).agg(
        best("status", S.STATUS_RANK, 4), best("priority", S.PRIORITY_RANK, 5), F.max("confidence").alias("confidence"), F.min("line").alias("line"),
        listed("source", "tools"), listed("rule_id", "rules"), listed("case_id", "case_ids"),
    )


def scored(df: DataFrame, proven: Column | None = None) -> DataFrame:
    """Reportability of correlated cases. A factor that `df` has as a column is taken from there (`evidenced` derives those that
    need flows, routes, guards or proofs by joins), a null one doesn't hold; the others are what reports alone can show, and
    factors that reports can't show don't hold. `proven` says which have a verified bypass."""
    many, no = F.size("tools") > 1, F.lit(False)
    held = {
        "external": F.size("tools") > 0, "lineages": many, "codeflow": no, "ordered_flow": no, "route": no, "access": no, "attack_path": no, "owner_gap": F.col("category") == "access_control", "mutation": no, "sensitive": no,
        "steps": F.lit(True), "high_impact": F.col("category").isin(*HIGH_IMPACT), "strong_guard": no, "admin_guard": no, "skipped_path": in_skipped_path(F.col("file")), "nothing_found": F.lit(True),
        "static_only": ~many, "low_severity": F.col("priority").isin("low", "info"), "contradicted": no, "has_path": no, "n_tools": F.size("tools"),
        "outcome": F.when(proven if proven is not None else no, "bypassed"),
    }
    held = {k: F.coalesce(F.col(k), F.lit(False)) if k in df.columns and k not in ("n_tools", "outcome") else F.col(k) if k in df.columns else v for k, v in held.items()}
    judged = A.reportability(df.withColumns({k: v for k, v in held.items()}).withColumnRenamed("confidence", "_sure"))
    return judged.withColumnRenamed("confidence", "sureness").withColumnRenamed("_sure", "confidence").drop(*held)


def evidenced(df: DataFrame, case: str, flows: DataFrame, assessments: DataFrame, proofs: DataFrame) -> DataFrame:
    """Cases with the factors that other tables show. flows (case, ordered): a flow of data for the case, and whether its end
    comes after its beginning; assessments (case, ...): judged guards, as `guards.assessed` gives them; proofs (case, proof,
    outcome): runs that tried the case. A proof that is repeated counts once, one with several outcomes not at all; proofs
    that disagree are set apart (`quarantined`) and prove nothing. Cases without rows in a table have none of its factors."""
    flow = flows.groupBy(case).agg(F.lit(True).alias("codeflow"), F.max("ordered").alias("ordered_flow"))
    guard = guards.protected(assessments, case)
    one = proofs.filter("outcome is not null").groupBy(case, "proof").agg(F.min("outcome").alias("a"), F.max("outcome").alias("b"))
    proof = one.groupBy(case).agg(F.min(F.when(F.col("a") == F.col("b"), F.col("a"))).alias("_lo"), F.max(F.when(F.col("a") == F.col("b"), F.col("a"))).alias("_hi"), F.max(F.col("a") != F.col("b")).alias("_odd"))
    out = df.join(flow, case, "left").join(guard, case, "left").join(proof, case, "left")
    false = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("codeflow", "ordered_flow", "strong_guard", "admin_guard")}
    outcome = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    quarantined = F.coalesce((F.col("_lo") != F.col("_hi")) | F.col("_odd"), F.lit(False))
    return out.withColumns(false | {"blockers": F.coalesce("blockers", F.array().cast("array<string>")), "outcome": outcome, "quarantined": quarantined}).drop("_lo", "_hi", "_odd")


def with_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Cases with the route whose handler spans their line (0.9), else with the only route of their file (0.55)."""
    r = routes.select(F.col("file").alias("_file"), "route", "start_line", "end_line")
    only = r.groupBy("_file").agg(F.min("route").alias("_only"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    spans = df.join(r, (F.col("file") == F.col("_file")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    spans = spans.groupBy("case_id").agg(F.min("route").alias("_span"))
    only = only.withColumnRenamed("_file", "_only_file")
    out = df.join(spans, "case_id", "left").join(only, F.col("file") == F.col("_only_file"), "left")
    sure = F.when(F.col("_span").isNotNull(), 0.9).when(F.col("_only").isNotNull(), 0.55)
    return out.select(*df.columns, F.coalesce("_span", "_only").alias("route"), sure.alias("route_confidence"))


ORDER = ("category", "file", "at", "case_id")


def sarif_results(df: DataFrame) -> DataFrame:
    """One JSON result a case with the index of its rule, and the columns ORDER that reports are sorted by. Rules are
    categories, of which there are as many as the rule table names, so they are numbered in one task and sent."""
    level = S.lookup(F.col("priority"), {"critical": "error", "high": "error", "medium": "warning"}, "note")
    region = F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    kinds = df.select("category").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("category")) - 1)
    rows = df.join(kinds, "category").withColumn("at", F.coalesce("line", F.lit(0)))
    body = F.to_json(F.struct(F.col("category").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.concat_ws(": ", "category", "file").alias("text")).alias("message"), F.array(place).alias("locations")))
    return rows.select(*ORDER, body.alias("result"))


def sarif(df: DataFrame, tool: str = "lumenfold") -> str:
    """A whole report; for results that fit one file."""
    results = [json.loads(r["result"]) for r in sarif_results(df).orderBy(*ORDER).toLocalIterator()]
    rules = [{"id": k} for k in sorted({r["ruleId"] for r in results})]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]}, indent=2, sort_keys=True)


def training_rows(df: DataFrame) -> DataFrame:
    """One JSON training row a case: a system, a user and an assistant turn, and no label from outside."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.concat_ws(" ", F.lit("Assess"), "category", F.lit("at"), F.concat_ws(":", "file", F.coalesce("line", F.lit(0)).cast("string")))
    told = F.concat_ws(" ", "verdict", F.concat(F.lit("(score "), F.col("score").cast("string"), F.lit(")")))
    messages = F.array(turn("system", F.lit("You review security findings.")), turn("user", asked), turn("assistant", told))
    return df.select(F.to_json(F.struct(messages.alias("messages"), F.struct(F.lit("signal_only").alias("proof_state"), F.col("category").alias("case_type")).alias("metadata"))).alias("row"))
