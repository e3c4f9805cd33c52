"""Queries of the audit path on the driver tables: signals made from lineitem and others, whole tables, each with its SQL.

The tables hold no findings, so their keys pick titles, codes, states and paths from short lists; the rules that then
judge them are those of `operators.audit`."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lumenfold.functions import scores as S
from lumenfold.operators import audit as A
from lumenfold.operators import relational as R
from lumenfold.plans.catalog import query
from lumenfold.sources.tables import table

TITLES = ("SQL injection in query builder", "Reflected XSS in template", "Path traversal on upload", "Shell command built from input", "Pickle load of a request", "SSRF to internal host", "Hardcoded credential", "IDOR on invoice by user_id", "Mass assignment in form", "TLS verify=False", "Open redirect", "Unused variable")
CODES = ("CWE-89", "CWE-79", "CWE-22", "CWE-78", "CWE-502", "CWE-918", "CWE-798", "CWE-639", "", "CWE-295", "CWE-601", "")
SEVERITIES = ("critical", "high", "medium", "low", "info", "error", "")
SURE = ("very_high", "", "medium", "low", "note")
FILES = ("src/app.py", "src/api/views.py", "tests/test_app.py", "vendor/lib.py", "source_app/main.py", "alembic/versions/1.py", "build/run.py", "src\\\\generated\\\\x.py", "lib/util.py")
GUARD_TEXTS = ("@login_required", "has_role('admin')", "query.filter_by(owner)", "row.tenant_id == t", "row.owner_id == current_user.id", "commonpath(base, p)", "allowlist.check(x)", "escape(x)", "", "print(x)")
PREDICATES = ("token is validated", "token is tainted", "not x > 1", "x > 1", "n <= 5", "n > 5", "input sanitized before query", "user_controlled path reaches open", "y == 1 or z == 2", "y != 1 or z != 2", "value is safe", "")
GUARANTEES = ("path.is_normalized == true", "storage.path.enforces_store_boundary", "filename.basename_only", "identifier.server_generated", "query.scoped_to_current_user", "html_output.user_values_escaped == true", "route.requires_login == true", "runtime.surface.web", "deserialization.input_trusted == true", "nothing known")
STATES = ("contradicted", "weakened", "strengthened", "unproven", "")
MESSAGES = ("Fix overflow in parser", "Add feature", "Escape html output", "Refactor views", "Update docs", "Validate token", "Bump version", "Remove dead code")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(items, at: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.expr(at) if isinstance(at, str) else at).cast("int") + 1)


def pick_sql(items, at: str) -> str:
    return f"[{', '.join(q(x) if isinstance(x, str) else str(x) for x in items)}][({at})::BIGINT + 1]"


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")" if words else "false"


def rules_sql(table_, cwe: str, text: str, rest: str = "NULL") -> str:
    arms = " ".join(f"WHEN {f'{cwe} IN ({", ".join(map(q, codes))})' if codes else 'false'} OR {any_sql(text, words)} THEN {q(name)}" for name, codes, words in table_)
    return f"CASE {arms} ELSE {rest} END"


def map_sql(value: str, values: dict, rest) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else "NULL" if v is None else f"{v}"
    return f"CASE {value} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {lit(rest)} END"


SIGNALS = f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber, {pick_sql(TITLES, 'l_partkey % 12')} AS title, {pick_sql(CODES, 'l_suppkey % 12')} AS cwe,
  {pick_sql(SEVERITIES, 'l_linenumber % 7')} AS severity, {pick_sql(SURE, 'l_orderkey % 5')} AS sure, {pick_sql(FILES, '(l_partkey + l_suppkey) % 9')} AS file, l_partkey % 300 AS line,
  {pick_sql(GUARD_TEXTS, 'l_orderkey % 10')} AS guard, {pick_sql(STATES, '(l_orderkey + l_partkey) % 5')} AS state, CASE WHEN l_partkey % 3 = 0 THEN {pick_sql(GUARANTEES, 'l_suppkey % 10')} ELSE '' END AS guarantees,
  l_suppkey % 2 = 0 AS missing, l_orderkey % 7 = 0 AS sanitized, (l_orderkey + l_partkey) % 5 = 0 AND l_suppkey % 3 = 0 AS refuted FROM lineitem"""


def signals(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", pick(TITLES, "l_partkey % 12").alias("title"), pick(CODES, "l_suppkey % 12").alias("cwe"),
        pick(SEVERITIES, "l_linenumber % 7").alias("severity"), pick(SURE, "l_orderkey % 5").alias("sure"), pick(FILES, "(l_partkey + l_suppkey) % 9").alias("file"), (F.col("l_partkey") % 300).alias("line"),
        pick(GUARD_TEXTS, "l_orderkey % 10").alias("guard"), pick(STATES, "(l_orderkey + l_partkey) % 5").alias("state"), F.when(F.expr("l_partkey % 3 = 0"), pick(GUARANTEES, "l_suppkey % 10")).otherwise("").alias("guarantees"),
        F.expr("l_suppkey % 2 = 0").alias("missing"), F.expr("l_orderkey % 7 = 0").alias("sanitized"), F.expr("(l_orderkey + l_partkey) % 5 = 0 and l_suppkey % 3 = 0").alias("refuted"),
    )


CATEGORY = rules_sql(A.CATEGORIES, "upper(cwe)", "lower(cwe || ' ' || title)", "'unknown'")
CONFIDENCE = map_sql("lower(coalesce(nullif(sure, ''), nullif(severity, '')))", A.TOOL_CONFIDENCE, 0.5)
EXTERNAL = f"SELECT *, {CATEGORY} AS category, ({CONFIDENCE})::DOUBLE AS confidence FROM ({SIGNALS})"
CASES = f"SELECT *, {map_sql('category', A.CASE_TYPES, 'external_tool_signal')} AS case_type FROM ({EXTERNAL})"


def external(spark, d):
    s = signals(spark, d)
    return s.withColumns({"category": A.external_category(F.col("cwe"), F.col("title")), "confidence": A.external_confidence(F.col("sure"), F.col("severity"))})


def cases(spark, d):
    return external(spark, d).withColumn("case_type", S.lookup(F.col("category"), A.CASE_TYPES, "external_tool_signal"))


@query(f"SELECT id, category, confidence FROM ({EXTERNAL})")
def q_external_category(spark, d):
    return external(spark, d).select("id", "category", "confidence")


@query(f"""SELECT id, case_type, CASE lower(severity) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'error' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' WHEN 'info' THEN 'info' ELSE CASE WHEN category = 'unknown' THEN 'low' ELSE 'medium' END END AS priority,
  coalesce({map_sql('category', A.MISSING, None)}, '') AS missing FROM ({CASES})""")
def q_external_cases(spark, d):
    known = {"critical": "critical", "high": "high", "error": "high", "medium": "medium", "low": "low", "info": "info"}
    rest = F.when(F.col("category") == "unknown", "low").otherwise("medium")
    priority = F.coalesce(S.lookup(F.lower("severity"), known, None), rest)
    return cases(spark, d).select("id", "case_type", priority.alias("priority"), F.coalesce(S.lookup(F.col("category"), A.MISSING, None), F.lit("")).alias("missing"))


@query(f"SELECT id, {rules_sql(A.HYPOTHESES, 'upper(cwe)', 'lower(title)')} AS hypothesis FROM ({SIGNALS})")
def q_hypothesis(spark, d):
    return signals(spark, d).select("id", A.hypothesis(F.col("cwe"), F.col("title")).alias("hypothesis"))


@query(f"SELECT state, count(*) AS n FROM ({SIGNALS}) WHERE state = 'strengthened' GROUP BY 1")
def q_hypothesis_filter(spark, d):
    return signals(spark, d).filter("state = 'strengthened'").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


GUARDED = "case_type IN ('path_traversal_possible', 'xss_possible', 'idor_bola_possible')"
PRIORITY = f"""CASE WHEN refuted AND {GUARDED} THEN 'low' WHEN case_type = 'xss_possible' AND {any_sql('lower(guarantees)', A.FAMILIES[5][1])} THEN 'low'
  WHEN (guarantees <> '' OR sanitized) AND {GUARDED} AND NOT missing THEN 'low' WHEN case_type = 'unsafe_deserialization_possible' THEN CASE WHEN guarantees <> '' THEN 'low' ELSE 'critical' END
  WHEN case_type = 'command_injection_possible' THEN CASE WHEN missing OR guarantees = '' THEN 'critical' ELSE 'low' END WHEN case_type = 'idor_bola_possible' THEN CASE WHEN missing OR guarantees = '' THEN 'high' ELSE 'low' END
  WHEN case_type = 'path_traversal_possible' THEN CASE WHEN missing AND guarantees = '' THEN 'high' ELSE 'low' END WHEN case_type IN ('ssrf_possible', 'sql_injection_possible') THEN 'high'
  WHEN case_type = 'hardcoded_secret_possible' THEN CASE WHEN guarantees <> '' THEN 'info' ELSE 'high' END WHEN lower(severity) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower(severity) ELSE 'medium' END"""
STATUS = """CASE WHEN refuted OR ((guarantees <> '' OR sanitized) AND NOT missing) THEN 'protected' WHEN state = 'weakened' THEN CASE WHEN priority IN ('low', 'info') THEN 'protected' ELSE 'needs_review' END
  WHEN state = 'strengthened' THEN CASE WHEN priority IN ('critical', 'high') THEN 'actionable' ELSE 'needs_review' END WHEN state = 'unproven' THEN 'needs_review'
  WHEN priority IN ('critical', 'high') AND case_type IN ('unsafe_deserialization_possible', 'command_injection_possible') THEN 'actionable' ELSE 'needs_review' END"""
JUDGED = f"SELECT *, {STATUS} AS status FROM (SELECT *, {PRIORITY} AS priority FROM ({CASES}))"


def judged(spark, d):
    c = F.col
    df = cases(spark, d).withColumn("priority", A.review_priority(c("case_type"), c("severity"), c("refuted"), c("guarantees"), c("missing"), c("sanitized")))
    protected = ((c("guarantees") != "") | c("sanitized")) & ~c("missing")
    return df.withColumn("status", A.case_status(c("case_type"), c("state"), c("refuted"), protected, c("priority")))


@query(f"SELECT id, case_type, priority, status FROM ({JUDGED})")
def q_case_status(spark, d):
    return judged(spark, d).select("id", "case_type", "priority", "status")


@query(f"SELECT case_type, status, priority, count(*) AS n, max(confidence) AS confidence FROM ({JUDGED}) WHERE status IN ('actionable', 'needs_review') AND case_type <> 'external_tool_signal' GROUP BY ALL")
def q_interesting_cases(spark, d):
    df = R.where(judged(spark, d), F.col("status").isin("actionable", "needs_review") & (F.col("case_type") != "external_tool_signal"))
    return df.groupBy("case_type", "status", "priority").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


@query(f"SELECT id, category, confidence FROM ({EXTERNAL}) WHERE category IN ('xss', 'ssrf', 'secrets') AND confidence >= 0.65 AND state = 'weakened'")
def q_scan_filter(spark, d):
    return external(spark, d).filter(F.col("category").isin("xss", "ssrf", "secrets") & (F.col("confidence") >= 0.65) & (F.col("state") == "weakened")).select("id", "category", "confidence")


SEVERITY_RANK = map_sql("severity", S.PRIORITY_RANK, 5)


@query(f"SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY file ORDER BY confidence DESC, {SEVERITY_RANK}, line, title, id) AS place FROM ({EXTERNAL})) WHERE place <= 20")
def q_scan_order(spark, d):
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("confidence"), S.lookup(F.col("severity"), S.PRIORITY_RANK, 5), "line", "title", "id"))
    return external(spark, d).select("id", rank.cast("long").alias("place")).filter("place <= 20")


@query(f"""SELECT id, protected, CASE WHEN protected THEN 'low' WHEN mutation OR missing THEN 'high' ELSE 'medium' END AS priority, CASE WHEN protected THEN 'protected' ELSE 'needs_review' END AS status, CASE WHEN protected THEN '' ELSE 'CWE-639' END AS cwe
  FROM (SELECT id, missing, l_linenumber % 3 = 0 AS mutation, {any_sql('lower(guard)', ('strong', 'owner', 'tenant'))} AND NOT missing AS protected FROM ({SIGNALS}))""")
def q_access_cases(spark, d):
    s = signals(spark, d).select("id", "missing", F.expr("l_linenumber % 3 = 0").alias("mutation"), (A.has_any(F.lower("guard"), ("strong", "owner", "tenant")) & ~F.col("missing")).alias("protected"))
    priority = F.when(F.col("protected"), "low").when(F.col("mutation") | F.col("missing"), "high").otherwise("medium")
    return s.select("id", "protected", priority.alias("priority"), F.when(F.col("protected"), "protected").otherwise("needs_review").alias("status"), F.when(F.col("protected"), "").otherwise("CWE-639").alias("cwe"))


@query("""SELECT l_orderkey AS path_id, min_by(l_partkey, (l_linenumber, l_partkey)) AS source, max_by(l_partkey, (l_linenumber, l_partkey)) AS sink, count(*) AS n_steps, string_agg(l_partkey::VARCHAR, '>' ORDER BY l_linenumber, l_partkey) AS steps FROM lineitem GROUP BY 1""")
def q_attack_path_cases(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path_id")).agg(steps.alias("s"))  # an order's lines are few
    return p.select("path_id", F.element_at("s", 1)["l_partkey"].alias("source"), F.element_at("s", -1)["l_partkey"].alias("sink"), F.size("s").cast("long").alias("n_steps"), F.array_join(F.transform("s", lambda x: x["l_partkey"].cast("string")), ">").alias("steps"))


@query(f"""SELECT kind, case_type, count(*) AS n FROM (SELECT 'external' AS kind, case_type FROM ({CASES}) UNION ALL SELECT 'access', 'idor_bola_possible' FROM ({SIGNALS}) WHERE guard <> '' UNION ALL SELECT 'path', 'attack_path_possible' FROM (SELECT DISTINCT l_orderkey FROM lineitem)) GROUP BY ALL""")
def q_result_cases(spark, d):
    a = cases(spark, d).select(F.lit("external").alias("kind"), "case_type")
    b = signals(spark, d).filter("guard <> ''").select(F.lit("access").alias("kind"), F.lit("idor_bola_possible").alias("case_type"))
    c = table(spark, d, "lineitem").select("l_orderkey").distinct().select(F.lit("path").alias("kind"), F.lit("attack_path_possible").alias("case_type"))
    return a.unionByName(b).unionByName(c).groupBy("kind", "case_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, {rules_sql(A.GUARDS, 'NULL', 'lower(trim(guard))')} AS guard_class FROM ({SIGNALS})")
def q_guard_class(spark, d):
    return signals(spark, d).select("id", A.guard_class(F.col("guard")).alias("guard_class"))


@query(f"SELECT file, {', '.join(f'count_if({any_sql("lower(guarantees)", words)})::BIGINT AS {name}' for name, words in A.FAMILIES)} FROM ({SIGNALS}) GROUP BY file")
def q_guarantee_families(spark, d):
    return A.families(signals(spark, d), "guarantees", ["file"])


FACTORS = {
    "external": "true", "lineages": "l_partkey % 4 = 0", "codeflow": "l_suppkey % 5 = 0", "ordered_flow": "l_orderkey % 6 = 0", "route": "l_linenumber % 2 = 0", "access": "l_partkey % 11 = 0", "attack_path": "l_partkey % 13 = 0",
    "owner_gap": "missing and category = 'access_control'", "mutation": "l_linenumber % 3 = 0", "sensitive": "l_suppkey % 7 = 0", "steps": "l_orderkey % 2 = 0", "high_impact": "category in ('command_injection', 'unsafe_deserialization', 'path_traversal', 'access_control', 'ssrf')",
    "strong_guard": "guarantees <> '' and not missing", "admin_guard": "l_suppkey % 17 = 0", "skipped_path": "file in ('tests/test_app.py', 'vendor/lib.py')", "nothing_found": "l_linenumber % 2 <> 0 and l_orderkey % 6 <> 0 and l_partkey % 11 <> 0",
    "static_only": "l_orderkey % 6 <> 0 and l_partkey % 4 <> 0", "low_severity": "severity in ('low', 'info')",
}
OUTCOME = "CASE l_orderkey % 9 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'enforced' WHEN 2 THEN 'bypassed' WHEN 3 THEN 'validated_candidate' END"
SCORED = f"""SELECT id, category, file, score, CASE WHEN strong_guard AND NOT refuted THEN 'protected_by_guard' WHEN score >= 80 THEN 'reportable_candidate' WHEN score >= 50 THEN 'needs_manual_validation' WHEN score >= 20 THEN 'weak_signal' ELSE 'likely_false_positive' END AS verdict,
  CASE WHEN n_tools > 1 OR ((access OR attack_path) AND route) THEN 'high' WHEN steps AND (route OR ordered_flow) THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT *, greatest(0, least(100, CASE WHEN total >= 80 AND outcome IS DISTINCT FROM 'bypassed' THEN 79 ELSE total END))::INTEGER AS score FROM (
  SELECT *, {' + '.join(f'(CASE WHEN {n} THEN {w} ELSE 0 END)' for n, w in A.REPORTABILITY)} + coalesce({map_sql('outcome', dict(A.OUTCOMES), 0)}, 0) AS total FROM (
  SELECT *, {', '.join(f'{v} AS {k}' for k, v in FACTORS.items())}, {OUTCOME} AS outcome, 1 + l_partkey % 2 AS n_tools FROM (SELECT * FROM ({EXTERNAL})))))"""


def scored(spark, d):
    df = external(spark, d)
    df = df.withColumns({k: F.expr(v) for k, v in FACTORS.items()} | {"outcome": F.expr(OUTCOME), "n_tools": F.expr("1 + l_partkey % 2"), "contradicted": F.col("refuted"), "has_path": F.expr(FACTORS["ordered_flow"])})
    return A.reportability(df.drop("confidence"))


@query(f"SELECT id, score, verdict, confidence FROM ({SCORED})")
def q_reportability(spark, d):
    return scored(spark, d).select("id", F.col("score").cast("int").alias("score"), "verdict", "confidence")


@query(f"SELECT category, verdict, count(*) AS n, min(score) AS low, max(score) AS high FROM ({SCORED}) WHERE score >= 30 AND verdict IN ('reportable_candidate', 'needs_manual_validation') GROUP BY ALL")
def q_reportable_only(spark, d):
    df = R.where(scored(spark, d), (F.col("score") >= 30) & F.col("verdict").isin("reportable_candidate", "needs_manual_validation"))
    return df.groupBy("category", "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("int").alias("low"), F.max("score").cast("int").alias("high"))


RATE = "round(coalesce({} / nullif(count(*), 0), 0), 6) AS {}"
RATES = {"reportable_candidate_rate": "verdict = 'reportable_candidate'", "protected_by_guard_rate": "verdict = 'protected_by_guard'", "weak_signal_rate": "verdict = 'weak_signal'", "false_reportable_candidate_rate": "expected in ('protected_by_guard', 'likely_false_positive') and verdict = 'reportable_candidate'"}
EXPECTED = "CASE WHEN id % 4 = 0 THEN 'protected_by_guard' WHEN id % 4 = 1 THEN 'likely_false_positive' ELSE verdict END"


@query(f"SELECT category, count(*) AS n_cases, count_if(expected = verdict)::BIGINT AS matched_cases, {', '.join(RATE.format(f'count_if({v})', k) for k, v in RATES.items())} FROM (SELECT *, {EXPECTED} AS expected FROM ({SCORED})) GROUP BY ROLLUP (category)")
def q_reportability_rates(spark, d):
    df = scored(spark, d).withColumn("expected", F.expr(EXPECTED))
    rates = [F.round(S.ratio(F.count_if(F.expr(v)), F.count(F.lit(1))), 6).alias(k) for k, v in RATES.items()]
    return df.rollup("category").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.expr("expected = verdict")).alias("matched_cases"), *rates)


# Pairs of reviews: each document's label stands for the truth, its length and source for what was seen.
PAIRS = "SELECT doc_id, source, n_chars, toxic = 1 AS vulnerable, n_chars > 900 AS warned, n_chars > 2500 AS fixed_warned, doc_id % 10 <> 0 AS succeeded, doc_id % 7 <> 0 AS same FROM labels JOIN documents USING (doc_id)"


def pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").selectExpr("doc_id", "source", "n_chars", "toxic = 1 as vulnerable", "n_chars > 900 as warned", "n_chars > 2500 as fixed_warned", "doc_id % 10 <> 0 as succeeded", "doc_id % 7 <> 0 as same")


@query(f"""SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0 END AS f1 FROM (SELECT source, count(*) AS n_cases, count_if(succeeded)::BIGINT AS evaluable,
  count_if(succeeded AND warned)::BIGINT AS warned, count_if(succeeded AND fixed_warned)::BIGINT AS false_positives, count_if(succeeded AND warned AND NOT fixed_warned)::BIGINT AS paired, median(CASE WHEN succeeded THEN n_chars / 1000.0::DOUBLE END) AS median_seconds, max(CASE WHEN succeeded THEN n_chars END) AS peak,
  round(coalesce(count_if(succeeded AND warned) / nullif(count_if(succeeded AND warned) + count_if(succeeded AND fixed_warned), 0), 0), 6) AS precision, round(coalesce(count_if(succeeded AND warned) / nullif(count_if(succeeded), 0), 0), 6) AS recall FROM ({PAIRS}) GROUP BY ROLLUP (source))""")
def q_paired_review(spark, d):
    n = lambda c: F.count_if(F.expr(c))
    out = pairs(spark, d).rollup("source").agg(
        F.count(F.lit(1)).alias("n_cases"), n("succeeded").alias("evaluable"), n("succeeded and warned").alias("warned"), n("succeeded and fixed_warned").alias("false_positives"), n("succeeded and warned and not fixed_warned").alias("paired"),
        F.median(F.expr("case when succeeded then n_chars / 1000D end")).alias("median_seconds"), F.max(F.expr("case when succeeded then n_chars end")).alias("peak"),
        F.round(S.ratio(n("succeeded and warned"), n("succeeded and warned") + n("succeeded and fixed_warned")), 6).alias("precision"), F.round(S.ratio(n("succeeded and warned"), n("succeeded")), 6).alias("recall"),
    )
    return out.withColumn("f1", F.expr("case when precision + recall > 0 then round(2 * precision * recall / (precision + recall), 6) else 0D end"))


@query(f"SELECT count(*) AS case_count, count_if(warned)::BIGINT AS warned, round(count_if(warned) / count(*), 6) AS recall, count_if(fixed_warned)::BIGINT AS fixed_warned, round(count_if(warned AND NOT fixed_warned) / count(*), 6) AS paired_rate, (2 * count_if(same))::BIGINT AS deterministic, (2 * count_if(NOT succeeded))::BIGINT AS errors FROM ({PAIRS})")
def q_paired_corpus(spark, d):
    n, total = lambda c: F.count_if(F.expr(c)), F.count(F.lit(1))
    return pairs(spark, d).agg(total.alias("case_count"), n("warned").alias("warned"), F.round(S.ratio(n("warned"), total), 6).alias("recall"), n("fixed_warned").alias("fixed_warned"), F.round(S.ratio(n("warned and not fixed_warned"), total), 6).alias("paired_rate"), (2 * n("same")).alias("deterministic"), (2 * n("not succeeded")).alias("errors"))


STAGES = "SELECT doc_id, unnest(['static', 'plan', 'result']) AS stage, CASE WHEN doc_id % 9 = 0 THEN 'ambiguous' WHEN toxic = 1 THEN 'vulnerable' ELSE 'safe' END AS truth, toxic, quality FROM labels"
PREDICTION = "CASE WHEN stage = 'plan' AND doc_id % 4 <> 0 THEN 'abstain' WHEN stage = 'static' OR quality = 0 THEN 'positive' ELSE 'negative' END"


@query(f"""SELECT stage, count_if(known)::BIGINT AS known, count_if(known AND truth = 'vulnerable' AND p = 'positive')::BIGINT AS tp, count_if(known AND truth = 'safe' AND p = 'positive')::BIGINT AS fp, count_if(known AND truth = 'safe' AND p = 'negative')::BIGINT AS tn, count_if(known AND truth = 'vulnerable' AND p <> 'positive')::BIGINT AS fn,
  round(coalesce(count_if(known AND truth = 'vulnerable' AND p = 'positive') / nullif(count_if(known AND p = 'positive'), 0), 0), 6) AS precision, round(coalesce(count_if(known AND truth = 'vulnerable' AND p = 'positive') / nullif(count_if(truth = 'vulnerable'), 0), 0), 6) AS recall, round(count_if(p = 'abstain') / count(*), 6) AS abstention
  FROM (SELECT *, truth <> 'ambiguous' AS known, {PREDICTION} AS p FROM ({STAGES})) GROUP BY stage""")
def q_stage_metrics(spark, d):
    df = table(spark, d, "labels").select("*", F.explode(F.array(*[F.lit(x) for x in ("static", "plan", "result")])).alias("stage"))
    df = df.withColumns({"truth": F.expr("case when doc_id % 9 = 0 then 'ambiguous' when toxic = 1 then 'vulnerable' else 'safe' end"), "p": F.expr(PREDICTION)})
    n = lambda c: F.count_if(F.expr(c))
    tp, fp = n("truth = 'vulnerable' and p = 'positive'"), n("truth = 'safe' and p = 'positive'")
    return df.groupBy("stage").agg(n("truth <> 'ambiguous'").alias("known"), tp.alias("tp"), fp.alias("fp"), n("truth = 'safe' and p = 'negative'").alias("tn"), n("truth = 'vulnerable' and p <> 'positive'").alias("fn"), F.round(S.ratio(tp, tp + fp), 6).alias("precision"), F.round(S.ratio(tp, n("truth = 'vulnerable'")), 6).alias("recall"), F.round(S.ratio(n("p = 'abstain'"), F.count(F.lit(1))), 6).alias("abstention"))


@query("""SELECT lang, count(*) AS n_cases, count_if(quality = 0)::BIGINT AS detected, count_if(quality = 1 AND n_chars < 800)::BIGINT AS missed, count_if(quality = 1 AND n_chars >= 800)::BIGINT AS abstained, round(count_if(quality = 0 OR n_chars < 800) / count(*), 6) AS evaluability,
  round(coalesce(count_if(quality = 0) / nullif(count_if(quality = 0 OR n_chars < 800), 0), 0), 6) AS sensitivity FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)""")
def q_preflight(spark, d):
    df = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = lambda c: F.count_if(F.expr(c))
    open_ = n("quality = 0 or n_chars < 800")
    return df.rollup("lang").agg(F.count(F.lit(1)).alias("n_cases"), n("quality = 0").alias("detected"), n("quality = 1 and n_chars < 800").alias("missed"), n("quality = 1 and n_chars >= 800").alias("abstained"), F.round(S.ratio(open_, F.count(F.lit(1))), 6).alias("evaluability"), F.round(S.ratio(n("quality = 0"), open_), 6).alias("sensitivity"))


@query(f"SELECT outcome, count(*) AS n, count_if(executed)::BIGINT AS executed, count_if(executed AND resolved)::BIGINT AS resolved FROM (SELECT coalesce({OUTCOME}, 'inconclusive') AS outcome, l_linenumber <> 1 AS executed, l_partkey % 3 = 0 AS resolved FROM lineitem) GROUP BY ROLLUP (outcome)")
def q_outcome_counts(spark, d):
    df = table(spark, d, "lineitem").select(F.coalesce(F.expr(OUTCOME), F.lit("inconclusive")).alias("outcome"), F.expr("l_linenumber <> 1").alias("executed"), F.expr("l_partkey % 3 = 0").alias("resolved"))
    return df.rollup("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("executed").alias("executed"), F.count_if(F.expr("executed and resolved")).alias("resolved"))


@query("""SELECT key, sum(value)::BIGINT AS total FROM (SELECT unnest(['lines', 'parts', 'returns']) AS key, unnest([l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END]) AS value FROM lineitem) GROUP BY key""")
def q_evidence_totals(spark, d):
    m = F.create_map(F.lit("lines"), F.col("l_linenumber").cast("long"), F.lit("parts"), F.col("l_partkey"), F.lit("returns"), F.expr("case when l_returnflag = 'R' then 1L else 0L end"))
    return table(spark, d, "lineitem").select(F.explode(m)).groupBy("key").agg(F.sum("value").alias("total"))


@query("""SELECT event_id FROM (SELECT *, CASE WHEN user_id % 4 = 0 THEN '' ELSE (user_id % 100)::VARCHAR END AS bid FROM events) QUALIFY bid = '' OR row_number() OVER (PARTITION BY bid, event_type ORDER BY ts, event_id) = 1""")
def q_keyless_dedupe(spark, d):
    """First wins for each (id, type); rows with an empty id all stay."""
    e = table(spark, d, "events").withColumn("bid", F.expr("case when user_id % 4 = 0 then '' else cast(user_id % 100 as string) end"))
    return e.filter("bid = ''").select("event_id").union(R.first_by(e.filter("bid <> ''").select("bid", "event_type", "ts", "event_id"), ["bid", "event_type"], ["ts", "event_id"]).select("event_id"))


@query("SELECT l_partkey % 50 AS a, l_suppkey AS b, l_returnflag AS c, l_linestatus AS d, l_linenumber AS e, l_partkey % 2 AS f, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6")
def q_path_dedupe(spark, d):
    keys = [F.expr("l_partkey % 50").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("c"), F.col("l_linestatus").alias("d"), F.col("l_linenumber").alias("e"), F.expr("l_partkey % 2").alias("f")]
    return table(spark, d, "lineitem").groupBy(*keys).agg(F.min("l_orderkey").alias("first"))





@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, p_partkey % 12 AS k, [p_partkey % 7, p_partkey % 5 + 10] AS lines FROM part),
r AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4), (8, 9), (9, 8)) t(x, y))
SELECT a, b, relation FROM (SELECT x.p_partkey AS a, y.p_partkey AS b, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.x = x.k AND r.y = y.k) THEN 'contradicts' WHEN x.k IN (0, 6) AND y.k IN (1, 7) THEN 'mitigates' WHEN len(list_intersect(x.lines, y.lines)) > 0 THEN 'supports' END AS relation
  FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey) WHERE relation IS NOT NULL""")
def q_relations(spark, d):
    """Pairs within one scope (a brand and size) and how one bears on the other."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", pick(PREDICATES, "p_partkey % 12").alias("p"), F.expr("array(p_partkey % 7, p_partkey % 5 + 10)").alias("l"))
    return A.related_pairs(p.select("p_brand", "p_size", F.col("p_partkey").alias("id"), F.col("p").alias("says"), F.col("l").alias("lines")), ["p_brand", "p_size"])


SURFACES = ("source", "runtime_web", "test", "source", "runtime_web", "migration", "deployment_or_packaging", "source", "source")


@query(f"SELECT id, {pick_sql(SURFACES, '(l_partkey + l_suppkey) % 9')} AS surface FROM ({SIGNALS})")
def q_runtime_surface(spark, d):
    return signals(spark, d).select("id", A.runtime_surface(F.col("file")).alias("surface"))


@query(f"""SELECT id, CASE WHEN k = 0 THEN 'likely_false_positive' WHEN k = 1 THEN 'protected_by_guard' WHEN k = 2 THEN 'request_more_evidence' WHEN k IN (3, 4) THEN 'lower_confidence' WHEN sanitized THEN 'needs_manual_validation' WHEN missing THEN 'request_more_evidence' ELSE 'keep' END AS recommendation,
  (CASE WHEN k IN (0, 1) THEN 0.85 WHEN k = 2 THEN 0.7 WHEN k IN (3, 4) THEN 0.75 WHEN sanitized THEN 0.65 WHEN missing THEN 0.6 ELSE greatest(0.1, least(confidence, 0.7)) END)::DOUBLE AS confidence FROM (SELECT *, l_partkey % 8 AS k FROM ({EXTERNAL}))""")
def q_offline_reasoning(spark, d):
    verdicts = F.array_compact(F.array(pick((*[v for v, _, _ in A.FEEDBACK], None, None, None), "l_partkey % 8")))
    r = A.reasoned(verdicts, F.col("sanitized"), F.col("missing"), F.col("confidence"))
    return external(spark, d).select("id", r.alias("r")).select("id", "r.recommendation", "r.confidence")


FLAGS = {"callee_external": "l_partkey % 2 = 0", "caller_external": "l_suppkey % 3 = 0", "no_try": "l_partkey % 2 = 0 and l_linenumber % 2 = 0", "no_assert": "l_orderkey % 5 <> 0", "cross_module": "l_suppkey % 4 = 1", "public_call": "l_suppkey % 3 = 0 and l_linenumber < 4"}
RISKS = {"writes": "l_linenumber % 2 = 1", "no_validation": "l_partkey % 3 = 0", "no_timeout": "l_partkey % 5 = 0", "no_sandbox": "l_suppkey % 2 = 0", "network": "l_suppkey % 7 = 0", "untrusted": "l_orderkey % 3 = 0", "no_errors": "l_orderkey % 4 = 0"}


def sum_sql(flags, weights) -> str:
    return "least(1.0::DOUBLE, " + " + ".join(f"(CASE WHEN {flags[n]} THEN {w}::DOUBLE ELSE 0 END)" for n, w in weights) + ")"


@query(f"SELECT l_orderkey, l_linenumber, round({sum_sql(FLAGS, A.TRUST)}, 9) AS asymmetry, round({sum_sql(RISKS, A.RISK)}, 9) AS risk FROM lineitem")
def q_trust_and_risk(spark, d):
    t, r = ({n: F.expr(v) for n, v in x.items()} for x in (FLAGS, RISKS))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(A.weighted(t, A.TRUST), 9).alias("asymmetry"), F.round(A.weighted(r, A.RISK), 9).alias("risk"))


@query("""SELECT s.l_orderkey * 10 + s.l_linenumber AS id, count(*) AS near FROM lineitem s JOIN lineitem g ON s.l_partkey = g.l_partkey AND abs(s.l_quantity - g.l_quantity) <= 5 AND (s.l_orderkey, s.l_linenumber) <> (g.l_orderkey, g.l_linenumber) GROUP BY ALL""")
def q_near_lines(spark, d):
    """Findings of one file within five lines of one another: an equal join on bands of six lines and their neighbours."""
    f = table(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("at"))
    band = F.floor(F.col("at") / 6)
    x = f.select("l_partkey", "id", "at", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    y = f.select("l_partkey", F.col("id").alias("other"), F.col("at").alias("there"), band.alias("band"))
    return x.join(y, ["l_partkey", "band"]).filter("abs(at - there) <= 5 and id <> other").groupBy("id").agg(F.count(F.lit(1)).alias("near"))


SIDE = "SELECT l_partkey AS cause, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_returnflag {} 'R'"


@query(f"SELECT coalesce(b.cause, c.cause) AS cause, b.id AS baseline, c.id AS candidate, CASE WHEN b.id IS NULL THEN 'introduced' WHEN c.id IS NULL THEN 'resolved' ELSE 'residual' END AS state FROM ({SIDE.format('=')}) b FULL JOIN ({SIDE.format('<>')}) c ON b.cause = c.cause AND b.n = c.n")
def q_positional_pairs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cause"), "l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    n = F.row_number().over(Window.partitionBy("cause").orderBy("l_orderkey", "l_linenumber"))
    side = lambda where, name: rows.filter(where).select("cause", n.alias("n"), F.col("id").alias(name))
    both = side("l_returnflag = 'R'", "baseline").join(side("l_returnflag <> 'R'", "candidate"), ["cause", "n"], "full")
    return both.select("cause", "baseline", "candidate", F.expr("case when baseline is null then 'introduced' when candidate is null then 'resolved' else 'residual' end").alias("state"))


@query("""SELECT user_id, event_type, least(0.97, prior + least(0.09, 0.03 * (n - 1)) + CASE WHEN exact THEN 0.1 ELSE 0 END)::DOUBLE AS confidence FROM (SELECT user_id, event_type, count(*) AS n, bool_or(value > 95) AS exact, CASE event_type WHEN 'error' THEN 0.8::DOUBLE WHEN 'purchase' THEN 0.7 ELSE 0.5 END AS prior FROM events GROUP BY 1, 2)""")
def q_bridge_confidence(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("value") > 95).alias("exact"))
    prior = S.lookup(F.col("event_type"), {"error": 0.8, "purchase": 0.7}, 0.5)
    return g.select("user_id", "event_type", F.least(F.lit(0.97), prior + F.least(F.lit(0.09), 0.03 * (F.col("n") - 1)) + F.when(F.col("exact"), 0.1).otherwise(0.0)).alias("confidence"))


@query("""SELECT event_type, avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0 END) AS fp_rate, greatest(0.1, greatest(0.2, 0.8 - 0.6 * avg(CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0 END)) - CASE WHEN count(*) > 10 THEN 0.2 ELSE 0 END) AS novelty FROM events GROUP BY 1""")
def q_novelty_prior(spark, d):
    rate, n = F.avg(F.when(F.col("value") < 20, 1.0).otherwise(0.0)), F.count(F.lit(1))
    base = F.greatest(F.lit(0.2), 0.8 - 0.6 * rate)
    return table(spark, d, "events").groupBy("event_type").agg(rate.alias("fp_rate"), F.greatest(F.lit(0.1), base - F.when(n > 10, 0.2).otherwise(0.0)).alias("novelty"))


@query("""SELECT e.event_id, CASE WHEN k.n IS NULL OR k.n < 3 THEN NULL WHEN k.fp > k.ok THEN round(0.7 * c + 0.3 * (k.ok / (k.ok + k.fp)), 6) WHEN k.ok + k.fp > 0 THEN round(0.7 * c + 0.3 * (k.ok / (k.ok + k.fp)), 6) END AS adjusted FROM (SELECT event_id, user_id, value / 100 AS c FROM events) e
  LEFT JOIN (SELECT user_id, count(*) AS n, count_if(value < 20) AS fp, count_if(value > 70) AS ok FROM events GROUP BY 1) k USING (user_id)""")
def q_confidence_adjustment(spark, d):
    e = table(spark, d, "events")
    k = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("value < 20")).alias("fp"), F.count_if(F.expr("value > 70")).alias("ok"))
    out = F.when((F.col("n") >= 3) & (F.col("ok") + F.col("fp") > 0), F.round(0.7 * F.col("value") / 100 + 0.3 * (F.col("ok") / (F.col("ok") + F.col("fp"))), 6))
    return e.join(k, "user_id", "left").select("event_id", out.alias("adjusted"))


@query("""WITH nodes AS (SELECT s_suppkey AS node, (s_suppkey % 10) / 10::DOUBLE AS c FROM supplier WHERE (s_suppkey % 10) / 10::DOUBLE >= 0.3), e AS (SELECT s_suppkey AS src, s_suppkey * 7 % (SELECT max(s_suppkey) + 1 FROM supplier) AS dst FROM supplier)
SELECT src, dst FROM e WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)""")
def q_subgraph(spark, d):
    """The edges between the nodes that pass a least confidence; pruning leaves the same."""
    from lumenfold.plans.catalog import all_edges

    keep = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10 / 10.0).alias("c")).filter("c >= 0.3").select("s_suppkey")
    e = all_edges(spark, d)
    return e.join(keep, e["src"] == keep["s_suppkey"], "left_semi").join(keep, e["dst"] == keep["s_suppkey"], "left_semi")


@query("SELECT n_nationkey AS node, count(s_suppkey) AS dependents FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 6 = 5 GROUP BY 1")
def q_unjustified_foundations(spark, d):
    n, s = table(spark, d, "nation").filter("n_nationkey % 6 = 5"), table(spark, d, "supplier")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"]).groupBy(F.col("n_nationkey").alias("node")).agg(F.count("s_suppkey").alias("dependents"))


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, max(severity) AS severity FROM (SELECT l_partkey % 100 AS a, l_suppkey % 100 AS b, l_discount * 10 AS severity FROM lineitem) WHERE a <> b GROUP BY 1, 2 HAVING max(severity) >= 0.3""")
def q_contradictions_ranked(spark, d):
    p = table(spark, d, "lineitem").selectExpr("l_partkey % 100 as a", "l_suppkey % 100 as b", "l_discount * 10 as severity").filter("a <> b")
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("severity").alias("severity")).filter("severity >= 0.3")


@query(f"SELECT code, n, place FROM (SELECT cwe AS code, count(DISTINCT l_partkey) AS n, row_number() OVER (ORDER BY count(DISTINCT l_partkey) DESC, cwe) AS place FROM ({SIGNALS}) WHERE cwe <> '' GROUP BY cwe) WHERE place <= 10")
def q_rule_index(spark, d):
    n = signals(spark, d).filter("cwe <> ''").groupBy(F.col("cwe").alias("code")).agg(F.countDistinct("l_partkey").alias("n"))  # a row a code
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")).cast("long")).filter("place <= 10")


@query(f"SELECT DISTINCT s.file FROM ({SIGNALS}) s WHERE s.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def q_files_for_rules(spark, d):
    rules = table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return signals(spark, d).join(rules, "l_suppkey", "left_semi").select("file").distinct()


@query("SELECT event_id, total FROM (SELECT event_id, count(*) OVER () AS total, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 100")
def q_listing(spark, d):
    found = table(spark, d, "events").filter("event_type = 'error'").select("event_id")
    return found.orderBy("event_id").limit(100).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


@query("SELECT event_id, user_id, value FROM events WHERE value >= 80")
def q_recall_confident(spark, d):
    return table(spark, d, "events").filter("value >= 80").select("event_id", "user_id", "value")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def q_history_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id")


MESSAGE = pick_sql(MESSAGES, "event_id % 8")


@query(f"SELECT event_id FROM events WHERE {any_sql(f'lower({MESSAGE})', A.FIX_WORDS)}")
def q_security_fixes(spark, d):
    return table(spark, d, "events").filter(A.has_any(F.lower(pick(MESSAGES, "event_id % 8")), A.FIX_WORDS)).select("event_id")


@query("""SELECT c.event_id, b.s_suppkey AS claim FROM (SELECT event_id, user_id % 50 AS file, floor(value)::BIGINT AS at, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY) c JOIN (SELECT s_suppkey, s_suppkey % 50 AS file, s_suppkey % 80 AS lo, s_suppkey % 80 + 4 AS hi FROM supplier) b ON b.file = c.file AND c.at BETWEEN b.lo AND b.hi""")
def q_active_drift(spark, d):
    """Recent changes that touch the lines of a claim on the same file."""
    e = table(spark, d, "events")
    recent = e.join(F.broadcast(e.agg(F.max("ts").alias("last")))).filter("ts >= last - INTERVAL 30 DAY").select("event_id", F.expr("user_id % 50").alias("file"), F.floor("value").alias("at"))
    claims = table(spark, d, "supplier").selectExpr("s_suppkey as claim", "s_suppkey % 50 as file", "s_suppkey % 80 as lo", "s_suppkey % 80 + 4 as hi")
    return R.in_spans(recent, claims, "file", "at", "lo", "hi", 8).select("event_id", "claim")


DECORATORS = ("login_required", "admin_required", "permission_required", "Depends(user)", "cache", "requires_auth admin_required")


@query(f"SELECT id, concat_ws(',', {', '.join(f'CASE WHEN {any_sql("n", words)} THEN {q(g)} END' for g, words in A.ROUTE_GUARANTEES)}) AS guarantees FROM (SELECT id, lower({pick_sql(DECORATORS, 'l_partkey % 6')}) AS n FROM ({SIGNALS}))")
def q_route_guarantees(spark, d):
    names = F.split(pick(DECORATORS, "l_partkey % 6"), " ")
    return signals(spark, d).select("id", F.array_join(A.route_guarantees(names), ",").alias("guarantees"))


@query("""SELECT page_id, host, path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, 200 + page_id % 300 AS status FROM pages) WHERE status BETWEEN 200 AND 399 AND NOT regexp_matches(lower(path), '\\.(png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|otf|eot|css|map)$')""")
def q_traffic_filter(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.expr("200 + page_id % 300").alias("status"))
    return p.filter(F.col("status").between(200, 399) & ~A.is_static(F.col("path"))).select("page_id", "host", "path")


@query("SELECT d.doc_id, b.item_id AS cached FROM documents d LEFT JOIN (SELECT sha256(text) AS h, min(item_id) AS item_id FROM benchmark GROUP BY 1) b ON sha256(d.text) = b.h")
def q_content_cache(spark, d):
    cache = table(spark, d, "benchmark").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("item_id").alias("cached"))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.join(cache, "h", "left").select("doc_id", "cached")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def q_pending_attempts(spark, d):
    done = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("""SELECT l_orderkey, CASE WHEN bool_or(required AND result IS NULL) THEN 'inconclusive' WHEN bool_or(NOT result) THEN 'bypassed' WHEN bool_or(main AND result) THEN 'enforced' ELSE 'inconclusive' END AS outcome
  FROM (SELECT l_orderkey, l_linenumber < 3 AS required, l_linenumber = 1 AS main, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 5 < 4 END AS result FROM lineitem) GROUP BY 1""")
def q_evidence_decision(spark, d):
    from lumenfold.operators.access import decided

    e = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber < 3 as required", "l_linenumber = 1 as primary", "case when l_partkey % 5 = 0 then null else l_partkey % 5 < 4 end as result")
    return decided(e, "l_orderkey")


@query("""SELECT s_suppkey AS claim, CASE k WHEN 0 THEN least(0.99, c + 0.2) WHEN 1 THEN greatest(0.01, c - 0.3) ELSE c END AS confidence, CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN 0.3 END AS reward FROM (SELECT s_suppkey, (s_suppkey % 10) / 10::DOUBLE AS c, s_suppkey % 4 AS k FROM supplier)""")
def q_learned(spark, d):
    from lumenfold.operators.access import learned

    claims = table(spark, d, "supplier").select(F.col("s_suppkey").alias("claim"), (F.col("s_suppkey") % 10 / 10.0).alias("confidence"))
    verdicts = claims.filter("claim % 4 < 3").select("claim", pick(("confirmed", "refuted", "inconclusive"), "claim % 4").alias("verdict"))
    return learned(claims, verdicts, "claim")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unresolved' WHEN c_nationkey <> o_orderkey % 25 OR c_mktsegment <> 'BUILDING' THEN 'quarantined' ELSE 'verified' END AS state, concat_ws(',', CASE WHEN c_nationkey <> o_orderkey % 25 THEN 'nation' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment' END) AS differs
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def q_proof_resolution(spark, d):
    """Proofs found by id, then every binding compared."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    differs = F.array_compact(F.array(F.when(F.expr("c_nationkey <> o_orderkey % 25"), "nation"), F.when(F.col("c_mktsegment") != "BUILDING", "segment")))
    state = F.when(F.col("c_custkey").isNull(), "unresolved").when(F.size(differs) > 0, "quarantined").otherwise("verified")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", state.alias("state"), F.array_join(differs, ",").alias("differs"))


@query("""SELECT part, min_by(id, (source, id)) AS id, min(source) AS source FROM (SELECT l_partkey || ':' || l_linenumber || ':' || substr(l_returnflag || l_linestatus, 1, 20) AS part, l_orderkey * 10 + l_linenumber AS id, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS source FROM lineitem) GROUP BY 1""")
def q_earlier_source_wins(spark, d):
    f = table(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.substring(F.concat("l_returnflag", "l_linestatus"), 1, 20)).alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.expr("case l_linestatus when 'O' then 0 else 1 end").alias("source"))
    return f.groupBy("part").agg(F.min(F.struct("source", "id")).alias("m")).select("part", "m.id", "m.source")


@query("""SELECT p_partkey, bucket < 10 AS canary FROM (SELECT p_partkey, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT % 100 AS bucket FROM part)""")
def q_cohort_split(spark, d):
    bucket = F.conv(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, d, "part").select("p_partkey", (bucket < 10).alias("canary"))


@query("""SELECT coalesce(a.id, e.id) AS id, n, CASE WHEN e.id IS NULL THEN 'unexpected' WHEN a.id IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS state FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT c_custkey AS id FROM customer) e ON a.id = e.id""")
def q_prediction_merge(spark, d):
    """Merged predictions against the ids that are expected: duplicates, missing and unexpected ones are named."""
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(True).alias("known"))
    state = F.when(F.col("known").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return a.join(e, "id", "full").select("id", "n", state.alias("state"))


@query("""SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY 1 HAVING min(value) < 0.001) GROUP BY 1""")
def q_adapt_all(spark, d):
    """Results of all tools; a tool with any error is left out whole."""
    e = table(spark, d, "events")
    bad = e.groupBy("event_type").agg(F.min("value").alias("low")).filter("low < 0.001").select("event_type")
    return e.join(bad, "event_type", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN k.user_id IS NULL THEN value / 100 ELSE value / 100 * 0.1 END AS confidence, k.user_id IS NULL AND value > 50 AS supports FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value < 10) k USING (user_id)""")
def q_known_false_positives(spark, d):
    e = table(spark, d, "events")
    known = e.filter("event_type = 'error' and value < 10").select("user_id").distinct().withColumn("known", F.lit(True))
    c = F.col("value") / 100
    return e.join(known, "user_id", "left").select("event_id", F.when(F.col("known").isNull(), c).otherwise(c * 0.1).alias("confidence"), (F.col("known").isNull() & (F.col("value") > 50)).alias("supports"))


@query("""SELECT x.p_partkey AS src, y.p_partkey AS dst FROM (SELECT p_partkey, unnest(['n' || (p_partkey * 3 % 40), ' N' || (p_partkey * 5 % 40) || ' ']) AS dep FROM part) x JOIN (SELECT 'n' || (p_partkey % 40) AS name, max(p_partkey) AS p_partkey FROM part GROUP BY 1) y ON lower(trim(x.dep)) = y.name WHERE x.p_partkey <> y.p_partkey""")
def q_dependency_edges(spark, d):
    """Dependencies by their text without case and blanks; of rows with one text the last is meant; no loops."""
    deps = table(spark, d, "part").select("p_partkey", F.explode(F.expr("array(concat('n', p_partkey * 3 % 40), concat(' N', p_partkey * 5 % 40, ' '))")).alias("dep"))
    named = table(spark, d, "part").groupBy(F.expr("concat('n', p_partkey % 40)").alias("name")).agg(F.max("p_partkey").alias("dst"))
    return deps.join(named, F.lower(F.trim("dep")) == F.col("name")).filter("p_partkey <> dst").select(F.col("p_partkey").alias("src"), "dst")


@query("""SELECT p_partkey, replace(p_name, ' ', '/') AS path, lower(p_type) AS severity, least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_retailprice / 1500)) AS confidence, substr(sha256(concat_ws(chr(31), replace(p_name, ' ', '/'), lower(p_type), p_size::VARCHAR)), 1, 16) AS fingerprint FROM part""")
def q_finding_normalise(spark, d):
    path, sev = F.replace(F.col("p_name"), F.lit(" "), F.lit("/")), F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", path.alias("path"), sev.alias("severity"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_retailprice") / 1500)).alias("confidence"), F.substring(F.sha2(F.concat_ws("\x1f", path, sev, F.col("p_size").cast("string")), 256), 1, 16).alias("fingerprint"))


SCOPES = "SELECT s_suppkey AS id, s_nationkey AS file, s_suppkey % 40 AS lo, s_suppkey % 40 + s_suppkey % 6 AS hi FROM supplier"


@query(f"SELECT x.id AS a, y.id AS b, concat_ws('.', 'm' || x.file, CASE WHEN x.id % 2 = 0 THEN 'C' || x.id % 5 END, 'f' || x.id) AS name FROM ({SCOPES}) x JOIN ({SCOPES}) y ON x.file = y.file AND x.id < y.id AND x.lo <= y.hi AND y.lo <= x.hi")
def q_scope_overlap(spark, d):
    """Scopes of one file whose lines meet, by bands of eight lines; a pair counts in the band where both are first met."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_nationkey as file", "s_suppkey % 40 as lo", "s_suppkey % 40 + s_suppkey % 6 as hi")
    e = s.withColumn("band", F.explode(F.expr("sequence(lo div 8, hi div 8)")))
    x, y = e.toDF("a", "file", "la", "ha", "band"), e.toDF("b", "file", "lb", "hb", "band")
    met = x.join(y, ["file", "band"]).filter("a < b and la <= hb and lb <= ha and band = greatest(la, lb) div 8")
    return met.select("a", "b", F.concat_ws(".", F.concat(F.lit("m"), F.col("file").cast("string")), F.expr("case when a % 2 = 0 then concat('C', a % 5) end"), F.concat(F.lit("f"), F.col("a").cast("string"))).alias("name"))


@query("SELECT doc_id, coalesce(regexp_extract(upper(code), 'CWE-([0-9]+)', 1), '') AS number, CASE regexp_extract(code, '([0-9]+)$', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.CWE_SEVERITY.items()) + f" ELSE {S.CWE_DEFAULT} END::DOUBLE AS severity FROM (SELECT doc_id, {pick_sql(CODES, 'doc_id % 12')} AS code FROM documents)")
def q_cwe_severity(spark, d):
    code = pick(CODES, "doc_id % 12")
    number = F.regexp_extract(code, r"([0-9]+)$", 1)
    return table(spark, d, "documents").select("doc_id", number.alias("number"), S.lookup(number, {str(k): v for k, v in S.CWE_SEVERITY.items()}, S.CWE_DEFAULT).alias("severity"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(replace(p_brand, '#', '-')) END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.0' END AS version FROM part")
def q_pins(spark, d):
    line = F.expr("concat(replace(p_brand, '#', '-'), case p_partkey % 3 when 0 then '[x] == ' when 1 then ' >= ' else ' ~= ' end, p_size, '.0 # note')")
    return table(spark, d, "part").select("p_partkey", S.pinned(line).alias("p")).select("p_partkey", "p.name", "p.version")
