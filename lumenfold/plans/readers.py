"""Queries of the report readers: reports of twenty parts each are written as text from `part`, read back by the reader, and
compared with the rows that SQL takes from the table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.audit import SURE, pick, pick_sql
from lumenfold.plans.catalog import query
from lumenfold.sources import reports as P
from lumenfold.sources.tables import table

LEVELS = ("error", "warning", "note", "high", "medium", "low", "critical", "info")
LEVEL = pick_sql(LEVELS, "p_partkey % 8")
CUT = "CASE {} WHEN 'critical' THEN 0.85 WHEN 'high' THEN 0.85 WHEN 'very_high' THEN 0.85 WHEN 'error' THEN 0.85 WHEN 'medium' THEN 0.65 WHEN 'warning' THEN 0.65 WHEN 'low' THEN 0.35 WHEN 'note' THEN 0.35 WHEN 'info' THEN 0.35 ELSE 0.5 END::DOUBLE"


def finding_sql(source: str, rule: str, title: str, file: str, line: str, cwe: str, severity: str, evidence: str, stated: str | None = None, where: str = "true") -> str:
    return f"SELECT p_partkey AS part, '{source}' AS source, {rule} AS rule_id, {title} AS title, {file} AS file, {line} AS line, {cwe} AS cwe, {severity} AS severity, {CUT.format(stated or severity)} AS confidence, {evidence} AS evidence FROM part WHERE {where}"


def texts(spark, d, item: Column, wrap) -> DataFrame:
    """(path, text) of reports, each with the items of twenty parts."""
    rows = table(spark, d, "part").groupBy(F.expr("concat('r', p_partkey div 20)").alias("path")).agg(F.collect_list(item).alias("items"))
    return rows.select("path", wrap(F.col("items")).alias("text"))


def json_of(**fields: Column):
    return lambda items: F.to_json(F.struct(*[(c(items) if callable(c) else c).alias(k) for k, c in fields.items()]))


def s(**fields: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def rule() -> Column:
    return F.concat(F.lit("R"), F.col("p_partkey").cast("string"))


def part(df: DataFrame, column: str = "rule_id") -> DataFrame:
    return df.select(F.regexp_extract(column, "([0-9]+)$", 1).cast("long").alias("part"), "*")


def level() -> Column:
    return pick(LEVELS, "p_partkey % 8")


def sure() -> Column:
    return pick(SURE, "p_partkey % 5")


SURE_TEXT = pick_sql(SURE, "p_partkey % 5")
STATED = f"coalesce(nullif({SURE_TEXT}, ''), {LEVEL})"
RULE = "'R' || p_partkey"


@query(finding_sql("semgrep", RULE, "p_name", "'src/' || p_brand", "p_size", "'CWE-' || (p_partkey % 900 + 1)", LEVEL, "p_name", STATED))
def q_read_semgrep(spark, d):
    extra = s(message=F.col("p_name"), severity=level(), metadata=s(confidence=sure(), cwe=F.array(F.concat(F.lit("CWE-0"), F.expr("cast(p_partkey % 900 + 1 as string)"), F.lit(": x")))))
    item = s(check_id=rule(), path=F.concat(F.lit("src\\"), F.col("p_brand")), start=s(line=F.col("p_size")), extra=extra)
    return part(P.semgrep(texts(spark, d, item, json_of(results=lambda i: i))))


@query(finding_sql("bandit", RULE, "p_type", "p_brand", "p_size", "'CWE-' || p_size", LEVEL, "p_name", STATED))
def q_read_bandit(spark, d):
    item = s(filename=F.col("p_brand"), line_number=F.col("p_size"), test_id=rule(), test_name=F.col("p_type"), issue_text=F.col("p_name"), issue_severity=F.upper(level()), issue_confidence=sure(), issue_cwe=s(id=F.col("p_size")))
    return part(P.bandit(texts(spark, d, item, json_of(results=lambda i: i))))


@query(finding_sql("gitleaks", RULE, "p_name", "p_brand", "p_size", "'CWE-798'", "'high'", "'[REDACTED]'"))
def q_read_gitleaks(spark, d):
    item = s(RuleID=rule(), Description=F.col("p_name"), File=F.col("p_brand"), StartLine=F.col("p_size"), Secret=F.lit("hunter2"), Match=F.lit("password=hunter2"))
    return part(P.gitleaks(texts(spark, d, item, F.to_json)))


@query(finding_sql("checkov", RULE, "p_name", "'/' || p_brand", "p_size", "''", LEVEL, "p_type"))
def q_read_checkov(spark, d):
    item = s(check_id=rule(), check_name=F.col("p_name"), file_path=F.concat(F.lit("/"), F.col("p_brand")), file_line_range=F.array("p_size", F.col("p_size") + 3), resource=F.col("p_type"), severity=F.upper(level()))
    return part(P.checkov(texts(spark, d, item, json_of(results=lambda i: s(failed_checks=i)))))


@query(finding_sql("nuclei", RULE, "p_name", "'https://h/' || p_partkey", "NULL::INTEGER", "''", LEVEL, "p_type"))
def q_read_nuclei(spark, d):
    """Odd reports are arrays, even ones a JSON object a line."""
    item = s(**{"template-id": rule(), "matched-at": F.concat(F.lit("https://h/"), F.col("p_partkey").cast("string")), "matcher-name": F.col("p_type"), "info": s(name=F.col("p_name"), severity=level())})
    lines = lambda i: F.when(F.regexp_extract("path", "([0-9])$", 1).cast("int") % 2 == 0, F.array_join(F.transform(i, lambda x: F.to_json(x)), "\n")).otherwise(F.to_json(i))
    return part(P.nuclei(texts(spark, d, item, lines)))


@query(finding_sql("pip-audit", "'PYSEC-' || p_partkey", "replace(p_name, ' ', '-') || ' ' || p_size || '.0'", "replace(p_name, ' ', '-')", "NULL::INTEGER", "''", "'high'", "'fixed in ' || (p_size + 1) || '.0'"))
def q_read_pip_audit(spark, d):
    size = F.col("p_size").cast("string")
    item = s(name=F.replace("p_name", F.lit(" "), F.lit("-")), version=F.concat(size, F.lit(".0")), vulns=F.array(s(id=F.concat(F.lit("PYSEC-"), F.col("p_partkey").cast("string")), description=F.col("p_type"), fix_versions=F.array(F.concat((F.col("p_size") + 1).cast("string"), F.lit(".0"))))))
    return part(P.pip_audit(texts(spark, d, item, json_of(dependencies=lambda i: i))))


@query(finding_sql("zap", RULE, "p_name", "'http://h/' || p_partkey", "NULL::INTEGER", "CASE WHEN p_size % 4 > 0 THEN 'CWE-' || (p_size % 4) ELSE '' END", "CASE p_partkey % 4 WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END", "'http://h/' || p_partkey"))
def q_read_zap(spark, d):
    at = F.concat(F.lit("http://h/"), F.col("p_partkey").cast("string"))
    item = s(pluginid=rule(), alert=F.col("p_name"), riskcode=F.expr("cast(p_partkey % 4 as string)"), cweid=F.expr("cast(p_size % 4 as string)"), instances=F.array(s(uri=at)))
    return part(P.zap(texts(spark, d, item, json_of(site=lambda i: F.array(s(alerts=i))))))


@query(finding_sql("scanner", RULE, "'Rule ' || (p_partkey % 3)", "'src/' || p_brand", "p_size", "'CWE-' || (p_partkey % 3 + 20)", "CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END", "p_name"))
def q_read_sarif(spark, d):
    stated = pick(("error", "warning", "note", "none"), "p_partkey % 4")
    place = F.array(s(physicalLocation=s(artifactLocation=s(uri=F.concat(F.lit("src/"), F.col("p_brand"))), region=s(startLine=F.col("p_size")))))
    item = s(ruleId=rule(), level=stated, message=s(text=F.col("p_name")), locations=place)
    rules = lambda i: F.transform(i, lambda x: s(id=x["ruleId"], name=F.concat(F.lit("Rule "), (F.regexp_extract(x["ruleId"], "([0-9]+)", 1).cast("long") % 3).cast("string")), properties=s(tags=F.array(F.lit("security"), F.concat(F.lit("external/cwe/cwe-0"), (F.regexp_extract(x["ruleId"], "([0-9]+)", 1).cast("long") % 3 + 20).cast("string"))))))
    run = lambda i: F.array(s(tool=s(driver=s(name=F.lit("Scanner"), rules=rules(i))), results=i))
    return part(P.sarif(texts(spark, d, item, json_of(runs=run))))


METHODS = ("GET", "post", "PUT", "delete", "head")
METHOD = pick_sql(METHODS, "p_partkey % 5")


def traffic_sql(source: str, method: str, route: str, status: str) -> str:
    return f"SELECT p_partkey AS part, '{source}' AS source, upper({method}) AS method, {route} AS route, {status} AS status, 'user' AS role, upper({method}) IN ('POST', 'PUT', 'PATCH', 'DELETE') AS mutation FROM part"


@query(traffic_sql("har", METHOD, "'https://h/p' || p_partkey", "200 + p_size"))
def q_read_har(spark, d):
    url = F.concat(F.lit("https://h/p"), F.col("p_partkey").cast("string"))
    item = s(request=s(method=pick(METHODS, "p_partkey % 5"), url=url, headers=F.array(s(name=F.lit("Cookie"), value=F.lit("secret")))), response=s(status=200 + F.col("p_size")))
    return part(P.har(texts(spark, d, item, json_of(log=lambda i: s(entries=i)))), "route")


@query(traffic_sql("openapi", METHOD, "'/p' || p_partkey", "NULL::INTEGER"))
def q_read_openapi(spark, d):
    item = s(k=F.concat(F.lit("/p"), F.col("p_partkey").cast("string")), v=F.map_from_arrays(F.array(F.lower(pick(METHODS, "p_partkey % 5")), F.lit("parameters")), F.array(s(operationId=F.col("p_name")), s(operationId=F.lit("none")))))
    return part(P.openapi(texts(spark, d, item, json_of(paths=lambda i: F.map_from_entries(i)))), "route")


@query("SELECT p_partkey AS part, 'arjun' AS source, 'GET' AS method, '/p' || p_partkey AS route, NULL::INTEGER AS status, 'user' AS role, false AS mutation, unnest(['id', 'q' || p_size]) AS param FROM part")
def q_read_arjun(spark, d):
    item = s(k=F.concat(F.lit("/p"), F.col("p_partkey").cast("string")), v=s(method=F.lit("GET"), params=F.array(F.lit("id"), F.concat(F.lit("q"), F.col("p_size").cast("string")))))
    return part(P.arjun(texts(spark, d, item, lambda i: F.to_json(F.map_from_entries(i)))), "route")


@query("SELECT 'pkg' || p_partkey AS name, p_size || '.1' AS version FROM part WHERE p_partkey % 2 = 0")
def q_read_requirements(spark, d):
    line = F.expr("concat('Pkg', p_partkey, case when p_partkey % 2 = 0 then '==' else '>=' end, p_size, '.1  # c')")
    return P.requirements(texts(spark, d, line, lambda i: F.array_join(i, "\n"))).select("name", "version")
