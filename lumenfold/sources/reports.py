"""Reports of scanners and captures of traffic as tables: every reader takes (path, text), a row per report file, and
gives rows of one model. Malformed reports give no rows; `broken` lists them.

Findings: source, rule_id, title, file, line, cwe, severity, confidence, evidence. Observations: source, method, route,
status, role, mutation. Secrets and header values are never carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.scores import cwe_name, lookup, truthy
from lumenfold.operators.audit import TOOL_CONFIDENCE

# Fixed values.
MUTATING = ("POST", "PUT", "PATCH", "DELETE")
ZAP_RISK = {"3": "high", "2": "medium", "1": "low", "0": "info"}

SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<cwe:array<string>,confidence:string>>>>>"
BANDIT = "struct<results:array<struct<filename:string,line_number:int,test_id:string,test_name:string,issue_text:string,issue_severity:string,issue_confidence:string,issue_cwe:struct<id:int>>>>"
GITLEAKS = "array<struct<RuleID:string,Description:string,File:string,StartLine:int>>"
CHECK = "struct<check_id:string,check_name:string,file_path:string,file_line_range:array<int>,resource:string,severity:string>"
CHECKOV = f"struct<results:struct<failed_checks:array<{CHECK}>>>"
CHECKOV_LIST = f"struct<results:array<struct<failed_checks:array<{CHECK}>>>>"
NUCLEI = "struct<`template-id`:string,`matched-at`:string,`matcher-name`:string,info:struct<name:string,severity:string,description:string>>"
PIP_AUDIT = "struct<dependencies:array<struct<name:string,version:string,vulns:array<struct<id:string,description:string,fix_versions:array<string>>>>>>"
ZAP_ALERT = "struct<pluginid:string,alert:string,name:string,riskcode:string,cweid:string,url:string,instances:array<struct<uri:string>>>"
ZAP = f"struct<alerts:array<{ZAP_ALERT}>,site:array<struct<alerts:array<{ZAP_ALERT}>>>>"
SARIF_RESULT = "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
SARIF = f"struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,properties:struct<tags:array<string>>>>>>,results:array<{SARIF_RESULT}>>>>"
HAR = "struct<log:struct<entries:array<struct<startedDateTime:string,request:struct<method:string,url:string>,response:struct<status:int>>>>>"
OPENAPI = "struct<paths:map<string,map<string,struct<operationId:string>>>>"
ARJUN = "map<string,struct<method:string,params:array<string>>>"
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")


def reports(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def broken(raw: DataFrame) -> DataFrame:
    """Paths whose text isn't JSON."""
    return raw.filter(F.try_parse_json("text").isNull()).select("path")


def _each(raw: DataFrame, schema: str, field: str | None = None) -> DataFrame:
    parsed = F.from_json("text", schema)
    return raw.select(F.explode(parsed[field] if field else parsed).alias("x"))


def finding(source: str | Column, rule: Column, title: Column, file: Column, line: Column, cwe: Column, severity: Column, evidence: Column, sure: Column | None = None) -> list[Column]:
    """The columns of a finding; a tool's own confidence, where it states one, comes before its severity."""
    level = F.lower(F.coalesce(severity, F.lit("")))
    stated = level if sure is None else F.lower(truthy(sure, level))
    return [
        (F.lit(source) if isinstance(source, str) else source).alias("source"), F.coalesce(rule, F.lit("")).alias("rule_id"), F.coalesce(title, F.lit("")).alias("title"),
        F.replace(F.coalesce(file, F.lit("")), F.lit("\\"), F.lit("/")).alias("file"), line.cast("int").alias("line"), F.coalesce(cwe, F.lit("")).alias("cwe"),
        level.alias("severity"), lookup(stated, TOOL_CONFIDENCE, 0.5).alias("confidence"), F.coalesce(evidence, F.lit("")).alias("evidence"),
    ]


def semgrep(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    cwe = cwe_name(F.get(x["extra"]["metadata"]["cwe"], 0))
    return _each(raw, SEMGREP, "results").select(*finding("semgrep", x["check_id"], x["extra"]["message"], x["path"], x["start"]["line"], cwe, x["extra"]["severity"], x["extra"]["message"], x["extra"]["metadata"]["confidence"]))


def bandit(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    cwe = F.concat(F.lit("CWE-"), x["issue_cwe"]["id"].cast("string"))
    return _each(raw, BANDIT, "results").select(*finding("bandit", x["test_id"], x["test_name"], x["filename"], x["line_number"], cwe, x["issue_severity"], x["issue_text"], x["issue_confidence"]))


def gitleaks(raw: DataFrame) -> DataFrame:
    """The secret and its match aren't even in the schema."""
    x = F.col("x")
    return _each(raw, GITLEAKS).select(*finding("gitleaks", x["RuleID"], x["Description"], x["File"], x["StartLine"], F.lit("CWE-798"), F.lit("high"), F.lit("[REDACTED]")))


def checkov(raw: DataFrame) -> DataFrame:
    x, one, many = F.col("x"), F.from_json("text", CHECKOV)["results"]["failed_checks"], F.flatten(F.from_json("text", CHECKOV_LIST)["results"]["failed_checks"])
    rows = raw.select(F.explode(F.coalesce(one, many)).alias("x"))
    return rows.select(*finding("checkov", x["check_id"], x["check_name"], x["file_path"], F.get(x["file_line_range"], 0), F.lit(""), x["severity"], x["resource"]))


def nuclei(raw: DataFrame) -> DataFrame:
    """An array, or a JSON object per line."""
    whole = F.from_json("text", f"array<{NUCLEI}>")
    lines = F.transform(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""), lambda s: F.from_json(s, NUCLEI))
    rows = raw.select(F.explode(F.when(F.ltrim("text").startswith("["), whole).otherwise(lines)).alias("x")).filter("x.`template-id` is not null")
    x = F.col("x")
    return rows.select(*finding("nuclei", x["template-id"], x["info"]["name"], x["matched-at"], F.lit(None), F.lit(""), x["info"]["severity"], F.coalesce(x["matcher-name"], x["info"]["description"])))


def pip_audit(raw: DataFrame) -> DataFrame:
    d = _each(raw, PIP_AUDIT, "dependencies").select("x.name", "x.version", F.explode("x.vulns").alias("x"))
    x = F.col("x")
    title = F.concat_ws(" ", F.col("name"), F.col("version"))
    return d.select(*finding("pip-audit", x["id"], title, F.col("name"), F.lit(None), F.lit(""), F.lit("high"), F.concat(F.lit("fixed in "), F.array_join(x["fix_versions"], ","))))


def zap(raw: DataFrame) -> DataFrame:
    parsed = F.from_json("text", ZAP)
    sites = F.flatten(F.transform(parsed["site"], lambda s: F.coalesce(s["alerts"], F.array().cast(f"array<{ZAP_ALERT}>"))))
    none = F.array().cast(f"array<{ZAP_ALERT}>")
    rows = raw.select(F.explode(F.concat(F.coalesce(parsed["alerts"], none), F.coalesce(sites, none))).alias("x"))
    x = F.col("x")
    at = F.coalesce(F.get(x["instances"], 0)["uri"], x["url"])
    cwe = F.when(x["cweid"].cast("int") > 0, F.concat(F.lit("CWE-"), x["cweid"]))
    return rows.select(*finding("zap", x["pluginid"], truthy(x["alert"], x["name"]), at, F.lit(None), cwe, lookup(x["riskcode"], ZAP_RISK, "info"), at))


def sarif(raw: DataFrame) -> DataFrame:
    """Results with the rule of their run that has their id; levels become severities."""
    runs = _each(raw, SARIF, "runs").select("x.tool.driver.name", "x.tool.driver.rules", F.explode("x.results").alias("x"))
    x = F.col("x")
    rule = F.get(F.filter("rules", lambda r: r["id"] == x["ruleId"]), 0)
    cwe = cwe_name(F.get(F.filter(rule["properties"]["tags"], lambda t: F.lower(t).contains("cwe")), 0))
    place = F.get(x["locations"], 0)["physicalLocation"]
    level = lookup(x["level"], {"error": "high", "warning": "medium", "note": "low", "none": "info"}, "medium")
    return runs.select(*finding(F.lower(F.coalesce("name", F.lit("sarif"))), x["ruleId"], F.coalesce(rule["name"], x["ruleId"]), place["artifactLocation"]["uri"], place["region"]["startLine"], cwe, level, x["message"]["text"]))


def observation(source: str, method: Column, route: Column, status: Column) -> list[Column]:
    name = F.upper(F.coalesce(method, F.lit("GET")))
    return [F.lit(source).alias("source"), name.alias("method"), F.coalesce(route, F.lit("")).alias("route"), status.cast("int").alias("status"), F.lit("user").alias("role"), name.isin(*MUTATING).alias("mutation")]


def har(raw: DataFrame) -> DataFrame:
    x = F.col("x")
    entries = raw.select(F.explode(F.from_json("text", HAR)["log"]["entries"]).alias("x")).filter("x.request.url is not null")
    return entries.select(*observation("har", x["request"]["method"], x["request"]["url"], x["response"]["status"]))


def openapi(raw: DataFrame) -> DataFrame:
    paths = raw.select(F.explode(F.from_json("text", OPENAPI)["paths"]).alias("route", "ops")).select("route", F.explode("ops").alias("method", "op"))
    return paths.filter(F.lower("method").isin(*METHODS)).select(*observation("openapi", F.col("method"), F.col("route"), F.lit(None)))


def arjun(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.explode(F.from_json("text", ARJUN)).alias("route", "x")).select("route", "x.method", F.explode("x.params").alias("param"))
    return rows.select(*observation("arjun", F.col("method"), F.col("route"), F.lit(None)), "param")


def burp(spark: SparkSession, path: str) -> DataFrame:
    """Items of an XML export, by the built-in reader; bodies stay behind."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("method string, url string, status int").load(path)
    return rows.select(*observation("burp", F.col("method"), F.col("url"), F.col("status")))


READERS = {"semgrep": semgrep, "bandit": bandit, "gitleaks": gitleaks, "checkov": checkov, "nuclei": nuclei, "pip-audit": pip_audit, "zap": zap, "sarif": sarif}
TRAFFIC = {"har": har, "openapi": openapi, "arjun": arjun}


def requirements(raw: DataFrame) -> DataFrame:
    """(name, version, path) of pinned requirements, each once."""
    from lumenfold.functions.scores import pinned

    pins = raw.select("path", F.explode(F.split("text", "\n")).alias("line")).select("path", pinned(F.col("line")).alias("p")).filter("p is not null")
    return pins.select("p.name", "p.version", "path").distinct()
