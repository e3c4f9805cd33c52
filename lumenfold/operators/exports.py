"""Exports as rows of JSON or Markdown, one row an entry, so that a table of any size is written by Spark's text writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scores as S

#: Parameter names that are worth a try on any target (fixed values).
PARAMETERS = (
    "account_id", "admin", "amount", "balance", "credit", "discount", "is_admin", "org_id", "organization_id", "owner_id", "payment_status", "permission", "plan", "price", "project_id", "quota",
    "role", "roles", "scope", "state", "status", "tenant_id", "user_id",
)


def vulnerabilities(findings: DataFrame) -> DataFrame:
    """(file, line, rule_id, entry) of findings, to be written in that order."""
    data = F.struct("rule_id", "file", "line", "evidence")
    refs = F.array_compact(F.array(F.nullif("cwe", F.lit(""))))
    entry = F.struct(F.col("title").alias("name"), S.truthy(F.col("message"), F.col("title")).alias("desc"), S.truthy(F.col("severity"), F.lit("info")).alias("severity"), F.lit("Vulnerability").alias("type"), F.col("source").alias("tool"), refs.alias("refs"), data.alias("data"))
    return findings.select("file", "line", "rule_id", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def access_requests(seen: DataFrame) -> DataFrame:
    """(path, method, role, entry) of observations (method, path, role, guards, missing arrays, mutation): whether each role
    is expected to be let in. Secrets aren't among the columns that are read."""
    named = seen.withColumns({"role": S.truthy(F.col("role"), F.lit("user")), "method": S.truthy(F.col("method"), F.lit("GET")), "path": F.coalesce("path", F.lit(""))})
    entry = F.struct("method", "path", "role", (F.size("missing") == 0).alias("expected_allowed"), F.col("guards").alias("detected_guards"), F.col("missing").alias("missing_guards"), "mutation")
    return named.select("path", "method", "role", F.to_json(entry).alias("entry"))


def parameter_words(words: DataFrame, column: str) -> DataFrame:
    """The fixed names and those seen, each once."""
    fixed = words.sparkSession.createDataFrame([(w,) for w in PARAMETERS], "word string")
    return words.select(F.col(column).alias("word")).filter("word <> ''").union(fixed).distinct()


def case_lines(cases: DataFrame) -> DataFrame:
    """(case_id, lines) of a Markdown report: a heading and a list for each case."""
    place = F.concat(F.lit("`"), F.col("file"), F.lit(":"), F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit("`"))
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("case_type")), F.concat(F.lit("- Status: "), F.col("status")), F.concat(F.lit("- Priority: "), F.col("priority")), F.concat(F.lit("- Place: "), place))
    return cases.select("case_id", body.alias("lines"))
