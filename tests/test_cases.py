"""Cases from findings, and table functions over source text."""

import json

from pyspark.sql import functions as F

from lumenfold.functions import source_code as C
from lumenfold.operators import cases as K

FINDING = "source string, rule_id string, title string, file string, line int, cwe string, severity string, confidence double, evidence string"


def test_cases(spark):
    rows = [
        ("semgrep", "r1", "SQL built by hand", "app/a.py", 12, "CWE-89", "high", 0.85, ""), ("bandit", "B608", "hardcoded sql", "app/a.py", 17, "", "medium", 0.65, ""),
        ("bandit", "B608", "hardcoded sql", "app/a.py", 17, "", "medium", 0.65, ""), ("zap", "z", "Cross-site scripting", "tests/t.py", None, "CWE-79", "low", 0.35, ""), ("x", "y", "", "", None, "", "", 0.5, ""),
    ]
    got = K.cases(spark.createDataFrame(rows, FINDING))
    assert [r["category"] for r in got.collect()] == ["sql_injection", "sql_injection", "sql_injection", "xss", "unknown"]
    first = K.first_cases(got)
    assert first.count() == 4
    assert [r["rule_id"] for r in first.orderBy(*K.case_order()).collect()] == ["r1", "B608", "y", "z"]
    merged = K.scored(K.correlated(first))
    by = {(r["category"], r["file"]): r for r in merged.collect()}
    a = by["sql_injection", "app/a.py"]
    assert (a["tools"], a["line"], a["status"], a["confidence"], a["score"], a["verdict"]) == (["bandit", "semgrep"], 12, "actionable", 0.85, 15, "likely_false_positive")  # 10 + 15 + 10 - 20 for want of a route or flow
    assert by["xss", "tests/t.py"]["status"] == "false_positive_likely" and by["xss", "tests/t.py"]["score"] == 0
    proven = {r["category"]: r["score"] for r in K.scored(K.correlated(first), F.col("category") == "sql_injection").collect()}
    assert proven["sql_injection"] == 35
    report = json.loads(K.sarif(first))
    results = report["runs"][0]["results"]
    assert [r["ruleId"] for r in results] == ["sql_injection", "sql_injection", "unknown", "xss"] and [r["ruleIndex"] for r in results] == [0, 0, 1, 2]
    row = json.loads(K.training_rows(merged).first()["row"])
    assert [m["role"] for m in row["messages"]] == ["system", "user", "assistant"]
    routes = spark.createDataFrame([("app/a.py", "/u", 10, 14), ("app/a.py", "/v", 30, 40), ("tests/t.py", "/w", 1, 2)], "file string, route string, start_line int, end_line int")
    got = {r["rule_id"]: (r["route"], r["route_confidence"]) for r in K.with_routes(first, routes).collect()}
    assert got == {"r1": ("/u", 0.9), "B608": (None, None), "z": ("/w", 0.55), "y": (None, None)}


SOURCE = '''
import os, requests
from . import models

PASSWORD = "hunter2"

class Shop:
    def total(self, n):
        return self.price() / n

    def price(self):
        return helper(1.0 == n)

def helper(x):
    requests.get("http://x", verify=False)
    try:
        cursor.execute(f"select {x}")
    except:
        eval(x)

@app.route("/users/<int:uid>")
def user(uid):
    return db.helper(uid)
'''


def test_source_code(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, source string")
    found = C.code_facts(files)
    assert {(r["name"], r["detail"]) for r in found.filter("kind = 'function'").collect()} == {("Shop.total", "2"), ("Shop.price", "1"), ("helper", "1"), ("user", "1")}
    assert [(r["target"], r["detail"]) for r in found.filter("kind = 'route'").collect()] == [("/users/<int:uid>", "GET")]
    assert {(r["target"], r["detail"]) for r in found.filter("kind = 'import'").collect()} == {("os", "absolute"), ("requests", "absolute"), ("", "relative")}
    assert [r["path"] for r in found.filter("kind = 'error'").collect()] == ["bad.py"]
    edges = {(r["src"], r["dst"]) for r in C.call_edges(found).collect()}
    assert edges == {("Shop.total", "Shop.price"), ("Shop.price", "helper"), ("user", "helper")}
    issues = {(r["name"], r["target"]) for r in C.code_issues(files).filter("kind = 'issue'").collect()}
    assert issues == {("hardcoded_secret", ""), ("unchecked_division", "Shop.total"), ("float_equality", "Shop.price"), ("missing_timeout", "helper"), ("unverified_tls", "helper"), ("built_query", "helper"), ("bare_except", "helper"), ("dangerous_call", "helper")}


def test_factors_come_from_other_tables(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case int")
    flows = spark.createDataFrame([(1, False), (1, True), (2, False)], "case int, ordered boolean")
    judged = spark.createDataFrame([(1, "ownership_guard", True, None), (1, "tenant_guard", False, "guard_after_sink"), (3, "role_authorization_guard", True, None)], "case int, guard_class string, applicable boolean, blocker string")
    proofs = spark.createDataFrame([(1, "a", "bypassed"), (1, "a", "bypassed"), (2, "a", "enforced"), (2, "b", "bypassed"), (3, "a", "enforced"), (3, "a", "bypassed"), (3, "b", "enforced"), (4, "a", None)], "case int, proof string, outcome string")
    got = {r["case"]: r for r in K.evidenced(df, "case", flows, judged, proofs).collect()}
    assert [(got[i]["codeflow"], got[i]["ordered_flow"], got[i]["strong_guard"], got[i]["admin_guard"]) for i in (1, 2, 3, 4)] == [(True, True, True, False), (True, False, False, False), (False, False, False, True), (False,) * 4]
    assert [(got[i]["outcome"], got[i]["quarantined"]) for i in (1, 2, 3, 4)] == [("bypassed", False), (None, True), ("enforced", True), (None, False)]
    assert got[1]["blockers"] == ["guard_after_sink"] and got[4]["blockers"] == []
    # Factors that are columns are taken from there.
    one = spark.createDataFrame([("ssrf", "a.py", 0, "actionable", "high", 0.9, 3, ["t", "u"], ["r"], ["c"])], "category string, file string, band long, status string, priority string, confidence double, line int, tools array<string>, rules array<string>, case_ids array<string>")
    score = lambda d: K.scored(d).first()["score"]
    assert score(one.withColumn("codeflow", F.lit(True)).withColumn("route", F.lit(None).cast("boolean"))) == score(one) + 20
    assert score(one.withColumn("nothing_found", F.lit(False)).withColumn("route", F.lit(True))) == score(one) + 35
