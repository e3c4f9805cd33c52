"""The library against hand-made rows and, for every query with SQL, against DuckDB on the smallest tables."""

import json
import math
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import scores as S
from lumenfold.operators import graphs as G
from lumenfold.operators import metrics as M
from lumenfold.operators import relational as R
from lumenfold.plans import catalog
from lumenfold.sources import reports
from lumenfold.streaming import feedback

DATA = "/root/testdata/sf0.001"


def value_of(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime)):
        return v
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return float(f"{float(v):.9g}")


def assert_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    want = sorted(([plain(v) for v in r] for r in found.fetchall()), key=key)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == catalog.__name__ and n in catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    assert_matches_sql(spark, duck, name)


def test_cuts_and_lookups(spark):
    x = F.lit(0.85)
    assert value_of(spark, S.cut(x, S.SEVERITY_CUTS, "info")) == "high"
    assert value_of(spark, S.cut(F.lit(None).cast("double"), S.SEVERITY_CUTS, "info")) == "info"
    assert value_of(spark, S.lookup(F.lit(22), S.CWE_SEVERITY, S.CWE_DEFAULT)) == 0.85
    assert value_of(spark, S.lookup(F.lit(1), S.CWE_SEVERITY, S.CWE_DEFAULT)) == 0.5
    assert value_of(spark, S.truthy(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert value_of(spark, S.additive([(F.lit(True), 70), (F.lit(True), 20), (F.lit(None).cast("boolean"), 9)], 0, 79)) == 79
    assert value_of(spark, S.cwe_name(F.lit("cwe_0079: XSS"))) == "CWE-79" and value_of(spark, S.cwe_name(F.lit("none"))) is None


def test_texts_to_parts(spark):
    assert value_of(spark, S.pinned(F.lit("Flask[async]==2.0.1 ; python_version"))).asDict() == {"name": "flask", "version": "2.0.1"}
    assert value_of(spark, S.pinned(F.lit("flask>=2"))) is None
    assert value_of(spark, S.route_params(F.lit("/u/<int:user_id>/{post}"))) == ["user_id", "post"]
    assert value_of(spark, S.key_of(F.lit(" A  b"), F.lit(None))) == value_of(spark, S.key_of(F.lit("a B"), F.lit("")))
    assert value_of(spark, S.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0.0


def test_wilson_and_least_successes(spark):
    low, high = S.wilson(F.lit(8), F.lit(10))
    assert round(value_of(spark, low), 4) == 0.4902 and round(value_of(spark, high), 4) == 0.9433
    low, high = S.wilson(F.lit(0), F.lit(0))
    assert (value_of(spark, low), value_of(spark, high)) == (0.0, 0.0)
    need = M.least_successes(spark.createDataFrame([(10,), (2,)], "total long"), "total", 0.5).collect()
    assert {r["total"]: r["needed"] for r in need} == {10: 9, 2: None}


def test_dedupes_keep_the_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, "w")], "k string, n int, v string")
    for got in (R.first_wins(df, ["k"], ["n"]), R.first_by(df, ["k"], ["n"])):
        assert sorted(((r["k"], r["v"]) for r in got.collect()), key=str) == [("a", "y"), (None, "w")]


def test_nearest_and_spans(spark):
    p = spark.createDataFrame([(1, "g", 10), (2, "g", 14), (3, "h", 5)], "id int, g string, at long")
    t = spark.createDataFrame([(7, "g", 12), (8, "g", 8), (9, "g", 15)], "tid int, g string, at long")
    assert {r["id"]: r["nearest_id"] for r in R.nearest(p, t, "g", "at", "tid").collect()} == {1: 8, 2: 9, 3: None}
    s = spark.createDataFrame([("g", 9, 13, "s"), ("g", 0, 100, "u"), ("h", 6, 9, "w")], "g string, lo long, hi long, name string")
    assert sorted((r["id"], r["name"]) for r in R.in_spans(p, s, "g", "at", "lo", "hi", 4).collect()) == [(1, "s"), (1, "u"), (2, "u")]


def test_near_names(spark):
    names = ["flask", "flaks", "flasks", "flak", "flasq", None, "x", "", "flask"]
    got = {tuple(r) for r in R.near_names(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            line = _step(line, i, x, b)
        return line[-1]

    def _step(line, i, x, b):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(line[j + 1] + 1, new[j] + 1, line[j] + (x != y)))
        return new

    every = {n for n in names if n is not None}
    assert got == {(a, b) for a in every for b in every if a < b and distance(a, b) == 1}


def test_upsert_adds_up(spark):
    at = datetime(2024, 1, 1)
    new = spark.createDataFrame([("a", at, False), ("a", at + timedelta(1), True)], "k string, at timestamp, validated boolean")
    state = spark.createDataFrame([("a", 3, at - timedelta(1), at, False)], "k string, seen long, first_at timestamp, last_at timestamp, validated boolean")
    assert tuple(R.upsert(state, new, "k").first()) == ("a", 5, at - timedelta(1), at + timedelta(1), True)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 6), (6, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r["node"]: r["root"] for r in G.clusters(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert sorted(r["cycle"] for r in G.short_cycles(e).collect()) == [[1, 2, 3], [4], [5, 6]]
    assert {r["node"]: r["depth"] for r in G.depths(e, nodes.filter("node = 1")).collect()} == {1: 0, 2: 1, 3: 2}


def test_simple_cycles_of_any_length(spark):
    ring = [(i, i % 5 + 1) for i in range(1, 6)]
    rows = [*ring, ring[0], (2, 1), (5, 2), (5, 6), (6, 7), (7, 8), (8, 6), (9, 9), (8, 10), (10, 11), (None, 1), (1, None)]
    nexts = {a: sorted({y for x, y in rows if x == a and y}) for a in range(1, 12)}
    walk = lambda p: [c for y in nexts[p[-1]] for c in ([p] if y == p[0] else walk([*p, y]) if y > p[0] and y not in p else [])]
    want = sorted(c for a in nexts for c in walk([a]))
    e = spark.createDataFrame(rows, "src long, dst long")
    assert [1, 2, 3, 4, 5] in want and sorted(r["cycle"] for r in G.simple_cycles(e).collect()) == want
    assert G.simple_cycles(e.filter("src < 0")).count() == 0


def test_propagation_against_a_loop(spark):
    conf = {1: 0.9, 2: 0.5, 3: 0.2}
    rel = [(1, 2, "SUPPORTS", 1.0), (2, 3, "CONTRADICTS", 0.0), (3, 1, "OTHER", 0.5)]
    logit = lambda p: math.log(p / (1 - p))
    prior = {k: logit(v) for k, v in conf.items()}
    x, pull = dict(prior), {"SUPPORTS": 1.0, "CONTRADICTS": -1.0, "OTHER": 0.3}
    for _ in range(50):
        got = dict.fromkeys(x, 0.0)
        for s, t, r, w in rel:
            got[t] += pull[r] * (w or 1.0) * x[s]
        new = {k: max(-8, min(8, 0.9 * (x[k] + 0.15 * got[k]) + 0.1 * prior[k])) for k in x}
        step = max(abs(1 / (1 + math.exp(-new[k])) - 1 / (1 + math.exp(-x[k]))) for k in x)
        x = new
        if step <= 1e-3:
            break
    df = G.propagate(spark.createDataFrame(list(conf.items()), "node long, confidence double"), spark.createDataFrame(rel, "src long, dst long, relation string, weight double"))
    for r in df.collect():
        assert abs(r["confidence"] - 1 / (1 + math.exp(-x[r["node"]]))) < 1e-9


def test_propagation_query_takes_every_supplier(spark, tmp_path):
    spark.createDataFrame([(i, 1) for i in range(1, 151)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(tuple(r) for r in catalog.all_edges(spark, str(tmp_path)).collect()) == [(i, i * 7 % 151) for i in range(1, 151)]
    got = {r["node"]: r["confidence"] for r in catalog.q_propagation(spark, str(tmp_path)).collect()}
    assert len(got) == 150 and any(abs(c - (0.05 + 0.9 * (i % 17) / 17)) > 0.01 for i, c in got.items())


def raw(spark, payload):
    return spark.createDataFrame([("r.json", payload if isinstance(payload, str) else json.dumps(payload))], "path string, text string")


def test_report_readers(spark):
    one = lambda name, payload: [r.asDict() for r in reports.READERS[name](raw(spark, payload)).collect()]
    got = one("semgrep", {"results": [{"check_id": "r1", "path": "a\\b.py", "start": {"line": 3}, "extra": {"message": "m", "severity": "ERROR", "metadata": {"cwe": ["CWE-89: SQL"]}}}]})
    assert got == [{"source": "semgrep", "rule_id": "r1", "title": "m", "file": "a/b.py", "line": 3, "cwe": "CWE-89", "severity": "error", "confidence": 0.85, "evidence": "m"}]
    assert one("bandit", {"results": [{"filename": "f", "line_number": 1, "test_id": "B1", "issue_cwe": {"id": 94}, "issue_severity": "LOW"}]})[0]["cwe"] == "CWE-94"
    leak = one("gitleaks", [{"RuleID": "k", "File": "f", "StartLine": 2, "Secret": "hunter2", "Match": "hunter2"}])
    assert leak[0]["rule_id"] == "k" and "hunter2" not in json.dumps(leak)
    check = {"check_id": "C1", "file_path": "/m.tf", "file_line_range": [4, 9]}
    assert [r["line"] for p in ({"failed_checks": [check]}, [{"failed_checks": [check]}]) for r in one("checkov", {"results": p})] == [4, 4]
    hit = {"template-id": "t", "matched-at": "http://x/y", "info": {"name": "n", "severity": "medium"}}
    assert [len(one("nuclei", p)) for p in (json.dumps([hit, hit]), json.dumps(hit) + "\n\n" + json.dumps(hit))] == [2, 2]
    assert len(one("pip-audit", {"dependencies": [{"name": "a", "version": "1", "vulns": [{"id": "V1", "fix_versions": ["2"]}, {"id": "V2"}]}, {"name": "b", "vulns": []}]})) == 2
    alert = {"pluginid": "1", "alert": "A", "riskcode": "3", "cweid": "79", "instances": [{"uri": "http://u"}]}
    assert {(r["severity"], r["cwe"], r["file"]) for r in one("zap", {"alerts": [alert], "site": [{"alerts": [alert]}]})} == {("high", "CWE-79", "http://u")}
    place = [{"physicalLocation": {"artifactLocation": {"uri": "s.py"}, "region": {"startLine": 7}}}]
    tool = {"driver": {"name": "CodeQL", "rules": [{"id": "q", "name": "N", "properties": {"tags": ["external/cwe/cwe-022"]}}]}}
    got = one("sarif", {"runs": [{"tool": tool, "results": [{"ruleId": "q", "level": "error", "message": {"text": "t"}, "locations": place}]}]})[0]
    assert (got["source"], got["title"], got["cwe"], got["line"], got["severity"]) == ("codeql", "N", "CWE-22", 7, "high")
    assert all(one(name, "not json") == [] for name in reports.READERS)
    assert [r["path"] for r in reports.broken(raw(spark, "{")).collect()] == ["r.json"]


def test_traffic_readers(spark, tmp_path):
    entry = {"request": {"method": "post", "url": "http://h/a", "headers": [{"name": "Cookie", "value": "s3"}]}, "response": {"status": 201}}
    r = reports.har(raw(spark, {"log": {"entries": [entry, {"request": {}}]}})).collect()
    assert [(x["method"], x["status"], x["mutation"]) for x in r] == [("POST", 201, True)]
    r = reports.openapi(raw(spark, {"paths": {"/a": {"get": {"operationId": "g"}, "delete": {}, "parameters": {}}}})).collect()
    assert {(x["method"], x["mutation"]) for x in r} == {("GET", False), ("DELETE", True)}
    assert len(reports.arjun(raw(spark, {"http://h": {"method": "GET", "params": ["a", "b"]}})).collect()) == 2
    (tmp_path / "b.xml").write_text("<items><item><method>GET</method><url>http://h/x</url><status>200</status><request>Authorization: Bearer k</request></item></items>")
    assert [(x["route"], x["status"]) for x in reports.burp(spark, str(tmp_path / "b.xml")).collect()] == [("http://h/x", 200)]
    pins = reports.requirements(raw(spark, "Flask==2.0\nflask==2.0\nx>=1\n")).collect()
    assert [(p["name"], p["version"]) for p in pins] == [("flask", "2.0")]


def test_streams(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, "a", at, 1.0), (1, "a", at, 1.0), (2, "a", at + timedelta(minutes=90), 2.0), (3, "b", at + timedelta(days=2), 3.0)]
    schema = "id long, kind string, at timestamp, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, make in {"once": lambda s: feedback.once(s, "id", "at"), "win": lambda s: feedback.windowed(s, "at", "kind", "value"), "ses": lambda s: feedback.sessions(s, "at", "kind")}.items():
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["id"] for r in spark.sql("select id from once").collect()) == [1, 2, 3]
    assert sorted((r["kind"], r["n"]) for r in spark.sql("select * from win").collect()) == [("a", 1), ("a", 2)]
    assert sorted((r["kind"], r["n"]) for r in spark.sql("select * from ses").collect()) == [("a", 1), ("a", 2)]
    batch = spark.createDataFrame([("a", at, True)], "k string, at timestamp, validated boolean")
    write = feedback.keep_state(str(tmp_path / "state"), "k")
    for number in (0, 1, 1):
        write(batch, number)
    assert spark.read.parquet(str(tmp_path / "state/1")).first()["seen"] == 2


def test_entry_works_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "lumenfold.llm", None)
    assert set(__spark_entry__.queries()) == set(catalog.queries())


def test_without_the_corpus_parts(tmp_path):
    """A copy without the corpus folders and the pipeline imports and lists the other queries; a broken part isn't absent."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "lumenfold", tmp_path / "lumenfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    n, ops, sql = run().stdout.split()
    assert int(n) > 100 and ops == "False" and int(sql) > 100
    (tmp_path / "lumenfold/llm").mkdir()
    (tmp_path / "lumenfold/llm/__init__.py").write_text("")
    (tmp_path / "lumenfold/llm/registry.py").write_text("import a_module_that_is_not_there")
    assert "a_module_that_is_not_there" in run().stderr
