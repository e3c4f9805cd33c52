"""Bundles, access matrices, caches and evidence."""

import json

from pyspark.sql import functions as F

from lumenfold.operators import access as A
from lumenfold.operators import audit
from lumenfold.sources import bundles as B


def test_bundle(spark):
    payload = {
        "deltas": [{"id": "d1", "category": "auth", "vector": {"a": 0.2, "b": 0.95}, "file": "f", "line": 3}, {"id": "d2", "category": "x", "route": "/r"}],
        "verdicts": [{"delta_ref": "d1", "result": "refuted"}, {"delta_ref": "d1", "result": "confirmed"}, {"delta_ref": "d9", "result": "blocked"}],
        "conflicts": [{"delta_ref": "d2", "divergence_score": 0.5}],
        "chains": [{"chain_id": "c", "delta_refs": ["d2", "d7"]}],
    }
    raw = spark.createDataFrame([("p", json.dumps(payload)), ("q", "{"), ("r", "{}")], "path string, text string")
    got = {r["id"]: r for r in B.deltas(raw).collect()}
    assert (got["d1"]["severity"], got["d1"]["verdicts"], got["d1"]["outcome"], got["d1"]["n_conflicts"]) == ("critical", ["confirmed", "refuted"], "false_positive", 0)
    assert (got["d2"]["severity"], got["d2"]["file"], got["d2"]["outcome"], got["d2"]["n_conflicts"]) == ("info", "/r", "unresolved", 1)
    assert [(r["step"], r["ref"], r["category"], r["known"]) for r in B.chains(raw).orderBy("step").collect()] == [(0, "d2", "x", True), (1, "d7", None, False)]


def test_access(spark):
    seen = spark.createDataFrame([("/a", None, None, 200, 1), ("/a", "GET", "user", 403, 2), ("/a", "GET", "admin", 200, 3)], "route string, method string, role string, status int, seq int")
    assert tuple(A.matrix(seen, ["admin", "user"]).first()) == ("/a", "GET", 200, 403)
    row = spark.range(1).select(audit.guard_class(F.lit("obj.OWNER_ID == me")).alias("a"), audit.guard_class(F.lit("x")).alias("b")).first()
    assert (row["a"], row["b"]) == ("ownership_guard", None)
    src = spark.createDataFrame([("a",), (None,), ("b",)], "text string")
    cache = src.filter("text = 'a'").select(F.sha2("text", 256).alias("digest"), F.lit("r").alias("result"))
    hits, misses = A.cached(src, cache, "text")
    assert [r["result"] for r in hits.collect()] == ["r"] and misses.count() == 2


def test_evidence_and_learning(spark):
    e = [("a", True, True, True), ("b", True, True, None), ("c", True, True, True), ("c", False, False, False), ("d", False, False, True)]
    got = {r["s"]: r["outcome"] for r in A.decided(spark.createDataFrame(e, "s string, required boolean, primary boolean, result boolean"), "s").collect()}
    assert got == {"a": "enforced", "b": "inconclusive", "c": "bypassed", "d": "inconclusive"}
    b = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.5), (4, 0.5)], "id int, confidence double")
    v = spark.createDataFrame([(1, "confirmed"), (2, "refuted"), (3, "inconclusive")], "id int, verdict string")
    got = {r["id"]: (round(r["confidence"], 9), r["reward"]) for r in A.learned(b, v, "id").collect()}
    assert got == {1: (0.99, 1.0), 2: (0.01, 0.0), 3: (0.5, 0.3), 4: (0.5, None)}
