"""Advisory feeds, version ranges, page chains and scopes."""

import json
from datetime import datetime

from lumenfold.sources import advisories as A


def raw(spark, payload):
    return spark.createDataFrame([("f", json.dumps(payload))], "path string, text string")


def test_feeds(spark):
    r = A.osv(raw(spark, {"vulns": [{"id": "O1", "summary": "s", "aliases": ["CVE-1"], "affected": [{"package": {"name": "Flask"}}, {"package": {"name": "x"}}]}]})).collect()
    assert {(x["id"], x["package"]) for x in r} == {("O1", "flask"), ("O1", "x")}
    assert A.kev(raw(spark, {"vulnerabilities": [{"cveID": "CVE-2", "product": "P", "dateAdded": "2024-01-01"}]})).first()["package"] == "p"
    cve = {"id": "CVE-3", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "yes"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseSeverity": "HIGH"}}]}}
    r = A.nvd(raw(spark, {"vulnerabilities": [{"cve": cve}]})).first()
    assert (r["summary"], r["severity"]) == ("yes", "high")
    r = A.github(raw(spark, [{"ghsa_id": "G", "cve_id": "CVE-4", "severity": "low", "vulnerabilities": []}, {"ghsa_id": "H"}])).collect()
    assert [(x["id"], x["aliases"]) for x in r] == [("G", ["CVE-4"]), ("H", [])]


def test_versions(spark):
    yes = [("1.2", "<2"), ("1.10", ">1.9,<=1.10"), ("2.0", "==2"), ("2.0rc1", "<2.0"), ("1.4.5", "~=1.4.2"), ("1.4", "==1.*"), ("odd", "odd-one"), ("1.0", "!=1.1")]
    no = [("2.0", "<2"), ("1.5.0", "~=1.4.2"), ("2.0", "==1.*"), (None, "<1"), ("1", None), ("odd", "<1")]
    assert all(A.within(*x) for x in yes) and not any(A.within(*x) for x in no)
    pins = spark.createDataFrame([("Flask", "1.0"), ("x", "9")], "name string, version string")
    ranges = spark.createDataFrame([("flask", "A1", 0, ">3"), ("flask", "A1", 2, "<2"), ("flask", "A1", 1, "<1.5"), ("x", "A2", 0, "<9")], "package string, advisory string, place int, spec string")
    assert [tuple(r) for r in A.vulnerable(pins, ranges).collect()] == [("Flask", "1.0", "A1", "<1.5")]


def test_page_chains(spark):
    at = datetime(2024, 1, 2)
    rows = [("a", 0, 0, 10, 25, at), ("a", 1, 10, 10, 25, at), ("a", 2, 20, 5, 25, at), ("b", 0, 0, 10, 25, at), ("b", 1, 12, 10, 26, datetime(2024, 1, 1))]
    got = A.chain_faults(spark.createDataFrame(rows, "run string, page int, first int, n int, total int, fetched_at timestamp"), "run").collect()
    assert {(r["run"], r["page"], r["fault"]) for r in got} == {("b", 1, "gap"), ("b", 1, "total_changed"), ("b", 1, "time_went_back")}


def test_scope(spark):
    targets = spark.createDataFrame([("http://a/x/1",), ("http://a/xy",), ("http://a/x/no/2",), ("http://b",)], "target string")
    patterns = spark.createDataFrame([("http://a/x", True), ("http://a/x/no/", False)], "pattern string, included boolean")
    assert [r["target"] for r in A.in_scope(targets, "target", patterns).collect()] == ["http://a/x/1"]
