"""The audit rules: ordered cascades, relations of predicates, reportability, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import predicates
from lumenfold.operators import audit as A
from lumenfold.operators.relational import where
from lumenfold.plans import audit, catalog, exports, readers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [k for k, f in catalog.queries().items() if f.__module__ in (audit.__name__, readers.__name__, exports.__name__)])
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF), duck.execute(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


def test_relations(spark):
    pairs = [
        ("x > 1", "not x > 1", "contradicts"), ("not (x > 1)", "x > 1", "contradicts"), ("a == 1 or b == 2", "a != 1 or b != 2", "contradicts"), ("n in s", "n not in s", "contradicts"), ("token is validated", "token is tainted", "contradicts"),
        ("token is validated", "path is tainted", "mitigates"), ("a", "b", "supports"), ("", "not ", "supports"),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want string").select("*", A.relation(F.col("a"), F.col("b"), F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("got"))
    assert [r["got"] for r in df.collect()] == [w for _, _, w in pairs]
    none = spark.range(1).select(A.relation(F.lit("a"), F.lit("b"), F.array(F.lit(1)), F.array(F.lit(2))).alias("r")).first()
    assert none["r"] is None


def test_guards_and_surfaces(spark):
    df = spark.createDataFrame([("X", "Tenant_Guard "), ("login_required", "nonsense"), (None, None)], "e string, c string")
    assert [r[0] for r in df.select(A.guard_class(F.col("e"), F.col("c"))).collect()] == ["tenant_guard", "authentication_guard", None]
    paths = ["a\\Tests\\x.py", "pkg/test_a.py", "src/api/v.py", "debian/r", "alembic/versions/1.py", None, ""]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(A.runtime_surface(F.col("p"))).collect()
    assert [r[0] for r in got] == ["test", "test", "runtime_web", "deployment_or_packaging", "migration", "source", "source"]


def test_reportability_needs_a_proof(spark):
    names = [n for n, _ in A.REPORTABILITY]
    base = spark.range(1).select(*[F.lit(n not in ("strong_guard", "admin_guard", "skipped_path", "nothing_found", "static_only", "low_severity")).alias(n) for n in names], F.lit(False).alias("contradicted"), F.lit(2).alias("n_tools"), F.lit(True).alias("has_path"))
    for outcome, score, verdict in ((None, 79, "needs_manual_validation"), ("bypassed", 100, "reportable_candidate"), ("false_positive", 79, "needs_manual_validation")):
        r = A.reportability(base.withColumn("outcome", F.lit(outcome).cast("string"))).first()
        assert (r["score"], r["verdict"], r["confidence"]) == (score, verdict, "high")
    r = A.reportability(base.withColumns({"outcome": F.lit("bypassed"), "strong_guard": F.lit(True)})).first()
    assert r["verdict"] == "protected_by_guard"


def test_where_keeps_columns(spark):
    df = spark.range(5).withColumn("flag", F.col("id") % 2 == 0)
    assert [r["id"] for r in where(df, F.col("flag")).orderBy("id").collect()] == [0, 2, 4] and where(df, F.col("flag")).columns == df.columns


def test_predicates_outside_the_subset():
    for text in ("f(x)", "a + b", "a is None", "a ==", "", None, "1", "a if b else c", "x[1:2] == 3", "f(x).y"):
        assert predicates.rendered(text, True) is None and predicates.rendered(text, False) is None, text
    assert predicates.rendered("not (a and (b or not c))", False) == "not a or (not b and c)".replace("(", "").replace(")", "")
    assert predicates.rendered("a or (b or c)", True) == "not a and not b and not c" and predicates.rendered("x in s[0].t", True) == "x not in s[0].t"
