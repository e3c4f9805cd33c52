"""Block Lanczos against a dense eigensolver, and the whitened rows."""

import math

import numpy as np
import pytest

from lumenfold.llm import whitening


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, turns = np.linalg.eigh(centred.T @ centred / n)
    return x, n, ((n * x - total) ** 2).sum(axis=1), centred, values[::-1], turns[:, ::-1]


def check(spark, rows, wanted_rank, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = whitening.whitened(whitening.whole_vectors(df, "vec_id", "embedding")).collect()
    size = max((len(r[1]) for r in rows if r[1]), default=0)
    fit = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x, n, away, centred, values, turns = dense([list(r[1]) + [0.0] * (size - len(r[1])) for r in fit])
    assert len(got) == len(fit) * wanted_rank and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(wanted_rank):
        w = centred @ turns[:, c] / np.sqrt(values[c])
        mine = np.array([by[r[0], c + 1]["whitened"] for r in fit])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-9
        for r, d in zip(fit, away, strict=True):
            assert by[r[0], c + 1]["deviation"] == d and by[r[0], c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_equal_to_dense(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.float32(rnd.normal(size=40) * np.linspace(2, 0.3, 40))]) for i in range(500)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 38), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (None, rows[0][1]), (904, rows[1][1][:30]), (905, [])]
    check(spark, rows, 8)


def test_few_dimensions_and_few_rows(spark):
    rnd = np.random.default_rng(2)
    check(spark, [(i, [float(v) for v in np.float32(rnd.normal(size=3) * [3, 2, 1])]) for i in range(60)], 3)
    check(spark, [(i, [float(v) for v in np.float32(rnd.normal(size=50))]) for i in range(5)], 4)
    check(spark, [(i, [float(i == k) for k in range(4)] + [0.5]) for i in range(2)], 1)


def test_nothing_to_whiten(spark):
    make = lambda rows: whitening.whitened(whitening.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, n int"), "vec_id", "embedding"))
    for rows in ([], [(1, None, 0, 0)], [(1, [], 0, 0)], [(1, [1.0, 2.0], 0, 0)], [(i, [1.0, 2.0], 0, 0) for i in range(9)]):
        out = make(rows)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues_and_breakdown():
    """A matrix whose Krylov spaces end early: blocks break down and restart; copies of an eigenvalue are all found."""
    rnd = np.random.default_rng(3)
    for values in ([5.0] * 8 + [1.0] * 92, [9.0] * 3 + [4.0] * 12 + [0.0] * 85, [1.0] * 100, list(np.geomspace(1, 1e-9, 300)), [0.0] * 20):
        q, _ = np.linalg.qr(rnd.normal(size=(len(values), len(values))))
        a = (q * values) @ q.T
        found, turns = whitening.lanczos(lambda b, a=a: a @ b, len(values), 8)
        assert np.allclose(found, sorted(values, reverse=True)[:8], atol=1e-12) and np.allclose(turns.T @ turns, np.eye(8), atol=1e-12)
        assert np.abs(a @ turns - turns * found).max() < 1e-12


def test_exact_beyond_longs():
    x = np.array([[1 << 60, 5], [-(1 << 60), 7], [3, 9]], dtype=np.int64)
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    away = whitening.deviations(x, 3, sums)
    assert [[int(v) for v in r] for r in away] == [[3 * int(v) - s for v, s in zip(r, sums, strict=True)] for r in x]
    assert whitening.squares(away).tolist()[0] == whitening.LONG
    small = np.array([[1 << 31, 2], [3, 4]], dtype=np.int64)
    assert whitening.squares(small).tolist() == [(1 << 62) + 4, 25]


def test_partial_sums_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    df = spark.range(1000).selectExpr("id AS vec_id", "array(id, 2 * id, 1L << 40) AS x").repartition(9)
    assert whitening.exact_sums(df, 3) == [499500, 999000, 1000 << 40]
