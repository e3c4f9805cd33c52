"""Exact top-k search over a pivot-distance index.

Largest inner products become smallest distances by one more coordinate: with M the largest norm of all rows, x is kept
as (x, sqrt(M^2 - |x|^2)) and a query as (q, 0), so |q - x|^2 = |q|^2 + M^2 - 2<q, x>. Rows are keyed by their nearest
pivot and their distance to it and sorted by that key; a shard is a run of SHARD rows in that order, and an annulus the
part of a shard under one pivot. By the triangle inequality no row of an annulus [near, far] around pivot p scores more
than (|q|^2 + M^2 - gap^2) / 2, gap being how far |q - p| lies outside [near, far].

The neighbours of a query in the sorted order give a first bound on its k-th score. Queries then go, in blocks, to the WAVE
shards that may hold the highest scores; what they find there raises the bound, and a second wave goes only to those of the
other shards that it leaves open. In a shard annuli are taken in the order of their bounds until none can add anything.
Scores are whole numbers, taken in doubles where a block's largest possible one is below 2**53 and in unbounded integers
elsewhere, and bounds are rounded up, so results are exact for any pivots.

Pivots come from a bounded sample (SAMPLE rows with the smallest hashes of their ids); their choice changes speed alone.
The list of shards has at most MAX_SHARDS entries, as shards grow with the table; that bounds what the driver holds.

Nulls: vectors that are null or hold null or non-finite components, and rows without an id take no part. Vectors that are
shorter than the longest one count as filled up with zeros. Components and scores beyond a long are its nearest value.
Empty tables give empty results. Rows that repeat a vec_id are candidates each, also of one another, and each a query of
its own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

PIVOTS = 64
SAMPLE = 4096
SHARD = 4096
MAX_SHARDS = 50_000
QUERY_BLOCK = 256
WAVE = 3
NO_BOUND = -(1 << 63)  # a query that has met fewer than k rows so far; no annulus is closed to it


def whole_vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, vec): components floor(256 * x), of the rows that take part."""
    parts = F.transform(column, lambda x: F.floor(x.cast("double") * 256))
    fit = F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(fit & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), parts.alias("vec"))


def choose_pivots(vectors: DataFrame, size: int) -> np.ndarray:
    """Pivots spread out over a bounded sample, each the row farthest from those before it."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vec")).limit(SAMPLE).collect()
    x = _filled([r["vec"] for r in rows], size).astype(np.float64)
    chosen, gap = [0], np.full(len(x), np.inf)
    while len(chosen) < min(PIVOTS, len(x)):
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(gap.argmax()))
    return x[chosen]


def _filled(vectors: list, size: int) -> np.ndarray:
    if all(len(v) == size for v in vectors):
        return np.array([np.asarray(v) for v in vectors], dtype=np.int64).reshape(len(vectors), size)
    out = np.zeros((len(vectors), size), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors, as longs."""
    most = lambda a: max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))
    if most(q) * most(x) * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray, last_p: np.ndarray) -> np.ndarray:
    flat = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(flat + (last[:, None] - last_p[None, :]) ** 2, 0))


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> list[tuple[int, int, int]]:
    """The k best (score, id, row) of one query but its own row, ties to smaller ids."""
    keep = rows != own
    scores, ids, rows = scores[keep], ids[keep], rows[keep]
    if len(scores) > 4 * k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids, rows = scores[near], ids[near], rows[near]
    order = sorted(range(len(scores)), key=lambda i: (-int(scores[i]), ids[i], rows[i]))[:k]
    return [(int(scores[i]), int(ids[i]), int(rows[i])) for i in order]


def opened(ceiling: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which queries may find something where `ceiling` is the highest possible score."""
    return (bounds == NO_BOUND) | (ceiling >= bounds)


def search(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every row of (vec_id, vec) for which `is_query` holds."""
    spark = vectors.sparkSession
    top, total, size, largest = vectors.agg(
        F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))
    ).first()
    if not total or not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots, kind, shard = choose_pivots(vectors, size), "<i4" if largest < 1 << 31 else "<i8", max(SHARD, -(-total // MAX_SHARDS))
    last_p = np.sqrt(np.maximum(top - (pivots**2).sum(axis=1), 0))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                whole = _filled(b["vec"].tolist(), size)
                x = whole.astype(np.float64)
                far = _distances(x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0)), pivots, last_p)
                near = far.argmin(axis=1)
                yield pd.DataFrame({"vec_id": b["vec_id"], "asks": b["asks"], "cell": near.astype("int32"), "away": far[np.arange(len(b)), near], "vec": [v.tobytes() for v in whole.astype(kind)]})

    def sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of `shard` sorted rows, each with a first k-th score for its queries from the run itself."""
        held: list[pd.DataFrame] = []
        def out(part: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(b"".join(part["vec"]), dtype=kind).reshape(len(part), size)
            ids, rows, asks = part["vec_id"].to_numpy(), part["row"].to_numpy(), np.flatnonzero(part["asks"].to_numpy())
            bounds = []
            for at in range(0, len(asks), QUERY_BLOCK):
                rows_at = asks[at : at + QUERY_BLOCK]
                for i, s in zip(rows_at, products(x[rows_at], x), strict=True):
                    got = _best(s, ids, rows, rows[i], k)
                    bounds.append(got[-1][0] if len(got) == k else NO_BOUND)
            cells = part["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
            stops = np.append(cuts[1:], len(part))
            away = part["away"].to_numpy()
            line = {"ids": ids.astype("<i8").tobytes(), "rows": rows.astype("<i8").tobytes(), "vecs": x.tobytes(), "cells": cells[cuts].tolist(), "starts": cuts.tolist(), "near": away[cuts].tolist(), "far": away[stops - 1].tolist()}
            return pd.DataFrame([line | {"shard": int(ids[0]), "ask_ids": ids[asks].astype("<i8").tobytes(), "ask_rows": rows[asks].astype("<i8").tobytes(), "asks": x[asks].tobytes(), "bounds": np.array(bounds, dtype="<i8").tobytes()}])

        n = 0
        for b in batches:
            while len(b):
                part, b = b.iloc[: shard - n], b.iloc[shard - n :]
                held.append(part)
                n += len(part)
                if n == shard:
                    yield out(pd.concat(held))
                    held, n = [], 0
        if n:
            yield out(pd.concat(held))

    keys = vectors.select("vec_id", "vec", F.coalesce(is_query, F.lit(False)).alias("asks")).mapInPandas(keyed, "vec_id long, asks boolean, cell int, away double, vec binary")
    # A row's number in the written table is what it is known by; ids may repeat.
    keys = written(keys.withColumn("row", F.monotonically_increasing_id()), spark)
    keys = keys.repartitionByRange("cell", "away", "vec_id", "row").sortWithinPartitions("cell", "away", "vec_id", "row")
    shards = keys.mapInPandas(sharded, "shard long, ids binary, rows binary, vecs binary, cells array<int>, starts array<int>, near array<double>, far array<double>, ask_ids binary, ask_rows binary, asks binary, bounds binary")
    shards = written(shards.withColumn("shard", F.monotonically_increasing_id()), spark)
    listed = [(r["shard"], np.array(r["cells"]), np.array(r["near"]), np.array(r["far"])) for r in shards.select("shard", "cells", "near", "far").collect()]

    def ceilings(q: np.ndarray, cells: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The highest score that each annulus can hold for each query; rounded up."""
        to = _distances(q, np.zeros(len(q)), pivots, last_p)[:, cells]
        gap = np.maximum(np.maximum(near[None, :] - to, to - far[None, :]) - 1e-6 * (1 + to + top**0.5), 0)
        return np.floor(((q**2).sum(axis=1)[:, None] + top - gap**2) / 2 + 1e-6 * (top + 1))

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a query, with the places in `listed` of the shards that it goes to first."""
        for b in batches:
            for r in b.itertuples():
                ids, rows, bounds = (np.frombuffer(x, dtype="<i8") for x in (r.ask_ids, r.ask_rows, r.bounds))
                q = np.frombuffer(r.asks, dtype=kind).reshape(len(ids), size)
                for at in range(0, len(ids), QUERY_BLOCK):
                    one = slice(at, at + QUERY_BLOCK)
                    wide = q[one].astype(np.float64)
                    tops = np.stack([ceilings(wide, *x[1:]).max(axis=1) for x in listed], axis=1)
                    first = np.argsort(-tops, axis=1, kind="stable")[:, :WAVE]
                    yield pd.DataFrame({"own": rows[one], "query_id": ids[one], "q": [v.tobytes() for v in q[one]], "bound": bounds[one], "first": first.astype("int32").tolist()})

    def routed(wave: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Query blocks for each shard of the wave that their bounds leave open."""
            names = ["to", "q_ids", "q_rows", "qs", "q_bounds"]
            for b in batches:
                for at in range(0, len(b), QUERY_BLOCK):
                    part, out = b.iloc[at : at + QUERY_BLOCK], []
                    ids, rows, bounds = (part[c].to_numpy(dtype="<i8") for c in ("query_id", "own", "bound"))
                    q = np.frombuffer(b"".join(part["q"]), dtype=kind).reshape(len(part), size)
                    first = np.zeros((len(part), len(listed)), dtype=bool)
                    np.put_along_axis(first, np.array(part["first"].tolist()).reshape(len(part), -1), True, axis=1)
                    wide = q.astype(np.float64)
                    for n, (name, cells, near, far) in enumerate(listed):
                        mine = np.flatnonzero(first[:, n] if wave == 1 else ~first[:, n])
                        if len(mine):
                            mine = mine[opened(ceilings(wide[mine], cells, near, far).max(axis=1), bounds[mine])]
                        if len(mine):
                            out.append((name, *(x[mine].tobytes() for x in (ids, rows, q, bounds))))
                        if len(out) == 16:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=names)

        return run

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids, rows, q_ids, q_rows, bounds = (np.frombuffer(x, dtype="<i8") for x in (r.ids, r.rows, r.q_ids, r.q_rows, r.q_bounds))
                x, q, bounds = np.frombuffer(r.vecs, dtype=kind).reshape(len(ids), size), np.frombuffer(r.qs, dtype=kind).reshape(len(q_ids), size), bounds.copy()
                starts = np.append(np.array(r.starts), len(ids))
                limits = ceilings(q.astype(np.float64), np.array(r.cells), np.array(r.near), np.array(r.far))
                found: list[list[tuple[int, int, int]]] = [[] for _ in q_ids]
                for a in np.argsort(-limits.max(axis=0), kind="stable"):  # expanding outwards
                    asks = np.flatnonzero(opened(limits[:, a], bounds))
                    if len(asks):
                        part = slice(starts[a], starts[a + 1])
                        for i, s in zip(asks, products(q[asks], x[part]), strict=True):
                            got = sorted(found[i] + [(-v, d, n) for v, d, n in _best(s, ids[part], rows[part], q_rows[i], k)])[:k]
                            found[i] = got
                            if len(got) == k:
                                bounds[i] = max(bounds[i], -got[-1][0])
                out = [(int(own), int(i), d, n, -v) for own, i, got in zip(q_rows, q_ids, found, strict=True) for v, d, n in got]
                yield pd.DataFrame(out, columns=["own", "query_id", "vec_id", "row", "score"]).astype("int64")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row")).cast("int")
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def visited(asks: DataFrame, wave: int) -> DataFrame:
        # One short list of queries and bounds per shard that stays open; a shard's rows join it by the shard's number.
        asked = asks.mapInPandas(routed(wave), "to long, q_ids binary, q_rows binary, qs binary, q_bounds binary")
        met = asked.join(shards.select("shard", "ids", "rows", "vecs", "cells", "starts", "near", "far"), F.col("to") == F.col("shard")).drop("to", "shard")
        return met.mapInPandas(scored, "own long, query_id long, vec_id long, row long, score long")

    asks = written(shards.select("ask_ids", "ask_rows", "asks", "bounds").mapInPandas(asking, "own long, query_id long, q binary, bound long, first array<int>"), spark)
    near = written(best(visited(asks, 1)), spark)
    raised = near.filter(F.col("rank") == k).select("own", F.col("score").alias("kth"))
    asks = asks.join(raised, "own", "left").withColumn("bound", F.greatest("bound", F.coalesce("kth", "bound"))).drop("kth")
    return best(near.drop("rank").unionByName(visited(asks, 2))).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = """
WITH fit AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row_id AS own, q.vec_id AS query_id, c.row_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND q.row_id <> c.row_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, row_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
