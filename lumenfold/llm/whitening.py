"""Embedding whitening by matrix-free block Lanczos.

The covariance V of all vectors is never built. A pass over the table multiplies it with a block of vectors: each
partition adds up Xc'(Xc Q) over its rows, centred before multiplying, and the partial sums are added in groups of FAN.
The driver holds what has the size of the dimension alone: the basis, which is reorthogonalised in full (twice) against
all earlier blocks, and the projected matrix. A block that breaks down, as its Krylov space is exhausted, is filled up with
random directions that are orthogonal to the basis, so a further invariant subspace is found, too. Passes end where the
residuals of the wanted Ritz pairs vanish to rounding, and at the latest where the basis spans the whole space.

Whitened values are the centred vector's projection on a component over the square root of its eigenvalue. Deviations are
exact whole numbers, and their sum gives the trace, hence the explained shares.

Nulls: vectors that are null or hold null or non-finite entries are dropped; a null vec_id stays. Vectors that are shorter
than the longest one count as filled up with zeros. Repeated rows count as often as they come. Components without variance
(eigenvalue at most NOTHING of the trace) can't be whitened and have no rows, so equal vectors, a single one and an empty
table give none. Entries beyond a long are its nearest value, deviations too. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 16  # vectors of a block: more than the components, so that equal eigenvalues among these are told apart
FAN = 64  # partial sums that one task, and at last the driver, adds up
ROWS = 8192  # rows that a task multiplies at once
TOLERANCE = 4 * np.finfo(float).eps  # residual that counts as none, of the largest eigenvalue
NOTHING = 1e-12
SEED = 13
LONG = (1 << 63) - 1


def whole_vectors(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, x): entries floor(SCALE * c) + SHIFT of the rows that take part."""
    fit = F.col(column).isNotNull() & F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    entry = lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit(LONG - SHIFT)) + SHIFT
    return df.filter(fit).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(column, entry).alias("x"))


def matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of at most ROWS rows, each with its vectors as a matrix."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: longs where they hold it, else Python's whole numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if 2 * n * most < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squares(away: np.ndarray) -> np.ndarray:
    """Each row's sum of squares, exact; beyond a long its largest value."""
    most = float(np.abs(away).max(initial=0))
    if away.dtype != object and most * most * away.shape[1] < 1 << 62:
        return (away * away).sum(axis=1)
    return np.array([min(int(v), LONG) for v in (away.astype(object) ** 2).sum(axis=1)], dtype=np.int64)


def summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum of `part` of each matrix of rows. A partition gives one partial sum; FAN of them at a time are added, in
    the order of their partitions, until the driver gets at most FAN."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in matrices(batches, size):
            one = part(x)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array([TaskContext.get().partitionId()], pa.int64()), "part": pa.array([np.ascontiguousarray(total, dtype=kind).tobytes()], pa.binary())})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(p, dtype=kind) for p in pdf.sort_values("at")["part"]]
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0]) // FAN], "part": [np.sum(parts, axis=0).astype(kind).tobytes()]})

    left = df.rdd.getNumPartitions()
    parts = df.mapInArrow(local, "at long, part binary")
    while left > FAN:
        parts = parts.groupBy(F.floor(F.col("at") / FAN)).applyInPandas(added, "at long, part binary")
        left = -(-left // FAN)
    return np.sum([np.frombuffer(r["part"], dtype=kind) for r in sorted(parts.collect(), key=lambda r: r["at"])], axis=0)


def exact_sums(df: DataFrame, size: int) -> list[int]:
    """Per-dimension sums without overflow: of the upper and of the lower 31 bits."""
    both = summed(df, lambda x: np.stack([(x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)]), size, "<i8").reshape(2, size)
    return [(int(high) << 31) + int(low) for high, low in zip(*both, strict=True)]


def fresh(block: np.ndarray, basis: np.ndarray, floor: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(Q, R) with block = Q R off the basis and Q orthonormal to it; a direction no longer than `floor` is a breakdown,
    whose row of R is zero and whose place a random new direction takes."""
    size, width = block.shape
    q, r = np.zeros((size, 0)), np.zeros((width, width))
    for j in range(width):
        v = block[:, j].copy()
        for _ in range(2):
            v -= basis @ (basis.T @ v)
            along = q.T @ v
            r[: q.shape[1], j] += along
            v -= q @ along
        long = float(np.linalg.norm(v))
        if long > floor:
            r[q.shape[1], j] = long
        elif basis.shape[1] + q.shape[1] == size:
            continue
        else:
            v = random.standard_normal(size)
            for _ in range(3):
                v -= basis @ (basis.T @ v)
                v -= q @ (q.T @ v)
            long = float(np.linalg.norm(v))
        q = np.column_stack([q, v / long])
    return q, r[: q.shape[1]]


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, known by its products, and their unit eigenvectors."""
    random = np.random.default_rng(SEED)
    wanted = min(wanted, size)
    block, _ = fresh(random.standard_normal((size, min(BLOCK, size))), np.zeros((size, 0)), 0.0, random)
    basis, products, scale = np.zeros((size, 0)), np.zeros((size, 0)), 0.0
    while True:
        image = multiply(block)
        scale = max(scale, float(np.abs(image).max(initial=0)))
        basis, products = np.column_stack([basis, block]), np.column_stack([products, image])
        projected = basis.T @ products
        values, turns = np.linalg.eigh((projected + projected.T) / 2)
        values, turns = values[::-1][:wanted], turns[:, ::-1][:, :wanted]
        if basis.shape[1] == size:
            break
        floor = TOLERANCE * max(float(values[0]), scale)
        block, r = fresh(image, basis, floor, random)
        if basis.shape[1] >= wanted and np.linalg.norm(r @ turns[-image.shape[1] :], axis=0).max() <= floor:
            break
    vectors, _ = np.linalg.qr(basis @ turns)
    return values, vectors


def whitened(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) from (vec_id, x)."""
    spark, schema = vectors.sparkSession, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = written(vectors, spark)
    n, size, least = vectors.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min(F.size("x"))).first()
    if not n or not size:
        return spark.createDataFrame([], schema)
    if least < size:
        vectors = vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(size) - F.size("x"))))
    sums = exact_sums(vectors, size)
    centred = lambda x: deviations(x, n, sums).astype(np.float64) / n

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ block)

        return summed(vectors, part, size, "<f8").reshape(block.shape) / n

    values, directions = lanczos(multiply, size, wanted)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in matrices(batches, size):
            away = deviations(x, n, sums)
            w = (away.astype(np.float64) / n) @ scaled
            yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "deviation": pa.array(squares(away), pa.int64()), "w": pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))})

    # The trace bounds each eigenvalue from above; what is nothing beside their sum is no component.
    live = int((values > NOTHING * max(float(values.sum()), 0.0)).sum())
    if not live:
        return spark.createDataFrame([], schema)
    values, scaled = values[:live], directions[:, :live] / np.sqrt(values[:live])
    rows = written(vectors.mapInArrow(projected, "vec_id long, deviation long, w array<double>"), spark)
    w = [F.get("w", i) for i in range(live)]
    *means, deviation = rows.agg(*[F.avg(c) for c in w], F.sum(F.col("deviation").cast("double"))).first()
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    shares = rows.agg(*[F.sum((w[i] - means[i]) * (w[j] - means[j])) / n for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(shares, pairs, strict=True))
    trace = deviation / n**3
    explained = F.array(*[F.lit(float(v) / trace) for v in values])
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"))
