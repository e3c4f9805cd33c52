"""Ranked lexical search by Fagin's threshold algorithm.

One pass over the texts keeps, of each document, its number of terms and the counts of those that the queries ask for: the
forward index, written once. Its totals give the documents' lengths and the terms' weights, and so every posting's impact.

The index is cut into shards of SHARD documents or ENTRIES postings. A shard holds an impact-sorted list for each term and the
forward index by document. For a query, the lists of its terms are read in rounds, an equal depth of each, and every document
met for the first time is looked up in the forward index and scored whole. The threshold is the sum of the impacts at the
depth reached, an upper bound for all documents not met; reading stops when it falls strictly below the k-th best score, as
documents that tie with that score may still win by their doc_id. A task keeps the k best per query over all its shards, so
later shards stop earlier; one window over k rows a task and query gives the result.

Queries come in blocks of at most TERMS different terms (or one query), which bounds what the driver and a broadcast hold; a
block is one pass over the table. Rounds deepen by doubling, so a few postings more are read than a single step would.

Nulls: a null text has no terms; a null doc_id stays and comes last among equal scores. Each row of documents is a document
and each row of queries a query, however often ids repeat. Queries without terms, or whose terms nobody holds, have no rows;
empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import written

TOP = 50
SHARD, ENTRIES = 16_384, 4_000_000  # documents and postings of a shard, whichever comes first
TERMS = 1 << 18  # different terms of a block of queries
FIRST_DEPTH = 64
#: Parts of the scoring formula (fixed values).
WEIGHT_SCALE, TF_SCALE, TF_STEP, LENGTH_STEP = 1000, 1_000_000_000, 1000, 20
LENGTH_BASE, LENGTH_SHARE = 100, 50
#: ASCII that is no letter or digit parts terms, A to Z are lower-cased, other bytes stay.
PLAIN = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(PLAIN).split()


def blocks(queries: DataFrame) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """(number, id, distinct terms) of the queries, in blocks of at most TERMS different terms."""
    held, seen = [], set()
    for n, r in enumerate(queries.toLocalIterator()):
        own = sorted(set(terms(bytes(r["text"]) if r["text"] is not None else None)))
        if held and len(seen | set(own)) > TERMS:
            yield held
            held, seen = [], set()
        if own:
            held.append((n, r["item_id"], own))
            seen |= set(own)
    if held:
        yield held


def forward(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and those of `names`, by their places there."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = known.value
        for b in batches:
            sizes, held, counts, cuts = [], [], [], [0]
            for text in b.column("text"):
                own = terms(text.as_buffer().to_pybytes() if text.is_valid else None)
                sizes.append(len(own))
                found = sorted((places[t], c) for t, c in Counter(own).items() if t in places)
                held += [t for t, _ in found]
                counts += [c for _, c in found]
                cuts.append(len(held))
            at = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(sizes, pa.int64()), "terms": pa.ListArray.from_arrays(at, pa.array(held, pa.int32())), "counts": pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return written(texts.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>"), docs.sparkSession)


def weight(df: int, n: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """Documents with their forward index and an impact-sorted list of each term. Rows without a term of any query are left
    out, as they score nothing."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, sizes: np.ndarray, cuts: np.ndarray, held: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, length: int):
        self.ids, self.absent, self.cuts, self.held = ids, absent, cuts, held
        m = LENGTH_BASE - LENGTH_SHARE + LENGTH_SHARE * sizes * documents // length
        of = np.repeat(np.arange(len(ids)), np.diff(cuts))
        self.impacts = weights[held] * (TF_SCALE * counts // (TF_STEP * counts + LENGTH_STEP * m[of]))
        order = np.lexsort((of, -self.impacts, held))
        self.docs, self.falling = of[order], self.impacts[order]
        self.starts = np.searchsorted(held[order], np.arange(len(weights) + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Random lookups: the whole scores of documents for the terms that `asked` marks."""
        first, sizes = self.cuts[docs], self.cuts[docs + 1] - self.cuts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        total = np.concatenate([[0], np.cumsum(np.where(asked[self.held[at]], self.impacts[at], 0))])
        return total[ends] - total[ends - sizes]

    def search(self, own: np.ndarray, asked: np.ndarray, best: Best) -> int:
        """Adds this shard's documents to the best of a query with the terms `own`; the number of postings read."""
        lists = [(self.starts[t], self.starts[t + 1]) for t in own if self.starts[t] < self.starts[t + 1]]
        met, step, read = np.zeros(len(self.ids), dtype=bool), FIRST_DEPTH, 0
        # Before the first row of a list is read, its first impact is its bound.
        while lists and not sum(int(self.falling[a]) for a, _ in lists) < best.least:
            parts = [self.docs[a : min(a + step, z)] for a, z in lists]
            read += sum(map(len, parts))
            new = np.unique(np.concatenate(parts))
            new = new[~met[new]]
            met[new] = True
            best.add(self.scores(new, asked), self.ids[new], self.absent[new])
            lists = [(a + step, z) for a, z in lists if a + step < z]
            step *= 2
        return read


class Best:
    """The k best (score, doc_id) of a query so far, equal scores by ascending doc_id, a null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # a score must be above 0
        self.scores, self.ids, self.absent = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        fit = scores >= self.least
        if not fit.any():
            return
        scores, ids, absent = (np.concatenate(x) for x in ((self.scores, scores[fit]), (self.ids, ids[fit]), (self.absent, absent[fit])))
        if len(scores) > 4 * self.k:  # sorts only what may stay
            near = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, absent = scores[near], ids[near], absent[near]
        order = np.lexsort((ids, absent, -scores))[: self.k]
        self.scores, self.ids, self.absent = scores[order], ids[order], absent[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, absent, sizes, cuts, terms, counts) of runs of rows that hold a term."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = postings = 0

    def joined() -> tuple[np.ndarray, ...]:
        ids, absent, sizes, lengths, found, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        return ids, absent, sizes, np.concatenate([[0], np.cumsum(lengths)]), found, counts

    for b in batches:
        lengths = b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        found, counts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
        ids, sizes = b.column("doc_id"), b.column("n").to_numpy(zero_copy_only=False)
        absent, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(ids):
            # As many rows as fit, one at least.
            room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES - postings, side="right"))
            to = min(max(room, at if docs else at + 1), at + SHARD - docs, len(ids))
            if to > at:
                rows, lo = slice(at, to), int(ends[at - 1]) if at else 0
                some = lengths[rows] > 0
                held.append((ids[rows][some], absent[rows][some], sizes[rows][some], lengths[rows][some], found[lo : int(ends[to - 1])], counts[lo : int(ends[to - 1])]))
                docs, postings = docs + to - at, postings + int(ends[to - 1]) - lo
            if to < len(ids) or docs == SHARD:
                yield joined()
                held, docs, postings = [], 0, 0
            at = to
    if held:
        yield joined()


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of every query (item_id, text)."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = written(queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")), spark)
    for block in blocks(asked):
        out = out.unionByName(_searched(docs, block, k))
    return out


def _searched(docs: DataFrame, block: list[tuple[int, object, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    names = sorted({t for _, _, own in block for t in own})
    places = {t: i for i, t in enumerate(names)}
    index = forward(docs, names)
    documents, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = {r["t"]: r["n"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most TERMS rows
    weights = np.array([weight(held.get(i, 0), documents) for i in range(len(names))], dtype=np.int64)
    sent = spark.sparkContext.broadcast((weights, [(n, item, np.array([places[t] for t in own])) for n, item, own in block]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = sent.value
        best = [Best(k) for _ in asked]
        mark = np.zeros(len(weights), dtype=bool)
        for parts in _shards(batches):
            shard = Shard(*parts, weights, documents, length)
            for (_, _, own), found in zip(asked, best, strict=True):
                mark[own] = True
                shard.search(own, mark, found)
                mark[own] = False
        for (n, item, _), found in zip(asked, best, strict=True):
            if size := len(found.scores):
                yield pa.RecordBatch.from_pydict({"query": pa.array([n] * size, pa.int64()), "item_id": pa.array([item] * size, pa.int64()), "doc_id": pa.array(found.ids, pa.int64(), mask=found.absent), "score": pa.array(found.scores, pa.int64())})

    found = index.mapInArrow(run, "query long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_TERMS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS.format("text")} AS terms FROM documents),
s AS (SELECT *, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM s),
p AS (SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM s) GROUP BY row_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term),
q AS (SELECT DISTINCT row_id, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS row_id, item_id, {_TERMS.format("text")} AS terms FROM benchmark)),
x AS (SELECT q.row_id AS q, item_id, p.row_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, row_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
