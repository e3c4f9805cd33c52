"""Substring dedup by sliding spans: runs of several consecutive sentences are hashed and joined over the whole corpus, and
what is under any repeated run but its first is removed.

Two kinds of runs are hashed. From each sentence on, the next whole ones until there are SENTENCES of them and
SENTENCE_WORDS words; a sentence ends at a word that ends in one of `.!?`. Longer repeats are covered by these runs.

A passage may also begin and end inside sentences, so sentences are cut into clauses where their words say so: of each REACH
words in a row, the one with the smallest hash begins a clause, and so does a word after one of `.!?,;:`, which has the
smallest hash of all. Where a clause begins depends on the words around it only, so texts that share a passage have the same clauses
inside it, wherever it stands. A second kind of run starts at each clause and takes on consecutive clauses until it has MIN_WORDS words.
Every shared stretch of MIN_WORDS + 4 * REACH - 3 words (50) holds a common run, by the count: the first common clause
begins within 2 * REACH - 2 words, its run ends within MIN_WORDS + REACH - 1 more, and the last REACH words may differ.
So whatever 50 consecutive words say twice is found, and loses what whole clauses of it hold, 33 words or more; shorter stretches
lose whole sentences alone.

Words are compared as they stand between ASCII white space, A-Z in lower case; hashes of runs have 128 bits. The first place
of a run is the one with the smallest (doc_id, hash of the text, start). Most runs are unique; they are counted by 64-bit
hashes first, and repeated ones are looked up in a filter of at most FILTER_BITS bits; a false hit there costs a place and
changes no result. Where PART_RUNS are not enough, runs are taken in parts by their hashes, with a filter and a pass over the
texts for each. What passes is kept as one row a text and part, with its places in lists; a run's places meet once, for the
first of them, and only these go back to their texts, which lose the others. Where a text repeats itself without a break,
a run takes nothing from its own first place.

Nulls: a null text is an empty text, without runs; a null doc_id is smaller than any other. Empty tables give empty
results. Rows that repeat a doc_id with the same text are one place and lose nothing to each other; with another text
they are another place. Extra columns are ignored by `removals` and kept by `dedup_documents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import chunks, written

REACH = 5
MIN_WORDS = 33
FILTER_BITS = 1 << 29
PART_RUNS = FILTER_BITS // 5  # repeated runs that a filter holds; some 11 of 100 other runs pass a full one
BLOCK_BITS = 1 << 20  # the filter is built in blocks of so many bits at most
MIX = np.uint64(0x9E3779B97F4A7C15)
SENTENCES, SENTENCE_WORDS = 3, 20  # consecutive whole sentences of a run, and the words that it has at least
STOPS, ENDS = (np.isin(np.arange(256), np.frombuffer(x, dtype=np.uint8)) for x in (b".!?", b".!?,;:"))
CHUNK = 1 << 18  # letters of texts that are worked on together; a longer text comes alone
HELD = 1 << 22  # hashes of runs that are counted before they are handed on
SPANS = "doc_id long, body long, part int, start array<int>, length array<int>, back array<int>, run array<struct<a: long, b: long>>"
REMOVED = "doc_id long, body long, removed array<struct<start: int, end: int>>"


def _hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed hash of each stretch of letters, by their running sums (`_sums`); it doesn't depend on where the stretch stands."""
    with np.errstate(over="ignore"):
        h = (sums[ends] - sums[starts]) * _inverses(len(sums))[starts]
        h = (h ^ (h >> np.uint64(32))) * MIX
        return (h ^ (h >> np.uint64(29))) * MIX


def _sums(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(letters) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _powers(len(letters)), out=out[1:])
    return out


_held: dict[str, np.ndarray] = {}


def _series(name: str, factor: int, n: int) -> np.ndarray:
    """Powers of an odd factor, modulo 2**64, at least n of them."""
    found = _held.get(name)
    if found is None or len(found) < n:
        with np.errstate(over="ignore"):
            found = _held[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16) - 1, factor, np.uint64)]), dtype=np.uint64)
    return found[:n]


def _powers(n: int) -> np.ndarray:
    return _series("powers", 0x5851F42D4C957F2D, n)


def _inverses(n: int) -> np.ndarray:
    return _series("inverses", pow(0x5851F42D4C957F2D, -1, 1 << 64), n)


class Runs:
    """The runs of some texts, which are worked on as one array of words. Each text has a slot for each of its words and one
    more for its end.

    `doc`: a run's text; `first`, `behind`: the slots of its first word and of what comes after its last, by which runs are
    sorted; `start`, `end`: its letters in `letters`, where words are in lower case and have one blank between them.
    """

    def __init__(self, texts: list[str | None]):
        self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.edges = np.cumsum([0, *(len(x) + 1 for x in self.raw)])  # where texts begin in `data`, each with a blank behind it
        data = b" ".join([*self.raw, b""])
        low = np.frombuffer(data.lower(), dtype=np.uint8)  # bytes: ASCII alone is lowered and split at
        blank = (low == 32) | (low - np.uint8(9) < 5)
        fresh = np.concatenate([[True], blank[:-1]])
        self.data, self.words = data, np.flatnonzero(fresh & ~blank)
        keep = ~(fresh & blank)
        gaps = blank[keep]
        letters = np.where(gaps, np.uint8(32), low[keep])
        self.letters, ends = letters, np.flatnonzero(gaps)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        sizes = np.diff(np.searchsorted(self.words, self.edges))
        self.owner = np.repeat(np.arange(len(texts)), sizes + 1)
        tails = np.cumsum(sizes + 1) - 1
        heads = tails - sizes
        word = np.ones(len(self.owner), dtype=bool)
        word[tails] = False
        self.tails, self.slots = tails, np.flatnonzero(word)
        last = letters[ends - 1]

        stops = np.zeros(len(word), dtype=bool)  # where sentences begin; the last one ends in a stop
        stops[heads] = True
        stops[self.slots[STOPS[last]] + 1] = True
        stops = np.flatnonzero(stops)
        to = np.maximum(np.arange(len(stops)) + SENTENCES, np.searchsorted(stops, stops + SENTENCE_WORDS))
        pairs = self._within(stops, to)

        self.sums = _sums(letters)
        order = np.zeros(len(word), dtype=np.uint64)  # a text's end is 0, which is below all words but those that begin a clause anyway
        order[self.slots] = _hashes(self.sums, starts, ends) >> np.uint64(1)
        after = self.slots[ENDS[last]] + 1
        order[after[word[after]]] = 0
        begins = _least(order) | (order == 0)
        begins[heads] = True
        cuts = np.flatnonzero(begins)
        pairs = np.sort(np.concatenate([pairs, self._within(cuts, np.searchsorted(cuts, cuts + MIN_WORDS))]))
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]

        self.first, self.behind = pairs >> 32, pairs & 0xFFFFFFFF
        self.doc = self.owner[self.first]
        self.start, self.end = starts[self.first - self.doc], ends[self.behind - self.doc - 1]  # each text before has one slot more than words

    def _within(self, slots: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The pairs of a slot and the one at its place in `to`, where both are of one text."""
        first, behind = slots[to < len(slots)], slots[to[to < len(slots)]]
        same = self.owner[first] == self.owner[behind]
        return first[same] << 32 | behind[same]

    def hashes(self) -> np.ndarray:
        return _hashes(self.sums, self.start, self.end)

    def places(self) -> np.ndarray:
        """Where each slot's word starts in its text, in code points; for a text's end, its length."""
        points = np.cumsum((np.frombuffer(self.data, dtype=np.uint8) & 0xC0) != 0x80)
        out = np.empty(len(self.owner), dtype=np.int64)
        out[self.slots] = points[self.words]
        out[self.tails] = points[self.edges[1:] - 1]
        return out - points[self.edges[:-1]][self.owner] if len(out) else out


def _least(order: np.ndarray) -> np.ndarray:
    """Whether a value above 0 is the first least one of any REACH in a row without a 0: as many as REACH - 1 around it are
    larger, or equal and behind it."""
    near = np.zeros(len(order), dtype=np.int8)
    before, behind = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    for d in range(1, REACH):
        before[:d] = False
        before[d:] &= order[:-d] > order[d:]
        behind[-d:] = False
        behind[:-d] &= order[d:] >= order[:-d]
        near += before
        near += behind
    return near >= REACH - 1


def _chunked(texts: list[str | None]) -> Iterator[tuple[int, Runs]]:
    """Runs of consecutive texts, some CHUNK letters at a time, and the number of the first of them."""
    for part in chunks([len(t or "") for t in texts], len(texts), CHUNK):
        yield part.start, Runs(texts[part])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of runs and how often each stands in some HELD of them."""
    found: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        own, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["run", "n"])

    for b in batches:
        for _, got in _chunked(b.column("text").to_pylist()):
            found.append(got.hashes())
            if sum(map(len, found)) > HELD:
                yield counted()
    yield counted()


def _bits(block: pd.DataFrame) -> pd.DataFrame:
    flags = np.zeros(BLOCK_BITS, dtype=np.uint8)
    flags[block["at"].to_numpy()] = 1
    return pd.DataFrame({"block": block["block"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})


def repeated_runs(texts: DataFrame) -> Iterator[tuple[int, int, np.ndarray]]:
    """Filters, as bytes, that hold two bits of each run that stands in more than one place: one for each part of the runs (by
    their hashes, modulo the number of parts), one after the other, with that part and the number of parts."""
    spark = texts.sparkSession
    again = written(texts.mapInArrow(_digests, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).filter("n > 1").select("run"), spark)
    n = again.count()
    parts = -(-n // PART_RUNS) | 1  # odd, so that parts don't share the low bits that are looked up
    bits = min(max(1 << (16 * n // parts).bit_length(), BLOCK_BITS), FILTER_BITS)
    probes = F.explode(F.array(F.col("run").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("run", 32).bitwiseAND(F.lit(bits - 1))))
    for part in range(parts):
        at = again.filter(F.pmod("run", F.lit(parts)) == part).select(probes.alias("at")).distinct().select((F.col("at") / BLOCK_BITS).cast("int").alias("block"), (F.col("at") % BLOCK_BITS).cast("int").alias("at"))
        out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), dtype=np.uint8)
        for r in at.groupBy("block").applyInPandas(_bits, "block int, bits binary").toLocalIterator():
            out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        yield part, parts, out.reshape(-1)


def _own(*keys: np.ndarray) -> np.ndarray:
    """For each place the first one with the same keys."""
    order = np.lexsort(keys)  # stable
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _emit(carried: Broadcast, part: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = carried.value
        mask = np.uint64(8 * len(bits) - 1)

        def holds(at: np.ndarray) -> np.ndarray:
            return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

        for b in batches:
            for base, got in _chunked(b.column("text").to_pylist()):
                small = got.hashes()
                hits = np.flatnonzero(small.view(np.int64) % parts == part)
                hits = hits[holds(small[hits] & mask)]
                hits = hits[holds(small[hits] >> np.uint64(32) & mask)]
                if not len(hits):
                    continue
                joined, digest = got.letters.tobytes(), xxhash.xxh3_128_digest
                run = np.frombuffer(b"".join([digest(joined[x:y]) for x, y in zip(got.start[hits].tolist(), got.end[hits].tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
                at, doc = got.places(), got.doc[hits]
                start = at[got.first[hits]]
                length = at[got.behind[hits]] - start
                back = np.arange(len(hits)) - _own(run[:, 0], run[:, 1], doc)
                rows, offsets = np.unique(doc, return_index=True)
                offsets = pa.array(np.append(offsets, len(hits)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (start, length, back)]
                hashes = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(run[:, k])) for k in (0, 1)], ["a", "b"])
                ids = [b.column(c).take(pa.array(base + rows)) for c in ("doc_id", "body")]
                parted = pa.array(np.full(len(rows), part, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*ids, parted, *lists, pa.ListArray.from_arrays(offsets, hashes)], ["doc_id", "body", "part", "start", "length", "back", "run"])

    return emit


def spans(docs: DataFrame) -> DataFrame:
    """For each row and part with runs that may repeat, these runs in lists by their start: where one starts, how long it is up
    to where the next word starts, how many places before it in the lists the text has it first, and its hash. `body` is a hash of
    the text, which tells rows with one doc_id apart. Each part is a pass over the texts."""
    spark = docs.sparkSession
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    found = []
    for part, parts, bits in repeated_runs(docs.select("text")):
        carried = spark.sparkContext.broadcast(bits)  # at most FILTER_BITS bits
        found.append(written(thin.mapInArrow(_emit(carried, part, parts), SPANS), spark))
        carried.unpersist()
    return reduce(DataFrame.union, found)


def first_places(found: DataFrame) -> DataFrame:
    """(doc_id, body, part, firsts): where in a row's lists of `spans` the runs are that stand nowhere before."""
    places = found.select("doc_id", "body", "part", F.posexplode("run").alias("at", "run"))
    first = places.groupBy("run.a", "run.b").agg(F.min(F.struct("doc_id", "body", "at", "part")).alias("first"))  # a run is of one part
    return first.groupBy("first.doc_id", "first.body", "first.part").agg(F.collect_list("first.at").alias("firsts"))


def _flat(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _merged(b: pa.RecordBatch, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Sorted, disjoint ranges of each row of the batch that has some."""
    begin, end = begin + (row << 32), end + (row << 32)  # rows one behind the other
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    begin, end = begin[heads], end[np.append(heads, len(end))[1:] - 1]
    rows, offsets = np.unique(begin >> 32, return_index=True)
    ranges = pa.StructArray.from_arrays([pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (begin, end)], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(offsets, len(begin)).astype(np.int32)), ranges)
    return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in ("doc_id", "body")), lists], ["doc_id", "body", "removed"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the runs that aren't first."""
    for b in batches:
        start, length, back = (_flat(b.column(c)) for c in ("start", "length", "back"))
        sizes = b.column("start").value_lengths().to_numpy(zero_copy_only=False)
        firsts = b.column("firsts").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        end, own = start + length, np.arange(len(start)) - back
        first = np.zeros(len(start), dtype=bool)
        first[np.repeat(np.cumsum(sizes) - sizes, firsts) + _flat(b.column("firsts"))] = True
        # Runs that overlap their first place give what is beyond it.
        here = first[own]
        begin = np.where(here, np.maximum(start, end[own]), start)
        late = (begin < end) & ~(here & (start == start[own]))
        yield _merged(b, np.repeat(np.arange(len(sizes)), sizes)[late], begin[late], end[late])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list from the lists of a text's parts."""
    for b in batches:
        sizes = b.column("removed").value_lengths().to_numpy(zero_copy_only=False)
        begin, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.column("removed").flatten().flatten())
        yield _merged(b, np.repeat(np.arange(len(sizes)), sizes), begin, end)


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, body, removed): the text ranges, as code points with the end exclusive, that repeat an earlier passage, for
    each distinct text (by its hash `body`) under a doc_id; only texts that lose something have a row."""
    found = spans(docs.select("doc_id", "text"))
    first = first_places(found)
    both = found.join(first, found["doc_id"].eqNullSafe(first["doc_id"]) & (found["body"] == first["body"]) & (found["part"] == first["part"]), "left")
    late = both.select(found["doc_id"], found["body"], "start", "length", "back", "firsts").mapInArrow(_removed, REMOVED)
    return late.groupBy("doc_id", "body").agg(F.flatten(F.collect_set("removed")).alias("removed")).mapInArrow(_joined, REMOVED)


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages; columns as they come, `n_chars` counted anew where text goes."""
    gone = removals(docs)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"))
    df = row.join(gone, row["id"].eqNullSafe(gone["doc_id"]) & (row["hash"] == gone["body"]), "left")
    text = F.col("row.text")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, r: F.struct(r["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, r["start"] - a["at"])).alias("out"))
    kept = F.aggregate("removed", begin, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    df = df.select("row", F.col("removed").isNotNull().alias("cut"), F.when(F.col("removed").isNotNull(), kept).otherwise(text).alias("rest"))
    n = lambda c: F.when(F.col("cut"), F.length("rest").cast(docs.schema[c].dataType)).otherwise(F.col("row")[c])
    return df.select(*[(F.col("rest") if c == "text" else n(c) if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document that loses text: its removed ranges and how many characters they hold. A document without a row
    keeps its whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = removals(docs)
    n = F.aggregate("removed", F.lit(0), lambda a, r: a + r["end"] - r["start"]).cast("long")
    listed = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), n.alias("removed_chars"), listed.alias("removed"))
