"""Packing along a space-filling curve: hashed document vectors are projected to a few dimensions, documents are
range-sorted by the Hilbert key of the projection, and neighbours on the curve are packed one after the other.

A partition of the range sort is one stretch of the curve, of STRETCH ids or so (more only beyond MANY ids). Its documents' ids
are laid end to end and cut every SEQUENCE ids; the rest of a stretch is one sequence, the only one that is padded.

Texts are encoded word by word through a cache: the vocabulary's tokenizer drops white space and never joins characters
across it, so a text's ids are those of its words (tested against whole texts). Ids are kept as two bytes each between
the two passes; they are written once to the shared folder, so that the range sort's sampling reads and doesn't encode.
doc_ids cross Python as text, as a batch with a null would make doubles of them.

Nulls: a null text is an empty text, which has the end id alone; a null doc_id stays null. Empty tables give empty
results. Repeated rows are packed as often as they come. Extra columns are ignored. Documents with equal keys are
ordered by doc_id, so a large group of copies is spread over many stretches.
"""

from __future__ import annotations

import os
import string
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import chunks, written

SEQUENCE = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
DIMENSIONS, BITS = 4, 10
BUCKETS = 2048
REACH = 4.0  # projections of unit vectors, in standard deviations, that the curve's cube covers
SEED = 7
CACHE = 1_000_000  # words that a worker's cache may hold; it changes speed alone
STRETCH, LEAST_STRETCH = 4_000_000, 1_000_000  # ids of a stretch of the curve; the least ones, where cores are idle
MANY = 100_000_000_000  # ids beyond which stretches grow as the square root of the corpus, as the driver samples their bounds
#: ASCII marks behind a letter are encoded apart; the tokenizer cuts there, too.
MARKS = string.punctuation.encode()
LETTERS = frozenset(string.ascii_lowercase.encode())
#: Stands between words that are encoded in one call. It is one id, and only words that hold it give that id, too.
BETWEEN = "\x1f"
#: The character by which byte-level vocabularies write each byte: visible Latin-1 ones themselves, the others from 256 on.
VISIBLE = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
BYTE_CHARS = {b: chr(b) if b in VISIBLE else chr(256 + k - sum(v < b for v in VISIBLE)) for k, b in enumerate(range(256))}


def ends_in_letter(word: str) -> bool:
    """Whether a word does so as the tokenizer sees it, in normal form and lower case."""
    return unicodedata.normalize("NFC", word).lower()[-1].isalpha()


class Encoder:
    """Ids of whole texts, as little-endian two-byte numbers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are letters alone, in lower case and in normal form: nothing is left to do but
        # to split at blanks.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = WhitespaceSplit()
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids don't fit in two bytes")
        self.between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids[0]
        self.known: dict[bytes, bytes] = {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        counts, places, words = self.words(texts)
        known = self.known
        parts = list(map(known.get, words))
        holes = [i for i, x in enumerate(parts) if x is None]
        # A full cache stays as it is; what is new is held for this chunk alone.
        into = known if len(known) + len(holes) <= CACHE else {}
        self.encode({words[i] for i in holes}, into)
        for i in holes:
            parts[i] = into[words[i]]
        # Each place of a word takes the word's ids, all places at once.
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 2
        starts = np.cumsum(sizes) - sizes
        n = sizes[places]
        stops = np.cumsum(n)
        ids = np.frombuffer(b"".join(parts), dtype="<u2")[np.repeat(starts[places] - stops + n, n) + np.arange(n.sum())]
        cuts = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        end = END_ID.to_bytes(2, "little")
        return [ids[a:b].tobytes() + end for a, b in zip(cuts, cuts[1:], strict=False)]

    @staticmethod
    def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """How many parts each text has that are encoded apart, the parts by number, and the distinct parts: words in
        lower case. Texts that may hold the strings of special tokens keep their words as they are."""
        column = pa.array([t or "" for t in texts], pa.large_string())
        column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        lists = pc.ascii_split_whitespace(column)  # blanks at an end leave an empty part, which has no ids
        parts = lists.flatten().dictionary_encode()
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False), parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.cast(pa.large_binary()).to_pylist()

    def encode(self, new: set[bytes], into: dict[bytes, bytes]) -> None:
        """Puts the ids of new words into `into`."""
        plain, mapped, rest, ends = [], {}, [], {}

        def sort(w: bytes) -> None:
            if w.isalpha() and w.islower():
                plain.append(w)
            elif (u := w.decode()).isalpha() and u == u.lower() and unicodedata.is_normalized("NFC", u):
                mapped[w] = w.decode("latin-1").translate(BYTE_CHARS).encode()
            elif BETWEEN in u:
                into[w] = np.asarray(self.tokenizer.encode(u, add_special_tokens=False).ids, dtype="<u2").tobytes()
            else:
                rest.append(w)

        into[b""] = b""
        for w in new:
            if w.isalpha() and w.islower():
                plain.append(w)
                continue
            stem = w.rstrip(MARKS)
            if stem and len(stem) < len(w) and (stem[-1] in LETTERS or ends_in_letter(stem.decode())) and b"<|" not in w:
                ends[w] = stem
            elif w:
                sort(w)
        for w in {x for w, stem in ends.items() for x in (stem, w[len(stem) :])} - new:
            if w not in into:
                if w in self.known:
                    into[w] = self.known[w]
                else:
                    sort(w)
        for tokenizer, between, keys, texts in ((self.plain, BYTE_CHARS[ord(BETWEEN)], plain, plain), (self.plain, BYTE_CHARS[ord(BETWEEN)], list(mapped), mapped.values()), (self.tokenizer, BETWEEN, rest, rest)):
            if keys:
                # One call for all: a call and its answer have a high fixed price, a word hardly any.
                line = f" {between} ".encode().join(texts).decode()
                ids = np.asarray(tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u2")
                cuts, data = np.flatnonzero(ids == self.between), ids.tobytes()
                if len(cuts) != len(keys) - 1:
                    raise ValueError("words and their ids don't match")
                into.update(zip(keys, map(data.__getitem__, map(slice, [0, *(2 * cuts + 2).tolist()], [*(2 * cuts).tolist(), len(data)])), strict=True))
        for w, stem in ends.items():
            into[w] = into[stem] + into[w[len(stem) :]]


def worker_encoder(path: str) -> Encoder:
    """The Python worker's own encoder: Spark keeps workers from task to task, and so they keep the words they know.
    Functions come to a worker anew with every task, so the interpreter itself holds it."""
    held = sys.__dict__.setdefault("_lumenfold_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of rows of whole coordinates below 2**bits, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of encoded texts: ids hashed to BUCKETS counts, square roots, unit length, a seeded projection."""
    plane = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))
    spots = np.empty((len(texts), DIMENSIONS))
    for one in chunks([len(t) for t in texts], 256, 1 << 22):
        part = texts[one]
        ids = np.frombuffer(b"".join(part), dtype="<u2").astype(np.uint32)
        at = ((ids * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)  # multiplicative hash to 11 bits
        rows = np.repeat(np.arange(len(part)), [len(t) // 2 for t in part])
        v = np.sqrt(np.bincount(rows * BUCKETS + at, minlength=len(part) * BUCKETS).reshape(len(part), BUCKETS))
        spots[one] = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ plane
    cells = np.clip((spots + REACH) / (2 * REACH) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, key, n, ids) of all documents; n is how many ids there are."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = worker_encoder(path)
        for b in batches:
            for one in chunks([len(t or "") for t in b["text"]], 1000, 1 << 23):
                part = b.iloc[one]
                texts = part["text"].tolist()
                ids = encode(texts)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "key": curve_keys(ids), "n": [len(x) // 2 for x in ids], "ids": ids})

    thin = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return thin.mapInPandas(run, "doc_id string, key long, n long, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of one stretch of the curve. At most one sequence is held."""
    first = TaskContext.get().partitionId() << 40
    made, held, filled, out = 0, [], 0, []

    def emit(pieces: list, sequence: int) -> None:
        offset = 0
        for doc, ids, start, stop, total in pieces:
            wide = np.frombuffer(ids, dtype="<u2")[start:stop].astype("<u4").tobytes()
            out.append((doc, start, stop - start, zlib.crc32(wide), total, first + sequence, offset))
            offset += stop - start

    def frame() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out.clear()
        return rows.astype({"doc_id": "object"} | dict.fromkeys(rows.columns[1:], "int64"))

    for b in batches:
        for doc, ids in zip(b["doc_id"], b["ids"], strict=True):
            total, at = len(ids) // 2, 0
            while at < total:
                stop = min(total, at + SEQUENCE - filled)
                held.append((doc, ids, at, stop, total))
                filled, at = filled + stop - at, stop
                if filled == SEQUENCE:
                    emit(held, made)
                    made, held, filled = made + 1, [], 0
            if len(out) > 20_000:
                yield frame()
    if filled:
        emit(held, made)
    if out:
        yield frame()


def packed(docs: DataFrame, path: str) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = written(encoded(docs, path), spark)
    total = rows.agg(F.sum("n")).first()[0] or 0
    stretches = max(-(-total // max(STRETCH, int(STRETCH * (total / MANY) ** 0.5))), min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_STRETCH)), 1)
    sorted_rows = rows.repartitionByRange(stretches, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    pieces = sorted_rows.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(_pack, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())
