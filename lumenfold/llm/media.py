"""Media columns: animated GIF streams, written and read on Arrow batches.

Reading decodes the LZW code stream of each image, applies the palette that holds for it, transparency, interlacing and the
disposal of the image before, and yields timed frames: the whole picture as it stands at that time. `frames` stores them one
a row with a colour histogram in a column.

Codes are read without a loop over them: the width of a code depends only on how many came since the table was cleared, so
the places of a whole run of codes are known beforehand; and an entry of the code table is a piece of the output itself, so
codes are references to earlier places that are followed to their ends by doubling.

Payloads (texts, as UTF-8 filled up with bytes 255 to rows of ROW) are stored as frames of at most HEIGHT rows, a byte a pixel.
The palette's red is the index, so the bytes come back from the decoded pictures, not from the indices.

Streams that break off or hold what no GIF holds give the frames before the fault, and the fault in words; pixels that are
missing stay as they were. Parts of an image outside the screen are not shown. Nulls: a null text is an empty text, which is one
row of 255; null media give no frames; a null doc_id stays. Empty tables give empty results, each row its own. Extra
columns are ignored. Every row is worked on alone, in pieces of BATCH rows or bytes; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import chunks, written

ROW, HEIGHT, DELAY = 576, 64, 10  # pixels of a row, rows of a picture, hundredths of a second
FILL = 255
BATCH_ROWS, BATCH_BYTES = 256, 16_000_000
LEVELS = 4  # steps of each colour in a histogram
BITS = 8
TABLE = 4096  # codes that a table can hold (fixed by the format)
#: Red is the index; the odd factors give every index a colour of its own in green and blue, too.
PALETTE = np.stack([np.arange(256) * k % 256 for k in (1, 37, 101)], axis=1).astype(np.uint8)
FRAME_SCHEMA = "doc_id long, frame int, at_ms long, delay_ms long, width int, height int, pixels binary, histogram array<long>, fault string"


def widths(bits: int, first: int, count: int) -> np.ndarray:
    """Bits of the codes number `first` and on since the table was cleared."""
    held = (1 << bits) + 2 + np.maximum(np.arange(first, first + count) - 1, 0)
    out = np.full(count, bits + 1)
    for w in range(bits + 1, 12):
        out += held >= 1 << w
    return out


def packed_codes(codes: np.ndarray, wide: np.ndarray) -> bytes:
    """Codes one after the other, the lowest bit first."""
    ends = np.cumsum(wide)
    at = ends - wide
    shifted = codes.astype(np.int64) << (at & 7)
    size = int(ends[-1] + 7) // 8
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(shifted >> (8 * k)) & 255, minlength=size + 3)
    return out[:size].astype(np.uint8).tobytes()


def compressed(pixels: bytes, bits: int = BITS) -> bytes:
    """The LZW code stream of an image. A full table is kept to the image's end."""
    clear = 1 << bits
    codes: list[int] = []
    known: dict[int, int] = {}  # codes are held eight bits up, so that a pixel fits below
    add, look, free, end = codes.append, known.get, (clear + 2) << 8, TABLE << 8
    here = pixels[0] << 8
    for b in pixels[1:]:
        if code := look(here | b):
            here = code
            continue
        add(here)
        if free < end:
            known[here | b] = free
            free += 256
        here = b << 8
    codes += [here, (clear + 1) << 8]
    return packed_codes(np.array([clear << 8, *codes]) >> 8, np.concatenate([[bits + 1], widths(bits, 0, len(codes))]))


def codes_from(window: np.ndarray, at: int, total: int, bits: int) -> tuple[np.ndarray, int, int]:
    """(codes, what ended them, the place behind): the codes from bit `at` on up to the next that clears or ends, which is
    the second value; -1 where the stream breaks off before."""
    clear, since, found = 1 << bits, 0, []
    while True:
        wide = widths(bits, since, min(2 * TABLE, (total - at) // (bits + 1) + 1))
        ends = at + np.cumsum(wide)
        fit = int(np.searchsorted(ends, total, side="right"))
        begins = ends[:fit] - wide[:fit]
        codes = window[begins >> 3] >> (begins & 7) & (1 << wide[:fit]) - 1
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else fit
        found.append(codes[:stop])
        if stop < fit:
            return np.concatenate(found), int(codes[stop]), int(ends[stop])
        if fit < len(wide):
            return np.concatenate(found), -1, total
        since, at = since + fit, int(ends[-1])


def strings(codes: np.ndarray, clear: int, size: int) -> tuple[np.ndarray, bool]:
    """(bytes, whole) that codes since the table was cleared stand for, at most some more than `size`. Entry k of the table
    is what code k stands for and the byte after it, so a code that names it repeats the output from there on. Following
    these references, by doubling, ends at codes that are bytes themselves."""
    entry = codes - clear - 2
    odd = np.flatnonzero((entry >= np.minimum(np.arange(len(codes)), TABLE - clear - 2)) | (codes == clear) | (codes == clear + 1))
    entry = entry[: odd[0] if len(odd) else len(codes)]
    up = np.where(entry >= 0, entry, np.arange(len(entry)))
    sizes, to = (entry >= 0).astype(np.int64), up
    while (entry[to] >= 0).any():
        sizes, to = sizes + sizes[to], to[to]
    sizes += 1
    ends = np.cumsum(sizes)
    n = int(np.searchsorted(ends, size)) + 1
    whole = not len(odd) or n <= len(entry)
    sizes, ends, up, entry = sizes[:n], ends[:n], up[:n], entry[:n]
    if not len(ends):
        return np.zeros(0, dtype=np.uint8), whole
    begins = ends - sizes
    source = np.arange(ends[-1]) - np.repeat(begins - begins[up], sizes)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    plain = np.zeros(ends[-1], dtype=np.uint8)
    plain[begins[entry < 0]] = codes[: len(entry)][entry < 0]
    return plain[source], whole


def expanded(data: bytes, bits: int, size: int) -> tuple[bytes, str]:
    """(pixels, fault) of an LZW code stream: at most `size` pixels."""
    stream = np.frombuffer(data + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    window = stream[:-2] | stream[1:-1] << 8 | stream[2:] << 16
    clear, out, held, at = 1 << bits, [], 0, 0
    while held < size:
        codes, stop, at = codes_from(window, at, 8 * len(data), bits)
        part, whole = strings(codes, clear, size - held)
        out.append(part)
        held += len(part)
        if held < size and (not whole or stop != clear):
            return b"".join(p.tobytes() for p in out), "a code stands before its entry" if not whole else "the code stream breaks off" if stop < 0 else "the image ends early"
    return b"".join(p.tobytes() for p in out)[:size], ""


@dataclass
class Frame:
    """A picture (height, width, red-green-blue-alpha), when it comes and how long it stays; box is the part that was drawn."""

    picture: np.ndarray
    at_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]
    fault: str = ""


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The data of sub-blocks from `at` on, and the place behind them."""
    parts = []
    while data[at]:
        if at + 1 + data[at] > len(data):
            raise IndexError
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    """The colours (visible ones, so with alpha) of the table at `at`, if there is one, filled up with black."""
    if not flags & 0x80:
        return None, at
    size = 3 * (2 << (flags & 7))
    if at + size > len(data):
        raise IndexError
    out = np.zeros((256, 4), dtype=np.uint8)
    out[:, 3] = 255
    out[: size // 3, :3] = np.frombuffer(data, dtype=np.uint8, count=size, offset=at).reshape(-1, 3)
    return out, at + size


def decode(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF; the last one names a fault, if there is one (its picture is what was shown till then)."""
    canvas, at_ms = np.zeros((0, 0, 4), dtype=np.uint8), 0
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF")
        if len(data) < 13:
            raise IndexError
        wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        common, at = _palette(data, 13, flags)
        canvas = np.zeros((high, wide, 4), dtype=np.uint8)
        disposal, hundredths, clear_index, old, undo = 0, 0, -1, None, None
        while True:
            kind = data[at]
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[at + 1]
                held, at = _blocks(data, at + 2)
                if label == 0xF9 and len(held) >= 4:
                    disposal, hundredths = held[0] >> 2 & 7, held[1] | held[2] << 8
                    clear_index = held[3] if held[0] & 1 else -1
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            if at + 11 > len(data):
                raise IndexError
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, flags)
            bits = data[at]
            if not 1 <= bits <= 8:
                raise ValueError("a code size that no image has")
            held, at = _blocks(data, at + 1)
            pixels, fault = expanded(held, bits, w * h)
            # What the image before leaves behind: the ground under it, or what stood there before it.
            if old is not None:
                y, x, y2, x2 = old
                canvas[y:y2, x:x2] = 0 if undo is None else undo
            box = (min(top, high), min(left, wide), min(top + h, high), min(left + w, wide))
            y, x, y2, x2 = box
            old = box if disposal in (2, 3) else None
            undo = canvas[y:y2, x:x2].copy() if disposal == 3 else None
            index = np.frombuffer(pixels + bytes(w * h - len(pixels)), dtype=np.uint8).reshape(h, w)
            shown = None
            if len(pixels) < w * h or clear_index >= 0:
                shown = ((np.arange(w * h) < len(pixels)).reshape(h, w)) & (index != clear_index)
            if flags & 0x40:
                back = np.argsort(np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))]))
                index, shown = index[back], shown if shown is None else shown[back]
            colours = own if own is not None else common if common is not None else _palette(bytes(6), 0, 0x80)[0]
            part = canvas[y:y2, x:x2]
            drawn = colours[index[: y2 - y, : x2 - x]]
            if shown is None:
                part[...] = drawn
            else:
                seen = shown[: y2 - y, : x2 - x]
                part[seen] = drawn[seen]
            yield Frame(canvas.copy(), at_ms, 10 * hundredths, box, fault)
            if fault:
                return
            at_ms += 10 * hundredths
            disposal, hundredths, clear_index = 0, 0, -1
    except (IndexError, struct.error):
        yield Frame(canvas.copy(), at_ms, 0, (0, 0, 0, 0), "the file breaks off")
    except ValueError as e:
        yield Frame(canvas.copy(), at_ms, 0, (0, 0, 0, 0), str(e))


def histogram(picture: np.ndarray) -> np.ndarray:
    """Visible pixels by steps of red, green and blue; the invisible ones come last."""
    red, green, blue, alpha = (np.ascontiguousarray(picture[..., k]).ravel() for k in range(4))
    step = 256 // LEVELS
    bins = (red // step * LEVELS + green // step) * LEVELS + blue // step
    bins[alpha == 0] = LEVELS**3
    return np.bincount(bins, minlength=LEVELS**3 + 1)


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled up to a positive multiple of ROW."""
    return text + bytes([FILL]) * (max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def encode(payload: bytes) -> bytes:
    """An animated GIF of a payload, whole rows of ROW bytes: the next HEIGHT rows a frame."""
    rows = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, HEIGHT), 0x80 | 0x70 | BITS - 1, 0, 0), PALETTE.tobytes()]
    for at in range(0, len(payload), ROW * HEIGHT):
        part = payload[at : at + ROW * HEIGHT]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0) + struct.pack("<BHHHHBB", 0x2C, 0, 0, ROW, len(part) // ROW, 0, BITS))
        codes = compressed(part)
        out += [bytes([len(codes[k : k + 255])]) + codes[k : k + 255] for k in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in chunks([len(v.as_buffer()) if v.is_valid else 0 for v in b.column(column)], BATCH_ROWS, BATCH_BYTES):
            yield b.slice(s.start, s.stop - s.start)


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a GIF, written to the shared folder and read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "media": pa.array([encode(payload_of(t)) for t in texts], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(texts.mapInArrow(run, "doc_id long, n_bytes long, media binary"), docs.sparkSession)


def frames(media: DataFrame) -> DataFrame:
    """A row for each frame of (doc_id, media), as FRAME_SCHEMA; pixels are red, green, blue and alpha, by rows."""
    names = ["doc_id", "frame", "at_ms", "delay_ms", "width", "height", "pixels", "histogram", "fault"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True):
                if data.is_valid:
                    for n, f in enumerate(decode(data.as_py())):
                        rows.append((doc, n, f.at_ms, f.delay_ms, f.picture.shape[1], f.picture.shape[0], f.picture.tobytes(), histogram(f.picture).tolist(), f.fault or None))
                        held += f.picture.size
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, FRAME_SCHEMA)


def described(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digests, feature) of stored payloads: what the decoded pictures hold, read back through red, and
    the feature: frames, milliseconds and the summed histogram's filled bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media"):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in b.column("media").to_pylist():
                digest, size, tail, n, lasts, colours = hashlib.sha256(), 0, b"", 0, 0, np.zeros(LEVELS**3 + 1, dtype=np.int64)
                for f in decode(data):
                    if f.fault:
                        raise ValueError(f"a stored payload can't be read: {f.fault}")
                    y, x, y2, x2 = f.box
                    part = np.ascontiguousarray(f.picture[y:y2, x:x2, 0]).tobytes()
                    digest.update(part)
                    size, tail, n, lasts = size + len(part), (tail + part[-32:])[-32:], n + 1, lasts + f.delay_ms
                    colours += histogram(f.picture[y:y2, x:x2])
                row = (size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"{n};{lasts};" + ",".join(f"{k}:{colours[k]}" for k in np.flatnonzero(colours)))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes")} | {k: pa.array(v, pa.string() if k.endswith(("sha256", "feature")) else pa.int64()) for k, v in out.items()})

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
