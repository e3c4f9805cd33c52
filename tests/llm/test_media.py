"""GIF columns: round trips, streams of other writers with disposal, transparency and interlacing, and broken ones."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lumenfold.llm import media

GREYS = bytes(v for k in range(4) for v in (k * 80, k * 80, k * 80))


def plain_codes(data, bits):
    """The codes of a stream by the book: one at a time, the width from the table's size."""
    clear, out, table, prev, width, at = 1 << bits, b"", {}, None, bits + 1, 0
    number = int.from_bytes(data, "little")
    while at + width <= 8 * len(data):
        code = number >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, prev, width = {}, None, bits + 1
            continue
        if code == clear + 1:
            break
        piece = bytes([code]) if code < clear else table[code] if code in table else prev + prev[:1]
        if prev is not None and clear + 2 + len(table) < 4096:
            table[clear + 2 + len(table)] = prev + piece[:1]
        if clear + 2 + len(table) == 1 << width and width < 12:
            width += 1
        prev, out = piece, out + piece
    return out


def gif(images, size=(4, 4), palette=GREYS):
    """A GIF of (left, top, width, height, pixels, disposal, delay, transparent or None, interlaced, own palette or None)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x80 | 1, 0, 0) + palette + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    for left, top, w, h, pixels, disposal, delay, clear, lace, own in images:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, (0x80 | 1 if own else 0) | (0x40 if lace else 0)) + (own or b"")
        codes = media.compressed(bytes(pixels), 2)
        out += b"\x02" + b"".join(bytes([len(codes[k : k + 7])]) + codes[k : k + 7] for k in range(0, len(codes), 7)) + b"\0"
    return out + b"\x3b"


def samples():
    rnd = random.Random(4)
    yield from (b"\xff" * 576, bytes(576), b"ab" * 288 * 70, bytes(rnd.randrange(256) for _ in range(576 * 130)), bytes(rnd.choice(b"aab") for _ in range(576 * 90)))
    yield " ".join(rnd.choice(("alpha", "beta", "é", "gamma")) for _ in range(40_000)).encode()


@pytest.mark.parametrize("data", list(samples()))
def test_round_trip(data):
    payload = media.payload_of(data)
    found = list(media.decode(media.encode(payload)))
    assert b"".join(f.picture[f.box[0] : f.box[2], f.box[1] : f.box[3], 0].tobytes() for f in found) == payload
    assert [f.at_ms for f in found] == [100 * k for k in range(len(found))] and not any(f.fault for f in found)
    part = payload[: 576 * 64]
    codes = media.compressed(part)
    assert media.expanded(codes, 8, len(part)) == (part, "") and plain_codes(codes, 8) == part


def test_small_alphabets_and_cleared_tables():
    rnd = random.Random(5)
    for bits in (2, 3, 5, 8):
        for n in (1, 2, 700, 20_000):
            data = bytes(rnd.randrange(min(1 << bits, 3)) for _ in range(n))
            codes = media.compressed(data, bits)
            assert plain_codes(codes, bits) == data and media.expanded(codes, bits, n) == (data, "")
    # A writer that clears after every code, and one that clears in the middle.
    each = [256 if k % 2 == 0 else k // 2 % 200 for k in range(400)] + [257]
    wide = np.full(len(each), 9)
    assert media.expanded(media.packed_codes(np.array(each), wide), 8, 200) == (bytes(k % 200 for k in range(200)), "")


def test_disposal_transparency_and_times():
    base = [1] * 16
    red = bytes((255, 0, 0)) * 4
    got = list(media.decode(gif([
        (0, 0, 4, 4, base, 1, 5, None, False, None), (1, 1, 2, 2, [2, 3, 3, 2], 2, 7, 3, False, None),
        (0, 0, 2, 1, [0, 2], 3, 1, None, False, red), (3, 3, 5, 5, [2] * 25, 0, 2, None, False, None),
    ])))
    assert [(f.at_ms, f.delay_ms) for f in got] == [(0, 50), (50, 70), (120, 10), (130, 20)]
    grey = lambda f: f.picture[..., 0].tolist()
    assert grey(got[0]) == [[80] * 4] * 4 and grey(got[1]) == [[80] * 4, [80, 160, 80, 80], [80, 80, 160, 80], [80] * 4]
    # The second is cleared to nothing before the third is drawn; the third gives back what stood there.
    assert got[2].picture[1, 1].tolist() == [0, 0, 0, 0] and got[2].picture[0, 0].tolist() == [255, 0, 0, 255] and got[2].picture[0, 2].tolist() == [80, 80, 80, 255]
    assert got[3].picture[0, 0].tolist() == [80, 80, 80, 255] and got[3].picture[3, 3].tolist() == [160, 160, 160, 255] and got[3].box == (3, 3, 4, 4)
    assert media.histogram(got[2].picture).sum() == 16 and media.histogram(got[2].picture)[-1] == 4
    laced = list(media.decode(gif([(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], 1, 0, None, True, None)], (1, 9))))[0]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    assert [laced.picture[y, 0, 0] // 80 for y in order] == [0, 1, 2, 3, 0, 1, 2, 3, 0]


def test_broken_streams():
    whole = gif([(0, 0, 4, 4, [1, 2] * 8, 1, 5, None, False, None)] * 3)
    for data in (b"", b"PNG", b"GIF89a", whole[:30]):
        assert [bool(f.fault) for f in media.decode(data)] == [True]
    for cut in range(13, len(whole)):
        found = list(media.decode(whole[:cut]))
        assert found[-1].fault and not any(f.fault for f in found[:-1]) and len(found) <= 4
    rnd = random.Random(6)
    for _ in range(500):  # nothing raises, whatever the bytes are
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 4)):
            data[rnd.randrange(13, len(data))] = rnd.randrange(256)
        if struct.unpack_from("<HHHH", data, data.index(0x2C) + 1 if 0x2C in data else 0)[2] < 5000:
            list(media.decode(bytes(data[:6]) + whole[6:13] + bytes(data[13:])))
    assert media.expanded(media.packed_codes(np.array([256, 65, 300, 257]), np.full(4, 9)), 8, 10)[1] == "a code stands before its entry"


def test_columns(spark):
    texts = [None, "", "a", "x" * 575, "y" * 576, "z" * 577, "é🙂" * 9000, "word " * 200_000, "a"]
    df = spark.createDataFrame([(i if i != 5 else None, t, "k", b"m") for i, t in enumerate(texts)], "doc_id long, text string, feature string, media binary").repartition(3)
    kept = media.stored(df)
    got = {r["doc_id"]: r for r in media.described(kept).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[i if i != 5 else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        pixels = np.frombuffer(payload, dtype=np.uint8).astype(int)
        bins = np.bincount((pixels // 64 * 4 + pixels * 37 % 256 // 64) * 4 + pixels * 101 % 256 // 64, minlength=64)
        n = -(-len(payload) // (576 * 64))
        assert r["feature"] == f"{n};{100 * n};" + ",".join(f"{k}:{v}" for k, v in enumerate(bins) if v)
    assert got[2][1:] == got[8][1:]
    media_of = {r["doc_id"]: r["media"] for r in kept.collect()}
    for i, r in got.items():
        assert (r["media_bytes"], r["media_sha256"]) == (len(media_of[i]), hashlib.sha256(media_of[i]).hexdigest())
    rows = media.frames(kept.filter("doc_id in (2, 6)").union(spark.createDataFrame([(50, 0, b"junk"), (51, 0, None)], kept.schema))).collect()
    by = sorted((r["doc_id"], r["frame"]) for r in rows)
    assert by == [(2, 0), (6, 0), (6, 1), (50, 0)] and {r["fault"] for r in rows if r["doc_id"] != 50} == {None}
    for r in rows:
        assert len(r["pixels"]) == 4 * r["width"] * r["height"] == 4 * sum(r["histogram"])
    empty = df.limit(0)
    assert media.described(media.stored(empty)).count() == 0 and media.frames(media.stored(empty)).count() == 0
