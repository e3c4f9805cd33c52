"""The threshold algorithm against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import lexical


def brute(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parsed = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in parsed), sum(sum(c.values()) for _, c in parsed)
    df = Counter(t for _, c in parsed for t in c)
    out = []
    for item, text in items:
        own = set(cut(text))
        scored = []
        for doc, c in parsed:
            if c:
                m = 50 + 50 * sum(c.values()) * n_docs // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own & set(c))
                if s > 0:
                    scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(rnd, n):
    word = lambda: "w" + str(int(rnd.paretovariate(0.7)) % 400)
    texts = [" ".join(word() for _ in range(rnd.randrange(0, 60))) for _ in range(n)]
    return [*texts, *texts[:20], "É é Ünï 中文 straße", "W1.w2,w3_W4\x00w5\x7fw6", " ", "w1 " * 30_000, None]


def test_equal_to_brute_force(spark):
    rnd = random.Random(2)
    docs = [(i if i % 50 else None if i == 100 else i // 2, t) for i, t in enumerate(corpus(rnd, 300))]
    items = [(1, "w1 w2 w3 W1"), (2, "w399 é"), (3, None), (4, ""), (5, "nowhere"), (6, "中文 É w7; w9"), (None, "w5 w6"), (8, " ".join(f"w{k}" for k in range(400))), (2, "w8 w3")]
    d = spark.createDataFrame([(*r, "x", 7) for r in docs], "doc_id long, text string, terms string, n int").repartition(5)
    q = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, score int")
    for k in (1, 3, 50):
        got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(d, q, k).collect()), key=str)
        assert got == brute(docs, items, k)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    rnd = random.Random(3)
    docs = list(enumerate(corpus(rnd, 80)))
    items = [(i, " ".join(f"w{rnd.randrange(60)}" for _ in range(6))) for i in range(9)] + [(9, " ".join(f"w{k}" for k in range(40)))]
    monkeypatch.setattr(lexical, "TERMS", 14)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(lexical.blocks(q.select("item_id", q["text"].cast("binary").alias("text"))))) > 3
    assert sorted((tuple(r) for r in lexical.search(d, q, 5).collect()), key=str) == brute(docs, items, 5)


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_shards_stop_early_and_lose_nothing(size):
    """Shards of any size, one after the other, keep the best of all; ties at the k-th score go to smaller ids."""
    rnd = np.random.default_rng(size)
    n, terms, k = 3000, 40, 10
    rows = [np.sort(rnd.choice(terms, rnd.integers(1, 9), replace=False)) for _ in range(n)]
    counts = [rnd.integers(1, 4, len(r)) for r in rows]
    sizes, weights = rnd.integers(9, 60, n), np.concatenate([[9000, 90, 70], rnd.integers(0, 30, terms - 3)])
    ids = rnd.permutation(n)
    own = np.array([0, 1, 2, 5, 9])
    mark = np.zeros(terms, dtype=bool)
    mark[own] = True
    best, read = lexical.Best(k), 0
    for at in range(0, n, size):
        part = slice(at, at + size)
        cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows[part]])])
        shard = lexical.Shard(ids[part], np.zeros(len(ids[part]), bool), sizes[part], cuts, np.concatenate(rows[part]), np.concatenate(counts[part]), weights, n, int(sizes.sum()))
        read += shard.search(own, mark, best)
    m = 50 + 50 * sizes * n // int(sizes.sum())
    scores = [sum(int(weights[t]) * (10**9 * int(c) // (1000 * int(c) + 20 * int(m[i]))) for t, c in zip(rows[i], counts[i], strict=True) if mark[t]) for i in range(n)]
    want = sorted((-s, int(ids[i])) for i, s in enumerate(scores) if s > 0)[:k]
    assert [(-s, d) for s, d in zip(best.scores.tolist(), best.ids.tolist(), strict=True)] == want
    if size == 5000:
        assert read < sum(int(mark[r].sum()) for r in rows)
