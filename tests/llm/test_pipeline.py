"""Each stage of the pipeline on the smallest tables against a plain version of it; then the whole run."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from lumenfold.llm import mixing, packing, simhash
from lumenfold.llm.common import written

DATA = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    found = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in P.STAGES[:-1]:
        found.append(written(stage(spark, found[-1], DATA), spark))
    return found


def rows(df):
    return [r.asDict() for r in df.collect()]


def good_line(line):
    got, n = words(line), len(words(line))
    bars, symbols = sum(line.count(c) for c in "|»›•"), sum(line.count(c) for c in "#*$%&|<>")
    letters = [c for c in line if c.isalpha()]
    shouted = n >= 3 and any(c.isupper() for c in letters) and not any(c.islower() for c in letters)
    marks = sum(bool(re.search(r"([!?]{2,}|\.{4,})$", w)) for w in got)
    return not (shouted or (n >= 3 and marks * 3 > n) or (bars >= 2 and bars * 3 >= n - bars) or symbols * 10 > sum(map(len, got)))


def test_columns_stay(stages):
    assert all(tuple(s.columns) == P.COLUMNS for s in stages)


def test_quality(stages):
    want = {}
    for r in rows(stages[0]):
        got = words(r["text"])
        windows = Counter(tuple(got[i : i + 5]) for i in range(len(got) - 4))
        under = {j for i in range(len(got) - 4) if windows[tuple(got[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = list(dict.fromkeys(x for x in (r["text"] or "").split("\n") if words(x)))
        left = [x for x in lines if good_line(x)]
        size, kept = sum(map(len, got)), sum(len(w) for x in left for w in words(x))
        if len(got) >= 10 and 100 * len(under) <= 20 * len(got) and 100 * (size - kept) <= 50 * size and sum(len(words(x)) for x in left) >= 10:
            want[r["doc_id"]] = "\n".join(left) if kept < size else r["text"]
    assert {r["doc_id"]: r["text"] for r in rows(stages[1])} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows(stages[1]))


def test_near_duplicates(stages):
    prints = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in rows(stages[1])]
    root = {i: i for i, _ in prints}
    for _ in range(len(prints)):
        new = {i: min(root[j] for j, q in prints if ((p ^ q) & (1 << 64) - 1).bit_count() <= 3) for i, p in prints}
        if new == root:
            break
        root = new
    assert sorted(r["doc_id"] for r in rows(stages[2])) == sorted(i for i in root if root[i] == i)


def test_secrets(stages):
    before = {r["doc_id"]: r["text"] for r in rows(stages[2])}
    after = {r["doc_id"]: r["text"] for r in rows(stages[3])}
    assert before.keys() == after.keys()
    secret = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}""")
    for i, text in before.items():
        assert (after[i] == text) == (not secret.search(text)) and not secret.search(after[i])


def test_mixture(stages):
    before = {r["doc_id"]: r["text"] for r in rows(stages[3])}
    out, plan = rows(stages[4]), mixing.Plan()
    total = sum(len(words(t)) for t in before.values())
    taken = sum(len(words(r["text"])) for r in out)
    assert taken <= total * plan.percent // 100
    times = Counter(r["doc_id"] for r in out)
    assert max(times.values()) <= plan.max_epochs
    cut = [r for r in out if r["text"] != before[r["doc_id"]]]
    assert all(before[r["doc_id"]].startswith(r["text"]) for r in cut) and len(cut) <= len({(r["lang"], r["source"]) for r in out})
    share = defaultdict(int)
    for r in out:
        share["domain" + str(int(re.search(r"[0-9]+$", r["source"])[0]) % 4)] += len(words(r["text"]))
    supply = Counter()
    for r in rows(stages[3]):
        supply["domain" + str(int(re.search(r"[0-9]+$", r["source"])[0]) % 4)] += plan.max_epochs * len(words(r["text"]))
    low = {d: min(supply[d], total * w // 100) for d, w in plan.domains.items()}
    assert all(share[d] >= low[d] - 1 for d in low)


def test_run(spark, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = rows(P.run(spark, DATA))
    ids = {}
    for r in rows(stages[4]):
        ids.setdefault(r["doc_id"], []).append(np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [2], dtype="<u4"))
    lengths = Counter()
    for r in got:
        lengths[r["doc_id"]] += r["length"]
        assert any(len(x) == r["doc_tokens"] and packing.zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert lengths == {i: sum(map(len, x)) for i, x in ids.items()}
