"""Similarity joins, shifted rows and guards against plain loops."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lumenfold.operators import guards as U
from lumenfold.operators import likeness as L


def vectors(rows):
    """TF-IDF at unit length, by the book."""
    cut = {}
    for k, t in rows:
        words = re.findall(r"[A-Za-z0-9_]{2,}", (t or "").lower())
        if words:
            cut[k] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(t for c in cut.values() for t in c)
    out = {}
    for k, c in cut.items():
        raw = {t: n * (math.log((1 + len(cut)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out[k] = {t: v / norm for t, v in raw.items()}
    return out


@pytest.mark.parametrize(("k", "least"), [(3, 0.05), (30, 0.5)])
def test_most_alike(spark, k, least):
    rnd = random.Random(k)
    word = lambda: "w" + str(int(rnd.paretovariate(0.8)) % 60)
    rows = [(i, " ".join(word() for _ in range(rnd.randrange(1, 12)))) for i in range(70)]
    rows += [(100 + i, "same old words again") for i in range(12)] + [(200, None), (201, ""), (202, "a b"), (203, "only here")]
    v = vectors(rows)
    want = set()
    for a in v:
        scored = sorted((-s, b) for b in v if b != a and (s := round(sum(x * v[b].get(t, 0) for t, x in v[a].items()), 6)) >= least)
        want |= {(a, b, r + 1, round(-s, 5)) for r, (s, b) in enumerate(scored[:k])}
    df = spark.createDataFrame(rows, "key long, text string").repartition(3)
    got = [tuple(r) for r in L.most_alike(df, "key", "text", k, least).collect()]
    assert {(a, b, r, round(s, 5)) for a, b, r, s in got} == want and len(got) == len(want)


def test_cosine_candidates_are_few(spark):
    """Copies are one class, and a word that all share brings no pairs together."""
    rows = [(i, f"common words here x{i} y{i} z{i} q{i}") for i in range(300)] + [(1000 + i, "copied text of many rows") for i in range(200)]
    df = spark.createDataFrame(rows, "key long, text string")
    _, kinds = L.classes(df, "key", L.grams(df["text"]))
    assert kinds.count() == 301
    assert L.cosines(L.weighted(kinds), 0.6).count() == 0
    found = L.most_alike(df, "key", "text", 2, 0.6).collect()
    assert {r["a"] for r in found} == {1000 + i for i in range(200)} and len(found) == 400
    assert {r["b"] for r in found} == {1000, 1001, 1002}
    assert L.most_alike(df.limit(0), "key", "text", 2, 0.6).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.9])
def test_alike_sets(spark, least):
    rnd = random.Random(4)
    rows = [(i, i % 3, [f"t{rnd.randrange(12)}" for _ in range(rnd.randrange(0, 9))]) for i in range(120)] + [(500, 0, None)]
    df = spark.createDataFrame(rows, "id long, scope int, items array<string>")
    want = {}
    for a, s, x in rows:
        for b, t, y in rows:
            if a < b and s == t and x and y and (j := len({*x} & {*y}) / len({*x} | {*y})) >= least - 1e-12:
                want[a, b] = round(j, 9)
    got = {(r["a"], r["b"]): round(r["score"], 9) for r in L.alike_sets(df, "id", "items", least, ["scope"]).collect()}
    assert got == want


def test_overlapping_scopes(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(3), i, lo := rnd.randrange(60), lo + rnd.choice((0, 1, 5, 30)), [rnd.choice("abcdefgh") for _ in range(rnd.randrange(4))]) for i in range(150)]
    df = spark.createDataFrame([*rows, (0, 900, None, None, ["a"])], "file int, id long, lo int, hi int, roots array<string>")
    df = df.withColumn("roots", L.roots(df["roots"], L.F.lit("")))
    got = [(r["file"], r["a"], r["b"], tuple(r["shared"])) for r in L.overlapping(df).collect()]
    want = {(f, a, b, tuple(sorted({*x} & {*y}))) for f, a, la, ha, x in rows for g, b, lb, hb, y in rows if f == g and a < b and la <= hb and lb <= ha and {*x} & {*y}}
    assert set(got) == want and len(got) == len(want)
    texts = spark.createDataFrame([(None, "user.Name is not NULL and len(x_1) > 2"), (["A.b", "a.c", "D"], "zz")], "names array<string>, text string")
    assert [r[0] for r in texts.select(L.roots(texts["names"], texts["text"])).collect()] == [["user", "name", "x_1"], ["a", "d"]]


def test_shifted_like_the_loop(spark):
    rnd = random.Random(6)
    side = lambda n: [(rnd.choice(("k", "l", None)), rnd.randrange(3), f"d{rnd.randrange(60):02d}") for _ in range(n)]
    base, cand = sorted(set(side(70)), key=str), side(50)
    free = defaultdict(list)
    for a, b, i in sorted(set(cand), key=str):
        free[a, b].append(i)
    want = []
    for a, b, i in sorted(base, key=lambda r: r[2]):
        want.append((a, b, i, free[a, b].pop(0), "shifted") if free[a, b] else (a, b, i, None, "resolved"))
    want += [(a, b, None, i, "introduced") for (a, b), rest in free.items() for i in rest]
    make = lambda rows: spark.createDataFrame(rows, "x string, y int, id string").repartition(4)
    got = [tuple(r) for r in L.shifted(make(base), make(cand), ["x", "y"], "id", ["id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbered_over_partitions(spark):
    df = spark.range(3000).selectExpr("id % 2 as k", "(id * 7919) % 3000 as v").repartition(5)
    got = L.numbered(df, ["k"], ["v"], "n").collect()
    for k in (0, 1):
        assert [r["n"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["v"])] == list(range(1, 1501))


CASE = {"expression": "row.owner_id == current_user.id", "guard_file": "a.py", "guard_line": 5, "guard_function": "C.f", "guard_value": "owner_id", "sink_file": "A.py", "sink_line": 9, "sink_function": "c.F", "sink_value": "owner_id", "case_type": "idor_bola_possible", "result_used": True}
QUESTIONS = [
    ({}, "", None),
    ({"expression": "print(x)"}, "unknown_type", "flow_not_demonstrated"),
    ({"expression": "print(x)", "category": "Ownership_Guard"}, "", None),
    ({"sink_file": "b.py"}, "other_file", "guard_in_unrelated_context"),
    ({"sink_file": "b.py", "call_path": True}, "", None),
    ({"sink_function": "D.f"}, "other_function", "guard_in_unrelated_context"),
    ({"sink_function": "f"}, "", None),
    ({"guard_route": "/x/", "sink_route": "/y"}, "other_route", "guard_in_unrelated_context"),
    ({"guard_route": "/X/", "sink_route": "x"}, "", None),
    ({"guard_line": 10}, "after_sink", "guard_after_sink"),
    ({"source_line": 6}, "before_source", "guard_on_different_value"),
    ({"sink_value": ""}, "no_sink_value", "guard_not_resource_bound"),
    ({"expression": "escape(x)", "sink_value": "", "case_type": "xss_possible"}, "no_sink_value", "flow_not_demonstrated"),
    ({"sink_value": "name"}, "other_value", "guard_on_different_value"),
    ({"guard_value": "base_dir", "sink_value": "base_dir.x"}, "other_value", "guard_on_different_value"),
    ({"result_used": False}, "query_apart", "guard_not_resource_bound"),
    ({"expression": "escape(x)", "case_type": "xss_possible", "result_used": False}, "ignored_result", "sanitizer_result_unused"),
    ({"expression": "commonpath(x)", "case_type": "path_traversal", "result_used": False}, "result_apart", "flow_not_demonstrated"),
    ({"bypass": True}, "bypass", "guard_not_resource_bound"),
    ({"case_type": "xss_possible"}, "wrong_type", "flow_not_demonstrated"),
    ({"expression": "value.is_normalized", "category": "sanitizer_guard", "case_type": "path_traversal"}, "wrong_type", "flow_not_demonstrated"),
    ({"expression": "@login_required"}, "login_only", "authentication_only"),
    ({"expression": "has_role('admin')"}, "not_bound", "guard_not_resource_bound"),
    ({"expression": "has_role('admin')", "case_type": "admin_access"}, "", None),
    ({"expression": "query.filter_by(owner_id)"}, "", None),
    ({"expression": "query.filter_by(name)"}, "not_bound", "guard_not_resource_bound"),
    ({"guard_function": "", "result_used": None}, "no_path", "flow_not_demonstrated"),
    ({"guard_function": "", "direct": True}, "", None),
]


def test_questions_to_a_guard(spark):
    names = {**dict.fromkeys(("expression", "category", "guard_file", "guard_function", "guard_route", "guard_value", "sink_file", "sink_function", "sink_route", "sink_value", "case_type"), "string"), **dict.fromkeys(("guard_line", "source_line", "sink_line"), "int"), **dict.fromkeys(("direct", "propagated", "call_path", "bypass", "result_used"), "boolean")}
    rows = [(i, *[({**CASE, **change}).get(n) for n in names]) for i, (change, _, _) in enumerate(QUESTIONS)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} {t}" for n, t in names.items()))
    got = {r["id"]: r for r in U.assessed(df).collect()}
    for i, (change, code, blocker) in enumerate(QUESTIONS):
        assert (got[i]["code"], got[i]["blocker"], got[i]["applicable"]) == (code, blocker, code == ""), change
        assert got[i]["reason"] == U.REASONS[code]
    bare = U.assessed(spark.createDataFrame([(1, "escape(x)")], "id int, expression string")).first()
    assert (bare["code"], bare["guard_class"]) == ("wrong_type", "sanitizer_guard")
    both = U.protected(U.assessed(df.withColumn("case", L.F.lit(1))), "case").first()
    assert both["strong_guard"] and both["admin_guard"] and len(both["blockers"]) == 7
