"""Diffs against difflib, order of events against a stack, canonical JSON against Python's."""

import difflib
import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from lumenfold.functions import canonical as C
from lumenfold.operators import temporal as T
from lumenfold.plans import catalog, history
from lumenfold.sources import patches as P
from tests.test_library import assert_matches_sql, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(n for n, f in catalog.QUERIES.items() if f.__module__ == history.__name__ and n in catalog.SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    assert_matches_sql(spark, duck, name)


def versions(rnd, n):
    """Versions of a file whose lines are all different, so that a line can be known again."""
    lines, out, fresh = [f"line {k}" for k in range(20)], [], 100
    out.append(list(lines))
    for _ in range(n):
        for _ in range(rnd.randrange(1, 5)):
            if rnd.random() < 0.5 and len(lines) > 3:
                del lines[rnd.randrange(len(lines))]
            else:
                lines.insert(rnd.randrange(len(lines) + 1), f"line {fresh}")
                fresh += 1
        out.append(list(lines))
    return out


def test_lines_are_followed_and_blamed(spark):
    rnd = random.Random(3)
    files = {f"dir/f{k}.py": versions(rnd, rnd.randrange(1, 6)) for k in range(4)}
    files["name with blank.py"] = versions(rnd, 2)
    patches, number = [], 0
    for step in range(6):
        for path, vs in files.items():
            if step + 1 < len(vs) and vs[step] != vs[step + 1]:
                q = lambda side, path=path: f'"{side}/{path}"' if " " in path else f"{side}/{path}"
                body = "\n".join(difflib.unified_diff(vs[step], vs[step + 1], q("a"), q("b"), lineterm="", n=rnd.choice((0, 3))))
                patches.append((number, path, step, f"diff --git {q('a')} {q('b')}\nindex 1..2\n{body}"))
                number += 1
    df = spark.createDataFrame([(n, t) for n, _, _, t in patches] + [(900, None), (901, ""), (902, "no diff at all\n@@ nothing")], "patch long, text string").repartition(3)
    lines = P.diff_lines(df)
    by = {n: (path, step) for n, path, step, _ in patches}
    found = lines.collect()
    assert {r["patch"] for r in found} == set(by)
    for r in found:
        path, step = by[r["patch"]]
        old, new = files[path][step], files[path][step + 1]
        assert r["old_path"] == r["new_path"] == path
        if r["kind"] != "+":
            assert old[r["old_line"] - 1] == r["text"]
        if r["kind"] != "-":
            assert new[r["new_line"] - 1] == r["text"]
    claims, ends = [], {}
    for path, vs in files.items():
        claims += [(f"{path}:{k}", path, k + 1) for k in range(len(vs[0]))]
        ends |= {(path, text): k + 1 for k, text in enumerate(vs[-1])}
    changes = P.edits(lines)
    got = {r["id"]: r for r in P.followed(spark.createDataFrame(claims, "id string, path string, line long"), changes).collect()}
    assert len(got) == len(claims)
    for i, path, line in claims:
        text = files[path][0][line - 1]
        if (path, text) in ends:
            assert (got[i]["line"], got[i]["lost"]) == (ends[path, text], None)
        else:
            step = by[got[i]["lost"]][1]
            assert text in files[path][step] and text not in files[path][step + 1] and files[path][step][got[i]["line"] - 1] == text
    asked = [(f"{path}:{k}", path, k + 1) for path, vs in files.items() for k in range(len(vs[-1]))]
    for r in P.blamed(spark.createDataFrame(asked, "id string, path string, line long"), changes).collect():
        path, k = r["id"].rsplit(":", 1)
        text = files[path][-1][int(k)]
        if r["introduced"] is None:
            assert files[path][0][r["line"] - 1] == text
        else:
            step = by[r["introduced"]][1]
            assert text not in files[path][step] and files[path][step + 1][r["line"] - 1] == text


def test_odd_diffs(spark):
    text = "\n".join(["preface", "@@ -1 +1 @@", "-lost without a file", "diff --git a/x b/x", "@@ -3 +4,2 @@ def f(): ", " a", "+b", "\\ No newline at end of file", "diff --git broken", "@@ -1 +1 @@", "-c", "diff --git a/y b/z", "--- a/y", "@@ -9,0 +10 @@", "+d", ""])
    got = [tuple(r) for r in P.diff_lines(spark.createDataFrame([(1, text)], "patch int, text string")).orderBy("seq").collect()]
    assert [(r[2], r[3], r[5], r[6], r[7], r[8]) for r in got if r[2] in ("x", "y")] == [("x", "x", " ", 3, 4, "a"), ("x", "x", "+", 4, 5, "b"), ("y", "z", "+", 10, 10, "d"), ("y", "z", " ", 10, 11, "")]
    assert [(r[5], r[8]) for r in got if r[5] == "fault"] == [("fault", "diff --git broken")]
    parts = {r["new_path"]: (list(r["removed"]), list(r["added"])) for r in P.hunks(P.diff_lines(spark.createDataFrame([(1, text)], "patch int, text string"))).collect() if r["new_path"]}
    assert parts["x"] == ([], [5]) and parts["z"] == ([], [10])


def test_unreleased_like_a_stack(spark):
    rnd = random.Random(9)
    rows = [(u, k, rnd.choice((1, 1, -1, 0, None))) for u in (1, 2, 3, None) for k in range((5, 60, 400, 30)[u or 0])]
    want = set()
    for u in (1, 2, 3, None):
        stack = []
        for v, k, s in rows:
            if v == u and s == 1:
                stack.append((u, k, len(stack) + 1))
            elif v == u and s == -1 and stack:
                stack.pop()
        want |= set(stack)
    df = spark.createDataFrame(rows, "unit int, at int, step int").repartition(3)
    got = T.unreleased(df, ["unit"], ["at"], "step").collect()
    assert {(r["unit"], r["at"], r["held"]) for r in got} == want and len(got) == len(want)
    names = spark.createDataFrame([("db.connect",), ("db.disconnect",), ("mutex_lock.acquire",), ("lock.release",), ("open",), ("reopen.close",), ("commit",), ("print",)], "op string")
    kinds = T.steps(names["op"])
    assert [tuple(r) for r in names.select(*[kinds[k] for k in ("resource", "lock", "file")]).collect()] == [(1, 0, 0), (0, 0, 0), (1, 1, 0), (0, -1, 0), (1, 0, 1), (0, 0, -1), (-1, 0, 0), (0, 0, 0)]


SCHEMA = "id int, v struct<a: struct<z: int, b: array<double>, `odd key`: string>, m: map<string, array<map<string, boolean>>>, d: double, f: float, t: boolean, s: string, n: long>"


def test_canonical_json(spark):
    rnd = random.Random(8)
    texts = ["", "plain", 'q"\\/', "é中🙂 \x00\x1f\x7f\b\f\n\r\t", "é" * 300, "😀x"]
    numbers = [0.0, -0.0, 1.0, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 0.1 + 0.2, 1e300, 5e-324, 1.7976931348623157e308, 8.41e21, 2e23, 100.0, -2.5e-7, 5.684341886080802e-14]
    numbers += [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(300)] + [round(rnd.uniform(-1e6, 1e6), rnd.randrange(8)) for _ in range(200)]
    numbers = [x for x in numbers if x == x and abs(x) != float("inf")]
    rows = []
    for i, x in enumerate(numbers):
        s = texts[i % len(texts)]
        single = struct.unpack("<f", struct.pack("<f", i / 7))[0]
        rows.append(({"z": i, "b": [x, None, float(i)], "odd key": s}, {s: [{"y": True, "x": None}], "B": [], "a": None}, x, single, i % 2 == 0 or None, s, -(1 << 62) + i))
    rows += [(None,) * 7, ({"z": None, "b": [], "odd key": None}, {}, None, None, None, None, None)]
    df = spark.createDataFrame(list(enumerate(rows)), SCHEMA)
    kind = df.schema["v"].dataType
    got = {r["id"]: (r["json"], r["digest"]) for r in df.select("id", C.canonical(F.col("v"), kind).alias("json"), C.digest(F.col("v"), kind).alias("digest")).collect()}
    wrong = []
    for i, r in enumerate(rows):
        value = dict(zip(("a", "m", "d", "f", "t", "s", "n"), r, strict=True))
        want = json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"), allow_nan=False)
        if got[i][0] != want:
            wrong.append((want, got[i][0]))
        assert got[i][1] == hashlib.sha256(got[i][0].encode()).hexdigest()
    assert not wrong, wrong[:3]
    odd = spark.createDataFrame([([float("nan")],), ([1.0],), (None,)], "v array<double>")
    assert [r[0] for r in odd.select(C.canonical(F.col("v"), odd.schema["v"].dataType)).collect()] == [None, "[1.0]", "null"]
    with pytest.raises(TypeError):
        C.canonical(F.col("x"), DateType())
