"""What keeps jobs within memory, disk and time as tables grow."""

import random
from itertools import combinations

from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pins_are_met_once(spark):
    from lumenfold.sources.advisories import vulnerable

    pins = spark.createDataFrame([("a", "1.0")] * 5 + [("a", "3.0")], "name string, version string")
    ranges = spark.createDataFrame([("a", "A1", 0, "<2.0")], "package string, advisory string, place int, spec string")
    got = vulnerable(pins, ranges)
    assert [tuple(r) for r in got.collect()] == [("a", "1.0", "A1", "<2.0")]
    assert plan(got).count("Aggregate") == 2


def test_related_pairs_like_all_pairs(spark):
    from lumenfold.operators import audit as A

    rnd = random.Random(2)
    says = ["x > 1", "not x > 1", "token is validated", "token is tainted", "input sanitized before query", "n <= 5", "n > 5", "", None]
    rows = [(rnd.randrange(3), i, rnd.choice(says), [rnd.randrange(4), rnd.randrange(4, 9)]) for i in range(60)] + [(None, 90, "n > 5", [1]), (None, 91, "n <= 5", [1])]
    df = spark.createDataFrame(rows, "s int, id int, says string, lines array<int>")
    x, y = df.toDF("s", "a", "pa", "la"), df.toDF("s", "b", "pb", "lb")
    want = x.join(y, "s").filter("a < b").select("a", "b", A.relation(F.col("pa"), F.col("pb"), F.col("la"), F.col("lb")).alias("r")).filter("r is not null")
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, A.related_pairs(df, ["s"]).collect())) == want and len({r for _, _, r in want}) == 3


def test_alike_sets_of_short_and_long_ones(spark, monkeypatch):
    from lumenfold.operators import likeness as L

    monkeypatch.setattr(L, "SHORT", 4)
    rnd = random.Random(3)
    rows = [(i, rnd.sample(range(9), rnd.randrange(1, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, items array<int>")
    want = {(a, b): round(j, 9) for (a, x), (b, y) in combinations(rows, 2) if (j := len({*x} & {*y}) / len({*x} | {*y})) >= 0.6 - 1e-12}
    got = [((r["a"], r["b"]), round(r["score"], 9)) for r in L.alike_sets(df, "id", "items", 0.6).collect()]
    assert dict(got) == want and len(got) == len(want)


def test_no_frame_ends_with_the_unit(spark):
    from lumenfold.operators.dataflow import attached

    findings = spark.createDataFrame([(1, n) for n in range(6)], "unit int, line int")
    flows = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 4, 0.9), (1, 9, 4, 0.9)], "unit int, source_line int, sink_line int, confidence double")
    got = attached(findings, flows)
    assert "unboundedfollowing" not in plan(got)
    assert [(r["line"], r["source_line"], r["sink_line"]) for r in got.sort("line").collect()] == [(0, 10, 1), (1, 10, 1), (2, 10, 1), (3, 9, 4), (4, 9, 4), (5, 9, 4)]


def test_stored_tables_are_never_broadcast(spark):
    from lumenfold.sources.tables import Growing, cut_lineage

    small = cut_lineage(spark.range(5))
    assert "Broadcast" not in joins(spark.range(9).join(small.groupBy("id").count(), "id"))
    grown = Growing(spark.range(3))
    before = grown.rows()
    added = grown.add(spark.range(3, 5))
    assert [sorted(r["id"] for r in df.collect()) for df in (before, added, grown.rows())] == [[0, 1, 2], [3, 4], [0, 1, 2, 3, 4]]


def test_simhash_broadcasts_nothing(spark):
    from lumenfold.llm import simhash as S

    prints = spark.createDataFrame([(1, 1), (3, 2), (1 << 40, 3)], "fp long, first_id long")
    assert "Broadcast" not in joins(S.near_links(prints))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    found = S.rooted(docs)
    assert "Broadcast" not in joins(found) and sorted(r["component_id"] for r in found.collect()) == [1, 1, 3]


def test_guarantees_read_source_text_once(spark):
    from lumenfold.functions import guarantees as H
    from lumenfold.functions import source_flow as C

    text = "def f(v):\n    x = " + " + ".join(["v"] * 1500) + "\n    filename = uuid4()\n"  # an expression deeper than Python's stack
    found = H.guarantees(C.code_flow(spark.createDataFrame([("a.py", text)], "path string, source string")))
    assert sorted((r["says"], r["line"], r["variables"]) for r in found.collect()) == [
        ("filename.server_generated == true", 3, ["filename"]), ("filename.user_controlled == false", 3, ["filename"]), ("identifier.server_generated == true", 3, ["filename"]),
    ]
    assert plan(found).count("MapIn") == 1


def test_spans_meet_places_and_not_rows(spark, monkeypatch):
    from lumenfold.operators import relational as R

    monkeypatch.setattr(R, "NEIGHBOURS", 7)
    points = [(i % 2 if i % 9 else None, i // 2 % 5 * 0.5 if i % 7 else None, i if i % 5 else None) for i in range(60)] + [(1, 0.5, 3)] * 20
    spans = [(i % 3, i % 4 - 1, i % 4 + (i % 3), f"s{i}" if i % 5 else None) for i in range(30)] + [(1, 3, 0, "back"), (0, None, 4, "open"), (None, 0, 9, "none")]
    p, s = spark.createDataFrame(points, "g int, at double, id int"), spark.createDataFrame(spans, "g int, lo int, hi int, name string")
    got = R.in_spans(p, s, "g", "at", "lo", "hi", 2)
    want = [(g, at, i, lo, hi, n) for g, at, i in points for h, lo, hi, n in spans if None not in (g, at, lo) and g == h and lo <= at <= hi]
    assert got.columns == ["g", "at", "id", "lo", "hi", "name"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert plan(got).index("inline") < plan(got).index("Join")  # pairs come out above the join
    assert R.in_spans(p.select("g", "at"), s.drop("name"), "g", "at", "lo", "hi", 2).count() == len(want)


def test_like_scopes_meet_together(spark, monkeypatch):
    from lumenfold.operators import likeness as L

    monkeypatch.setattr(L, "NEIGHBOURS", 5)
    rnd = random.Random(7)
    rows = [(rnd.randrange(2), i, lo := rnd.randrange(0, 30, 6), lo + rnd.choice((0, 3, 20)), rnd.choice((["a"], ["a", "b"], ["b", "c", "d"], []))) for i in rnd.sample(range(400), 120)]
    got = L.overlapping(spark.createDataFrame(rows, "file int, id long, lo int, hi int, roots array<string>"))
    want = sorted((f, a, b, sorted({*x} & {*y})) for f, a, la, ha, x in rows for g, b, lb, hb, y in rows if f == g and a < b and la <= hb and lb <= ha and {*x} & {*y})
    assert sorted(map(tuple, got.collect())) == want and "collect_list(id" in plan(got)


def test_repeated_runs_are_a_row_a_text_and_meet_once(spark):
    """A text's repeated runs are one row, not a row each, and a run's places aren't joined with its first one."""
    import re

    from lumenfold.llm import passages

    rnd = random.Random(3)
    text = lambda: " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(300))
    long = text()
    rows = [(1, long), (2, long), (3, "Then " + long), (4, text()), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in passages.spans(df).collect()) == [1, 2, 3]
    got = passages.removals(df)
    plan = joins(got)
    assert len(re.findall("Join ", plan)) == 1 and not re.search(r"Join \[run#", plan)
    gone = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in got.collect()}
    assert set(gone) == {2, 3} and [a for a, _ in gone[2]] == [0] and gone[2][0][1] > 0.9 * len(long)


def test_many_repeated_runs_are_taken_in_parts(spark, monkeypatch):
    """No filter holds more than PART_RUNS, on average, and the parts give what one filter gives."""
    from lumenfold.llm import passages

    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(n))
    a, b, c = text(200), text(150), text(90)
    rows = [(1, a), (2, a + " " + text(50)), (2, b), (None, b), (7, text(60) + " " + c + " " + c), (8, c + " " + b), (8, c + " " + b), (9, text(80)), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda: sorted(((r["doc_id"] or 0, r["body"], [tuple(x) for x in r["removed"]]) for r in passages.removals(df).collect()))
    want = got()
    monkeypatch.setattr(passages, "PART_RUNS", 30)
    parts = [(part, n) for part, n, _ in passages.repeated_runs(df.select("text"))]
    assert parts == [(i, len(parts)) for i in range(len(parts))] and len(parts) > 3 and len(parts) % 2
    assert got() == want and len(want) >= 4


def test_taint_rounds_carry_no_paths(spark, monkeypatch):
    """A round's states are as wide in a long graph as in a short one, and each state is dealt out once a round."""
    from lumenfold.operators import summaries as Y

    widths, plans = [], []

    class Watched(Y.Growing):
        def add(self, df):
            widths.append({f.dataType.typeName() for f in df.schema if f.name != "clean"})
            return super().add(df)

    def watched(df, cut=Y.cut_lineage):
        plans.append(joins(df))
        return cut(df)

    monkeypatch.setattr(Y, "Growing", Watched)
    monkeypatch.setattr(Y, "cut_lineage", watched)
    edges = [(i, i + 1) for i in range(6)] + [(0, 10), (10, 2), (2, 2)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    args = (frame(edges, "src long, dst long"), frame([(0, None), (0, "x")], "node long, label string"), frame([(6, "sql"), (2, None)], "node long, kind string"), frame([(10, "sql")], "node long, kind string"))
    got = Y.tainted(*args)
    assert sorted((r["label"] or "", r["sink"], r["sanitized"], r["depth"], r["path"]) for r in got.collect()) == sorted(
        (label, *end) for label in ("", "x") for end in ((2, False, 2, [0, 1, 2]), (6, False, 6, [0, 1, 2, 3, 4, 5, 6]), (6, True, 6, [0, 10, 2, 3, 4, 5, 6]))
    )
    assert all("array" not in kinds for kinds in widths) and len(widths) == 8
    assert not any("LeftAnti" in p for p in plans)
    monkeypatch.setattr(Y, "KINDS_AT_ONCE", 1)
    assert sorted(map(str, Y.tainted(*args).collect())) == sorted(map(str, got.collect()))


def test_small_units_take_no_rounds(spark, monkeypatch):
    """Ways in units of a few edges are followed without a table a round, with the results of rounds, whatever their size."""
    from lumenfold.operators import dataflow as D
    from lumenfold.operators import graphs as G

    rnd = random.Random(4)
    edges = [(u, a, b) for u in range(9) for a in range(-3, 5 * (1 + u % 3)) for b in {a + 1, rnd.randrange(12)} if rnd.random() < 0.8] + [(20, 1, 2), (None, 1, 2), (20, None, 2)]
    says = [(u, n, rnd.choice((None, ["x"], ["y"], ["x", "z"])), rnd.choice((None, ["x"], ["y", "z"]))) for u in (*range(9), 20, 21) for n in range(10)] + [(22, 1, ["x"], ["x"])]
    e = spark.createDataFrame(edges, "unit long, src int, dst int")
    s = spark.createDataFrame(says, "unit long, node int, defs array<string>, uses array<string>")
    gates = spark.createDataFrame([(u, g, g, g + 1) for u in range(9) for g in (2, 4)] + [(20, 1, 1, 2)], "unit long, gate int, src int, dst int")
    targets = spark.createDataFrame([(u, g, t) for u in range(9) for g in (2, 3, 4) for t in (0, 3, 7, 9)] + [(20, 1, 2), (20, None, 2), (22, 1, 0)], "unit long, gate int, target int")
    entries = spark.createDataFrame([(u, n) for u in (*range(9), 20, 22) for n in {0, u % 2}], "unit long, node int")
    both = lambda: (sorted(map(tuple, G.dominators_fail(e, entries, gates, targets).collect())), sorted(map(tuple, D.def_use(s, e).collect())))
    mixed = both()
    monkeypatch.setattr(G, "SMALL_EDGES", -1)
    assert both() == mixed and all(len(x) > 20 for x in mixed)

    def none(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(G, "SMALL_EDGES", 24)
    for module in (G, D):
        monkeypatch.setattr(module, "Growing", none)
    few = e.filter("unit % 3 = 0")
    assert 0 < G.dominators_fail(few, entries, gates, targets).count() < len(mixed[0]) and 0 < D.def_use(s, few).count() < len(mixed[1])


def test_summaries_are_taken_in_parts(spark, monkeypatch):
    from lumenfold.operators import summaries as Y

    calls = spark.createDataFrame([(i, (i * 7 + k) % 30, [0, None, 1], k == 0) for i in range(30) for k in (0, 3)], "caller long, callee long, args array<int>, used boolean")
    effects = spark.createDataFrame([(i, "sink", f"v{i % 3}", i % 3, True) for i in range(0, 30, 7)], "function long, kind string, value string, param int, used boolean")
    got = lambda: sorted((str(tuple(r)) for r in Y.summarised(effects, calls, 4).collect()))
    want, added = got(), []
    monkeypatch.setattr(Y, "PART_STATES", 4)
    monkeypatch.setattr(Y, "MAX_PARTS", 3)
    add = Y.Growing.add
    monkeypatch.setattr(Y.Growing, "add", lambda self, df: added.append(1) or add(self, df))
    assert got() == want and len(added) > 8
