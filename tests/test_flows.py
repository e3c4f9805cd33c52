"""Components, summaries, taint, data flow and guards against plain algorithms on random graphs."""

import random
from collections import defaultdict

import pytest

from lumenfold.operators import dataflow as D
from lumenfold.operators import graphs as G
from lumenfold.operators import summaries as Y
from lumenfold.plans import catalog, flows as _flows, likeness as _likeness  # noqa: F401  (they add their queries to the catalog)
from tests.test_library import assert_matches_sql, duck  # noqa: F401


def tarjan(nodes, edges):
    """The component of each node, by depth-first search."""
    out, index, low, stack, on, place = defaultdict(list), {}, {}, [], set(), {}
    for a, b in edges:
        out[a].append(b)

    def visit(v):
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for w in out[v]:
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in on:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while True:
                w = stack.pop()
                on.discard(w)
                part.append(w)
                if w == v:
                    break
            place.update(dict.fromkeys(part, min(part)))

    for v in nodes:
        if v not in index:
            visit(v)
    return place


@pytest.mark.parametrize("seed", (1, 3))
def test_components_and_their_order(spark, seed):
    rnd = random.Random(seed)
    n = 24
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(20 * seed)]
    edges += [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(100, 0), (5, 200), (200, 201)] + edges[:5]
    nodes = sorted({*range(n), *(x for e in edges for x in e)})
    place = tarjan(nodes, edges)
    down = defaultdict(set)
    for a, b in edges:
        if place[a] != place[b]:
            down[place[a]].add(place[b])
    height = {}
    level = lambda c: height.setdefault(c, 1 + max(map(level, down[c]), default=-1))
    recursive = {place[a] for a, b in edges if place[a] == place[b]}
    got = G.bottom_up(spark.createDataFrame([(x,) for x in range(n)], "node long"), spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: (r["component"], r["level"], r["recursive"]) for r in got} == {v: (place[v], level(place[v]), place[v] in recursive) for v in nodes}
    assert len(got) == len(nodes)
    inner = {tuple(r) for r in G.within_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert inner == {(a, b) for a, b in edges if a != b and place[a] == place[b]}


def test_order_of_nothing(spark):
    assert G.bottom_up(spark.createDataFrame([], "node long"), spark.createDataFrame([], "src long, dst long")).count() == 0
    one = G.bottom_up(spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(2, 2)], "src long, dst long")).collect()
    assert sorted(tuple(r) for r in one) == [(1, 1, 0, False), (2, 2, 0, True)]


def summaries(effects, calls, limit):
    """Effects at their least depth, by breadth-first search over states."""
    found = {e: (0, None) for e in effects}
    front = [e for e in effects if e[1] not in Y.NOT_PASSED_ON]
    for depth in range(1, limit + 1):
        new = {}
        for f, kind, value, param, used in front:
            for caller, callee, args, result in calls:
                if callee == f and (param is None or (param < len(args) and args[param] is not None)):
                    e = (caller, kind, value, None if param is None else args[param], used and result)
                    if e not in found:
                        new[e] = min(new.get(e, callee), callee)
        found |= {e: (depth, via) for e, via in new.items()}
        front = list(new)
    short = {caller for f, kind, value, param, used in front for caller, callee, args, result in calls
             if callee == f and (param is None or (param < len(args) and args[param] is not None)) and (caller, kind, value, None if param is None else args[param], used and result) not in found}
    for caller, callee, _, result in sorted(calls, key=str):
        found.setdefault((caller, "wrapper", callee, None, result), (1, callee))
    return found, short


@pytest.mark.parametrize("seed", (0,))
def test_summaries(spark, seed):
    rnd = random.Random(seed)
    name = lambda: f"f{rnd.randrange(14):02d}"
    calls = list({(name(), name(), tuple(rnd.choice((0, 1, 2, None)) for _ in range(rnd.randrange(4))), rnd.random() < 0.7) for _ in range(26)})
    effects = list({(name(), rnd.choice(("source", "sink", "unknown", "validator")), rnd.choice("xy"), rnd.choice((None, 0, 1, 2)), rnd.random() < 0.8) for _ in range(9)})
    e = spark.createDataFrame(effects, "function string, kind string, value string, param int, used boolean")
    c = spark.createDataFrame([(a, b, list(x), u) for a, b, x, u in calls], "caller string, callee string, args array<int>, used boolean")
    for limit in (2, 60):
        want, short = summaries(effects, calls, limit)
        found = Y.summarised(e, c, limit if limit < 60 else None)
        got = {tuple(r)[:5]: (r["depth"], r["via"]) for r in found.collect()}
        assert got == want and found.count() == len(want)
        if 0 < limit < 60:
            assert {r["function"] for r in Y.cut_short(found, c, limit).collect()} == short


def flows(edges, sources, sinks, cleans, limit):
    """Every state's shortest and first path, by breadth-first search."""
    out, clean_at = defaultdict(set), defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    for n, k in cleans:
        clean_at[n].add(k)
    found, front = {}, {(n, n, label, frozenset()): [n] for n, label in sources}
    for _ in range(limit):
        new = {}
        for (n, s, label, clean), path in front.items():
            for b in out[n]:
                state, way = (b, s, label, clean | clean_at[b]), [*path, b]
                if state not in found and (state not in new or way < new[state]):
                    new[state] = way
        found |= new
        front = new
    best = {}
    for (n, s, label, clean), path in found.items():
        for sink, kind in sinks:
            if sink == n:
                key = (s, label, sink, kind, kind in clean or "all" in clean)
                best[key] = min(best.get(key, (len(path) - 1, path)), (len(path) - 1, path))
    return best


@pytest.mark.parametrize("seed", (0,))
def test_taint(spark, seed):
    rnd = random.Random(10 + seed)
    n = 24
    edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(45)] + [(3, 3)]
    sources = [(3, "input"), (3, "net"), (7, "input"), (7, None)]
    sinks = [(k, kind) for k, kind in ((3, "sql"), (9, "sql"), (9, "shell"), (11, "html"), (20, "shell"))]
    cleans = [(5, "sql"), (6, "all"), (9, "shell"), (12, "html"), (12, "sql")]
    args = (spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long"), spark.createDataFrame([*sources, (None, "x")], "node long, label string"), spark.createDataFrame([*sinks, (None, "sql")], "node long, kind string"), spark.createDataFrame(cleans, "node long, kind string"))
    for limit in (2, 40):
        got = Y.tainted(*args, limit if limit < 40 else None).collect()
        want = flows(edges, sources, sinks, cleans, limit)
        assert {tuple(r)[:5]: (r["depth"], list(r["path"])) for r in got} == want and len(got) == len(want)
        assert all(r["confidence"] == (0.4 if r["sanitized"] else 0.85) for r in got)
    empty = [x.limit(0) for x in args]
    assert Y.tainted(empty[0], *args[1:]).count() == 0 and Y.tainted(args[0], empty[1], *args[2:]).count() == 0 and Y.tainted(*args[:2], empty[2], args[3]).count() == 0


def chains(statements, edges):
    """Definitions that reach uses, by following every definition alone."""
    defs, out = {(u, n): set(d or ()) for u, n, d, _ in statements}, defaultdict(set)
    for u, a, b in edges:
        out[u, a].add(b)
    found = set()
    for (u, n), names in defs.items():
        for name in names:
            seen, stack = set(), list(out[u, n])
            while stack:
                m = stack.pop()
                if m in seen or (u, m) not in defs:
                    continue
                seen.add(m)
                if name not in defs[u, m]:
                    stack += out[u, m]
            found |= {(u, name, n, m) for v, m, _, uses in statements if v == u and m in seen and name in (uses or ())}
    return found


@pytest.mark.parametrize("seed", (0,))
def test_def_use(spark, seed):
    rnd = random.Random(20 + seed)
    statements, edges = [], []
    for u in range(12):
        size = rnd.choice((1, 5, 12))
        for n in range(size):
            statements.append((u, n, rnd.choice((None, [], ["x"], ["y"], ["x", "z"], ["y", "y"])), rnd.choice((None, ["x"], ["y", "z"], ["x", "x"]))))
            if rnd.random() < 0.9:
                edges.append((u, n, n + 1))
            if rnd.random() < 0.25:
                edges.append((u, n, rnd.randrange(size)))
    s = spark.createDataFrame([*statements, (None, 1, ["x"], ["x"])], "unit long, node int, defs array<string>, uses array<string>")
    e = spark.createDataFrame([*edges, *edges[:3]], "unit long, src int, dst int")
    got = [tuple(r) for r in D.def_use(s, e).collect()]
    assert sorted(got) == sorted(chains(statements, edges))
    last = {}
    for u, n, d, _ in statements:
        for name in d or ():
            last[u, name] = max(last.get((u, name), n), n)
    assert {(r["unit"], r["name"]): r["origin"] for r in D.origins(s).collect()} == last
    assert D.def_use(s.limit(0), e).count() == 0 and D.def_use(s, e.limit(0)).count() == 0


def test_ways_around_gates(spark):
    rnd = random.Random(5)
    edges = [(u, a, b) for u in range(6) for a in range(10) for b in {min(a + 1, 9), rnd.randrange(10)} if rnd.random() < 0.8]
    gates = [(u, g, g, g + 1) for u in range(6) for g in (2, 4, 6)]
    targets = [(u, g, t) for u, g, _, _ in gates for t in (3, 7, 9)]
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names.split()))
    got = {tuple(r) for r in G.dominators_fail(make(edges, "unit src dst"), make([(u, 0) for u in range(6)], "unit node"), make(gates, "unit gate src dst"), make(targets, "unit gate target")).collect()}
    want = set()
    for u, g, t in targets:
        seen, stack = set(), [0]
        while stack:
            v = stack.pop()
            if v not in seen:
                seen.add(v)
                stack += [b for w, a, b in edges if (w, a) == (u, v) and (a, b) != (g, g + 1)]
        if t in seen:
            want.add((u, g, t))
    assert got == want


def test_flows_are_attached(spark):
    findings = spark.createDataFrame([(1, "f", 10), (2, "f", 13), (3, "f", 99), (4, "g", 1), (5, "f", 10), (6, None, 3)], "id long, unit string, line long")
    made = spark.createDataFrame([("f", 1, 9, 0.4), ("f", 2, 11, 0.85), ("f", 3, 15, 0.85), ("f", 0, 11, 0.85), ("h", 1, 1, 0.9), ("f", 5, None, 0.9)], "unit string, source_line long, sink_line long, confidence double")
    got = {r["id"]: tuple(r)[3:] for r in D.attached(findings, made).collect()}
    assert got == {1: (0, 11, 0.85), 2: (0, 11, 0.85), 3: (3, 15, 0.85), 4: (None, None, None), 5: (0, 11, 0.85), 6: (None, None, None)}


@pytest.mark.parametrize("name", sorted(n for n, f in catalog.QUERIES.items() if f.__module__ in ("lumenfold.plans.flows", "lumenfold.plans.likeness") and n in catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    assert_matches_sql(spark, duck, name)


def test_summaries_take_every_line_and_part(spark, tmp_path):
    """A chain of twelve calls, by later lines of an order, hands the effect of a part of any size up to its end; so does a
    small line that calls upwards."""
    lines = [(4 ** (k + 1), 4**k, 2, 4.0, "N") for k in range(12)] + [(150, 100, 3, 1.0, "R")]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 48, "Brand#1", 900.0), (150, 50, "Brand#2", 1500.0)], "p_partkey long, p_size int, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in catalog.queries()["q_function_summaries"](spark, str(tmp_path)).collect()]
    want = [(4**k, "sink", "Brand#1", 1, False, k, 4 ** (k - 1) if k else None) for k in range(13)] + [(150, "sanitizer", "Brand#2", 2, True, 0, None), (100, "sanitizer", "Brand#2", 2, True, 1, 150)]
    want += [(4 ** (k + 1), "wrapper", str(4**k), None, True, 1, 4**k) for k in range(12)] + [(100, "wrapper", "150", None, True, 1, 150)]
    assert sorted(got, key=str) == sorted(want, key=str)
