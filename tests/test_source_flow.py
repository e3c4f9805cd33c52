"""Merging against the loop that states its rule, and the flow of source text against what a reader sees in it."""

import random

from lumenfold.functions import source_flow as C
from lumenfold.operators import dataflow as D
from lumenfold.operators import graphs as G
from lumenfold.operators import merging as M
from lumenfold.operators import summaries as Y


def loop(rows, apart, least):
    """Each row meets the later ones, in order."""
    sure, into = {i: c for _, i, _, _, c in rows}, {}
    words = {i: set((t or "").lower().split()) for _, i, _, t, _ in rows}
    for scope in {r[0] for r in rows}:
        group = [i for s, i, place, _, _ in sorted(rows, key=lambda r: r[2]) if s == scope]
        for k, a in enumerate(group):
            if a in into:
                continue
            for b in group[k + 1 :]:
                if b in into or (a, b) in apart or (b, a) in apart or not words[a] or not words[b]:
                    continue
                if len(words[a] & words[b]) / len(words[a] | words[b]) >= least:
                    keep, drop = (a, b) if sure[a] >= sure[b] else (b, a)
                    sure[keep] = min(0.99, sure[keep] + sure[drop] * 0.1)
                    into[drop] = keep
    return {i: (sure[i], into.get(i)) for _, i, _, _, _ in rows}


def test_merged_like_the_loop(spark):
    rnd = random.Random(12)
    rows = []
    for scope in ("a", "b", "c", None):
        base = [[f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(3, 8))] for _ in range(4)]
        for _ in range(14):
            text = list(rnd.choice(base))
            if rnd.random() < 0.4:
                text[rnd.randrange(len(text))] = "odd"
            rnd.shuffle(text)
            rows.append((scope, len(rows), rnd.random(), rnd.choice((" ".join(text), " ".join(text).upper(), "" if rnd.random() < 0.1 else " ".join(text))), round(rnd.random(), 2)))
    rows += [("hot", 1000 + k, k / 100, "same words in all", round(rnd.random(), 3)) for k in range(40)]
    apart = {(rnd.randrange(len(rows)), rnd.randrange(len(rows))) for _ in range(30)} | {(1000, 1001), (1005, 1002)}
    df = spark.createDataFrame(rows, "scope string, id long, place double, text string, confidence double").repartition(3)
    x = spark.createDataFrame(sorted(apart), "a long, b long")
    want = loop(rows, apart, 0.6)
    got = {r["id"]: (r["confidence"], r["into"]) for r in M.merged(df, x, 0.6).collect()}
    assert set(got) == set(want) and sum(v[1] is not None for v in want.values()) > 30
    # What a lost row still gained in its turn is of no use to anyone; kept rows and where the others went must be equal.
    assert {i: (round(c, 9), w) for i, (c, w) in got.items() if w is None} == {i: (round(c, 9), w) for i, (c, w) in want.items() if w is None}
    assert {i: w for i, (_, w) in got.items()} == {i: w for i, (_, w) in want.items()}
    assert M.merged(df.limit(0), x).count() == 0


SOURCE = '''
import os
@app.route("/x")
def view(request, name="a", *rest, key=None, **more):
    data = load(request)
    if name:
        data = clean(data)
    else:
        raise ValueError(name)
    for i, part in enumerate(data):
        if part: continue
        total += part
        break
    else:
        total = 0
    with open(name) as f:
        text = f.read()
    try:
        x = risky(text)
    except OSError as e:
        log(e)
        return None
    finally:
        done = True
    values = [y for y in text if y != x]
    run(values)
    return total

class Store:
    def load(self, what):
        return os.system(what)
    async def escape_all(self, text):
        def inner(z):
            return eval(z)
        while text:
            text = inner(text)
        return text

def load(r):
    return Store().load(r)

def main():
    load(input())
    h = load(x)
    match h:
        case {"a": v, **others}:
            use(v, others)
        case [first, *tail] if first:
            use(first)
'''


def test_flow_of_source(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def broken(:"), ("c.py", None)], "path string, source string")
    flow = C.code_flow(files).cache()
    rows = flow.collect()
    assert [(r["path"], r["defs"]) for r in rows if r["kind"] == "error"] == [("b.py", ["SyntaxError"])]
    assert {r["function"] for r in rows if r["kind"] == "entry"} == {"view", "Store.load", "Store.escape_all", "Store.escape_all.inner", "load", "main"}
    view = {r["node"]: r for r in rows if r["function"] == "view"}
    assert view[0]["defs"] == ["key", "more", "name", "request", "rest"]
    line = {n: r["line"] for n, r in view.items()}
    ahead = {(line[a], line[b]) for a, r in view.items() for b in r["next"]}
    # Conditions, a raise, continue and break, else of a loop, try with an early return, and finally.
    for pair in ((4, 5), (5, 6), (6, 7), (6, 9), (7, 10), (10, 11), (11, 11), (11, 10), (11, 12), (12, 13), (13, 16), (10, 15), (15, 16), (17, 18), (18, 19), (18, 20), (19, 20), (20, 21), (21, 22), (19, 24), (24, 25), (26, 27)):
        assert pair in ahead, pair
    assert (9, 10) not in ahead and (22, 24) not in ahead and not [p for p in ahead if p[0] in (9, 27)]
    uses = {r["line"]: (r["defs"], r["uses"]) for r in view.values()}
    assert uses[25] == (["values"], ["text", "x"]) and uses[12] == (["total"], ["part", "total"]) and uses[16][0] == ["f"] and uses[20][0] == ["e"]
    s = C.statements(flow)
    at = {(r["unit"], r["node"]): r["line"] for r in s.collect()}
    chains = {(r["name"], at[r["unit"], r["definition"]], at[r["unit"], r["use"]]) for r in D.def_use(s, C.edges(flow)).collect() if r["unit"] == "a.py::view"}
    assert {c for c in chains if c[0] in ("data", "total", "x")} == {("data", 5, 7), ("data", 7, 10), ("total", 12, 27), ("total", 15, 27), ("x", 19, 25)}
    main = [r for r in rows if r["function"] == "main" and r["kind"] == "case"]
    assert [r["defs"] for r in main] == [["others", "v"], ["first", "tail"]]
    # `main` reaches os.system through two functions of one name, the nearer of which is resolved in the file.
    calls, effects = C.calls(flow), C.effects(flow)
    short = lambda u: u.split("::")[-1]
    assert {(short(r["caller"]), short(r["callee"])) for r in calls.collect()} >= {("view", "load"), ("main", "load"), ("Store.escape_all", "Store.escape_all.inner")}
    assert {(short(r["function"]), r["kind"], r["value"], r["param"]) for r in effects.collect()} == {("Store.load", "sink", "os.system", 1), ("Store.escape_all.inner", "sink", "eval", 0), ("Store.escape_all", "sanitizer", "escape_all", 1), ("main", "source", "input", None)}
    found = {(short(r["function"]), r["kind"], r["value"], r["param"], r["depth"]) for r in Y.summarised(effects, calls).collect()}
    assert ("Store.escape_all", "sink", "eval", 1, 1) in found
    # The early return in the handler is a way past the try's own assignment.
    edges = C.edges(flow).filter("unit = 'a.py::view'")
    node = {r["line"]: n for n, r in view.items() if r["kind"] != "entry"}
    gates = spark.createDataFrame([("a.py::view", node[6], node[6], node[7])], "unit string, gate int, src int, dst int")
    targets = spark.createDataFrame([("a.py::view", node[6], node[19]), ("a.py::view", node[6], node[9])], "unit string, gate int, target int")
    entries = spark.createDataFrame([("a.py::view", 0)], "unit string, node int")
    assert [r["target"] for r in G.dominators_fail(edges, entries, gates, targets).collect()] == [node[9]]


FILES = {
    "app/__init__.py": "from .names import safe_name as tidy\n",
    "app/names.py": "import os\nfrom uuid import uuid4\ndef safe_name(n):\n    return os.path.basename(n)\ndef fresh():\n    filename = uuid4()\n    return filename\nclass Store:\n    def path(self, p):\n        self.verify(p)\n        return p\n    def verify(self, p):\n        return commonpath([p])\n",
    "app/views.py": "from app.names import safe_name\nfrom . import names\nimport app.names as n\nimport app.names\n@auth.login_required\ndef show(f):\n    a = safe_name(f)\n    b = names.fresh()\n    n.safe_name(f)\n    c = app.names.fresh()\n    rows = db.filter_by(owner_id=current_user.id, user_id=f)\n    return helper(a)\ndef helper(x):\n    return secure_filename(x)\n",
    "app/sub/deep.py": "from ..names import Store\nfrom .. import names as nm\ndef go(p):\n    s = Store.path(p)\n    nm.fresh()\n    return show(p)\n",
    "bad.py": "def (",
}


def test_guarantees_and_their_index(spark):
    from lumenfold.functions import guarantees as H

    files = spark.createDataFrame(list(FILES.items()), "path string, source string")
    flow = C.code_flow(files).cache()
    found = H.guarantees(flow).cache()
    got = {(r["path"], r["function"], r["says"].split(" ")[0], r["line"], tuple(r["variables"]), r["used"]) for r in found.collect()}
    assert got == {
        ("app/names.py", "safe_name", "filename.basename_only", 4, (), True), ("app/names.py", "fresh", "identifier.server_generated", 6, ("filename",), True), ("app/names.py", "fresh", "filename.server_generated", 6, ("filename",), True),
        ("app/names.py", "fresh", "filename.user_controlled", 6, ("filename",), True), ("app/names.py", "Store.path", "storage.path.enforces_store_boundary", 10, (), False), ("app/names.py", "Store.verify", "storage.verify.enforces_store_boundary", 13, (), True),
        ("app/views.py", "show", "route.requires_login", 6, (), None), ("app/views.py", "show", "query.scoped_to_current_user", 11, ("rows",), True), ("app/views.py", "helper", "filename.matches_allowed_pattern", 14, (), True), ("app/views.py", "helper", "filename.user_controlled", 14, (), True),
    }
    imports = H.resolved_imports(H.code_imports(files), files)
    assert {tuple(r) for r in imports.collect()} == {
        ("app/__init__.py", "tidy", "app/names.py", "safe_name"), ("app/views.py", "safe_name", "app/names.py", "safe_name"), ("app/views.py", "names", "app/names.py", None), ("app/views.py", "n", "app/names.py", None),
        ("app/views.py", "app.names", "app/names.py", None), ("app/sub/deep.py", "Store", "app/names.py", "Store"), ("app/sub/deep.py", "nm", "app/names.py", None),
    }
    at = {(r["path"], r["line"], r["call"], r["target"].split("::")[1], r["says"].split(" ")[0]) for r in H.propagated(flow, found, imports).collect()}
    assert {(p, n, c, t) for p, n, c, t, _ in at} == {
        ("app/views.py", 7, "safe_name", "safe_name"), ("app/views.py", 8, "names.fresh", "fresh"), ("app/views.py", 9, "n.safe_name", "safe_name"), ("app/views.py", 10, "app.names.fresh", "fresh"), ("app/views.py", 12, "helper", "helper"),
        ("app/sub/deep.py", 4, "Store.path", "Store.path"), ("app/sub/deep.py", 5, "nm.fresh", "fresh"), ("app/sub/deep.py", 6, "show", "show"), ("app/names.py", 10, "self.verify", "Store.verify"),
    }
    assert H.propagated(flow.limit(0), found, imports).count() == 0 and H.guarantees(flow.limit(0)).count() == 0
