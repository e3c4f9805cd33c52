"""Statements of Python functions with what may run after them, what they define and use, and whom they call: the tables
that `operators.dataflow`, `operators.graphs` and `operators.summaries` work on.

A file is parsed where it stands, in Arrow batches; each function of it gives a row a statement. Node 0 is the entry, which
defines the parameters. Files that don't parse give one row of kind `error`. Null sources are empty files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.source_code import DANGEROUS_CALLS, dotted

SCHEMA = "path string, function string, node int, kind string, line int, defs array<string>, uses array<string>, next array<int>, calls array<struct<name: string, args: array<int>, used: boolean, named: map<string, string>>>, params array<string>, marks array<string>"
_CALL = pa.struct([("name", pa.string()), ("args", pa.list_(pa.int32())), ("used", pa.bool_()), ("named", pa.map_(pa.string(), pa.string()))])
_NAMES = pa.list_(pa.string())
ARROW = pa.schema([("path", pa.string()), ("function", pa.string()), ("node", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("defs", _NAMES), ("uses", _NAMES), ("next", pa.list_(pa.int32())), ("calls", pa.list_(_CALL)), ("params", _NAMES), ("marks", _NAMES)])
# Calls that bring in what others control, and parts of the names of functions that clean it.
SOURCE_CALLS = ("input", "os.getenv", "request.args.get", "request.form.get", "request.get_json", "recv", "urlopen")
CLEANING = ("sanitize", "escape", "redact", "mask_secret")
CHECKING = ("validate", "validator", "is_safe", "is_valid")
BATCH = 10_000  # statements that are handed on at once
NESTED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
LEAVES = {*NESTED, ast.Lambda, ast.Name, ast.Constant}
KINDS = [k for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST) and (k is ast.Constant or not issubclass(k, ast.Constant))]
FIELDS = {k: tuple(f for f in reversed(k._fields) if f != "ctx") for k in KINDS}
BLOCKS = {k: tuple(f for f in k._fields if f in ("body", "handlers", "orelse", "finalbody", "cases")) if issubclass(k, (ast.mod, ast.stmt, ast.excepthandler, ast.match_case)) else () for k in KINDS}


def walk(parts: list[ast.AST]) -> list[ast.AST]:
    """The nodes of expressions in the order of their text, without the bodies of what they define and without the marks of
    loads and stores."""
    found, stack = [], parts[::-1]
    while stack:
        n = stack.pop()
        found.append(n)
        kind = type(n)
        if kind in LEAVES:
            continue
        for field in FIELDS[kind]:
            child = getattr(n, field, None)
            if not child:
                continue
            if isinstance(child, list):
                stack += [c for c in reversed(child) if isinstance(c, ast.AST)]
            elif isinstance(child, ast.AST):
                stack.append(child)
    return found


def names(found: list[ast.AST]) -> tuple[list[str], list[str]]:
    """(defined, used) names among nodes; the names that comprehensions bind for themselves are neither."""
    loads, stores, own = set(), set(), set()
    for n in found:
        if isinstance(n, ast.Name):
            (loads if isinstance(n.ctx, ast.Load) else stores).add(n.id)
        elif isinstance(n, ast.comprehension):
            own |= {t.id for t in ast.walk(n.target) if isinstance(t, ast.Name)}
    return sorted(stores - own), sorted(loads - own)


class Flow:
    """The statements of one function. `after` of a statement is where control may stand once it has run."""

    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef):
        a = function.args
        self.params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        self.place = {p: k for k, p in enumerate(self.params)}
        self.rows: list[dict] = []
        self.edges: set[tuple[int, int]] = set()
        self.loops: list[tuple[int, set[int]]] = []
        self.add("entry", function.lineno, set(), [])
        self.rows[0]["defs"] = sorted(self.params)
        self.marks = [name for d in function.decorator_list if (name := dotted(d.func if isinstance(d, ast.Call) else d))]
        self.block(function.body, {0})

    def add(self, kind: str, line: int, before: set[int], parts: list[ast.AST], statement: ast.AST | None = None) -> int:
        found = walk([p for p in parts if p is not None])
        defs, uses = names(found)
        n = len(self.rows)
        calls = [(c, name) for c in found if isinstance(c, ast.Call) and (name := dotted(c.func))]
        handed = lambda c: [self.place.get(x.id) if isinstance(x, ast.Name) else None for x in c.args]
        bare = statement.value if isinstance(statement, ast.Expr) else None
        self.rows.append({"node": n, "kind": kind, "line": line, "defs": defs, "uses": uses, "calls": [{"name": name, "args": handed(c), "used": c is not bare, "named": {k.arg: dotted(k.value) for k in c.keywords if k.arg}} for c, name in calls]})
        self.edges |= {(b, n) for b in before}
        return n

    def block(self, statements: list[ast.stmt], before: set[int]) -> set[int]:
        for s in statements:
            before = self.statement(s, before)
        return before

    def statement(self, s: ast.stmt, before: set[int]) -> set[int]:
        kind, line = type(s).__name__.lower(), s.lineno
        if isinstance(s, ast.If):
            n = self.add("if", line, before, [s.test])
            return self.block(s.body, {n}) | (self.block(s.orelse, {n}) if s.orelse else {n})
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            n = self.add(kind, line, before, [s.test] if isinstance(s, ast.While) else [s.iter, s.target])
            self.loops.append((n, set()))
            self.edges |= {(e, n) for e in self.block(s.body, {n})}
            _, left = self.loops.pop()
            return (self.block(s.orelse, {n}) if s.orelse else {n}) | left
        if isinstance(s, (ast.With, ast.AsyncWith)):
            n = self.add("with", line, before, [x for i in s.items for x in (i.context_expr, i.optional_vars)])
            return self.block(s.body, {n})
        if isinstance(s, (ast.Try, ast.TryStar)):
            n = self.add("try", line, before, [])
            out = self.block(s.body, {n})
            inside = set(range(n, len(self.rows)))  # any of these may fail
            out = self.block(s.orelse, out) if s.orelse else out
            for h in s.handlers:
                k = self.add("except", h.lineno, inside, [h.type])
                self.rows[k]["defs"] = [h.name] if h.name else []
                out = out | self.block(h.body, {k})
            if not s.finalbody:
                return out
            return self.block(s.finalbody, out or inside)
        if isinstance(s, ast.Match):
            n = self.add("match", line, before, [s.subject])
            out = {n}
            for c in s.cases:
                k = self.add("case", c.pattern.lineno, {n}, [c.guard])
                bound = {x for p in ast.walk(c.pattern) for x in (getattr(p, "name", None), getattr(p, "rest", None)) if isinstance(x, str)}
                self.rows[k]["defs"] = sorted(bound | {*self.rows[k]["defs"]})
                out = out | self.block(c.body, {k})
            return out
        if isinstance(s, NESTED):
            n = self.add("define", line, before, [*s.decorator_list])
            self.rows[n]["defs"] = [s.name]
            return {n}
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            n = self.add("import", line, before, [])
            self.rows[n]["defs"] = sorted({(a.asname or a.name).split(".")[0] for a in s.names})
            return {n}
        n = self.add(kind, line, before, [s], s)
        if isinstance(s, ast.AugAssign):
            self.rows[n]["uses"] = sorted({*self.rows[n]["uses"], *self.rows[n]["defs"]})
        if isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            loop, left = self.loops[-1]
            if isinstance(s, ast.Break):
                left.add(n)
            else:
                self.edges.add((n, loop))
        return set() if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)) else {n}


def functions(tree: ast.AST, owner: str = "") -> Iterator[tuple[str, ast.FunctionDef | ast.AsyncFunctionDef]]:
    """Every function with its qualified name. Only statements hold functions, so expressions aren't looked at."""
    for field in BLOCKS[type(tree)]:
        for n in getattr(tree, field):
            if isinstance(n, NESTED):
                name = f"{owner}.{n.name}" if owner else n.name
                if not isinstance(n, ast.ClassDef):
                    yield name, n
                yield from functions(n, name)
            elif BLOCKS[type(n)]:
                yield from functions(n, owner)


def code_flow(files: DataFrame) -> DataFrame:
    """A row for each statement of each function of (path, source), as SCHEMA."""
    def rows(path: str, source: str | None) -> list[dict]:
        try:
            found = []
            for name, f in functions(ast.parse(source or "")):
                flow = Flow(f)
                ahead: dict[int, list[int]] = {}
                for a, b in sorted(flow.edges):
                    ahead.setdefault(a, []).append(b)
                found += [{"path": path, "function": name, **r, "next": ahead.get(r["node"], []), "params": flow.params if r["node"] == 0 else None, "marks": flow.marks if r["node"] == 0 else None} for r in flow.rows]
            return found
        except (SyntaxError, ValueError, RecursionError) as e:
            return [{"path": path, "function": "", "node": 0, "kind": "error", "line": getattr(e, "lineno", None) or 0, "defs": [type(e).__name__], "uses": [], "calls": [], "next": [], "params": None, "marks": None}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[dict]) -> pa.RecordBatch:
            for r in held:
                for c in r["calls"]:
                    c["named"] = list(c["named"].items())
            return pa.RecordBatch.from_pylist(held, ARROW)

        for b in batches:
            held: list[dict] = []
            for path, source in zip(b.column("path").to_pylist(), b.column("source").to_pylist(), strict=True):
                held += rows(path, source)
                if len(held) >= BATCH:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)

    return files.select("path", "source").mapInArrow(run, SCHEMA)


def unit() -> Column:
    return F.concat_ws("::", "path", "function")


def statements(flow: DataFrame) -> DataFrame:
    """(unit, node, line, defs, uses) for `dataflow.def_use`."""
    return flow.filter("kind <> 'error'").select(unit().alias("unit"), "node", "line", "defs", "uses")


def edges(flow: DataFrame) -> DataFrame:
    """(unit, src, dst) between statements."""
    return flow.filter("kind <> 'error'").select(unit().alias("unit"), F.col("node").alias("src"), F.explode("next").alias("dst"))


def calls(flow: DataFrame) -> DataFrame:
    """(caller, callee, args, used) for `summaries.summarised`: calls resolved by the callee's name to a function of the same
    file, else to the only function of that last name in all files. What is handed over is known by its place."""
    known = flow.filter("kind = 'entry'").select("path", "function", unit().alias("callee")).distinct().withColumn("last", F.substring_index("function", ".", -1))
    made = flow.select("path", "function", unit().alias("caller"), F.explode("calls").alias("c")).select("path", "caller", "c.name", "c.args", "c.used", F.substring_index("c.name", ".", -1).alias("last")).distinct()
    here = known.select("path", F.col("function").alias("name"), F.col("callee").alias("_here"))
    only = known.groupBy("last").agg(F.min("callee").alias("_only"), F.countDistinct("callee").alias("_n")).filter("_n = 1").drop("_n")
    found = made.join(here, ["path", "name"], "left").join(only, "last", "left")
    return found.withColumn("callee", F.coalesce("_here", "_only")).filter("callee is not null").select("caller", "callee", "args", "used")


def effects(flow: DataFrame) -> DataFrame:
    """(function, kind, value, param, used) for `summaries.summarised`: calls that bring in or carry out what is dangerous, by
    the parameter that is handed to them, and functions whose names say that they clean or check."""
    each = flow.select(unit().alias("function"), F.explode("calls").alias("c")).select("function", "c.*")
    kind = F.when(F.col("name").isin(*SOURCE_CALLS), "source").when(F.col("name").isin(*DANGEROUS_CALLS), "sink")
    found = each.withColumn("kind", kind).filter("kind is not null").select("function", "kind", F.col("name").alias("value"), F.explode(F.when(F.size("args") > 0, F.col("args")).otherwise(F.array(F.lit(None).cast("int")))).alias("param"), "used")
    any_of = lambda parts: F.col("last").rlike("|".join(parts))
    named = flow.filter("kind = 'entry'").select(unit().alias("function"), F.lower(F.substring_index("function", ".", -1)).alias("last"), "params")
    named = named.withColumn("kind", F.when(any_of(CHECKING), "validator").when(any_of(CLEANING), "sanitizer")).filter("kind is not null")
    places = F.filter(F.transform("params", lambda p, i: F.when(~p.isin("self", "cls"), i)), lambda i: i.isNotNull())
    named = named.select("function", "kind", F.col("last").alias("value"), F.explode(F.when(F.size(places) > 0, places).otherwise(F.array(F.lit(None).cast("int")))).alias("param"), F.lit(True).alias("used"))
    return found.unionByName(named).distinct()
