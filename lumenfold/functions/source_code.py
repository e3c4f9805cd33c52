"""Table functions over Python source text: (path, source) in; functions, calls, imports, routes and issues out.

Files that don't parse give one row of kind `error`. Parsing needs Python, so each is one Arrow pass over the files;
what follows (call resolution, cycles, impact) are joins."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, name string, target string, line int, end_line int, detail string"
FIELDS = ["path", "kind", "name", "target", "line", "end_line", "detail"]
# Fixed values.
ROUTE_METHODS = {"get", "post", "put", "patch", "delete", "route"}
DANGEROUS_CALLS = {"eval": "CWE-95", "exec": "CWE-95", "os.system": "CWE-78", "pickle.loads": "CWE-502", "yaml.load": "CWE-502", "subprocess.call": "CWE-78", "hashlib.md5": "CWE-327"}
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
NETWORK_CALLS = ("requests.get", "requests.post", "requests.put", "requests.delete", "urllib.request.urlopen")


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def owners(tree: ast.AST) -> Iterator[tuple[ast.AST, str, str]]:
    """Every node with the qualified name of the function and of the class that it stands in."""
    stack = [(tree, "", "")]
    while stack:
        node, function, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                stack.append((child, function, child.name))
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                stack.append((child, ".".join(x for x in (owner, child.name) if x), owner))
            else:
                stack.append((child, function, owner))
            yield child, function, owner


def facts(tree: ast.AST) -> Iterator[tuple]:
    """(kind, name, target, line, end_line, detail) of functions, calls, imports and routes."""
    for node, function, owner in owners(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = ".".join(x for x in (owner, node.name) if x)
            yield "function", name, "", node.lineno, node.end_lineno, str(len(node.args.args))
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_METHODS and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                    yield "route", name, d.args[0].value, node.lineno, node.end_lineno, "GET" if d.func.attr == "route" else d.func.attr.upper()
        elif isinstance(node, ast.Call) and (called := dotted(node.func)):
            yield "call", function, called, node.lineno, node.end_lineno, ""
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", "", a.name, node.lineno, node.end_lineno, "absolute"
        elif isinstance(node, ast.ImportFrom):
            yield "import", "", node.module or "", node.lineno, node.end_lineno, "relative" if node.level else "absolute"


def issues(tree: ast.AST) -> Iterator[tuple]:
    """(kind, name, target, line, end_line, detail) of structural and security checks; name is the check."""
    for node, function, _ in owners(tree):
        found = []
        if isinstance(node, ast.Call):
            called = dotted(node.func)
            if called in DANGEROUS_CALLS:
                found.append(("dangerous_call", DANGEROUS_CALLS[called]))
            if called in NETWORK_CALLS and not any(k.arg == "timeout" for k in node.keywords):
                found.append(("missing_timeout", "CWE-400"))
            if any(k.arg == "verify" and isinstance(k.value, ast.Constant) and k.value.value is False for k in node.keywords):
                found.append(("unverified_tls", "CWE-295"))
            if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords):
                found.append(("shell_call", "CWE-78"))
            if called.endswith(".execute") and node.args and isinstance(node.args[0], (ast.JoinedStr, ast.BinOp)):
                found.append(("built_query", "CWE-89"))
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and node.value.value:
            if any(isinstance(t, ast.Name) and any(s in t.id.lower() for s in SECRET_NAMES) for t in node.targets):
                found.append(("hardcoded_secret", "CWE-798"))
        elif isinstance(node, ast.Compare) and any(isinstance(o, (ast.Eq, ast.NotEq)) for o in node.ops) and any(isinstance(c, ast.Constant) and isinstance(c.value, float) for c in [node.left, *node.comparators]):
            found.append(("float_equality", ""))
        elif isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Div, ast.FloorDiv, ast.Mod)) and not isinstance(node.right, ast.Constant) and not (isinstance(node.left, ast.Constant) and isinstance(node.left.value, str)):
            found.append(("unchecked_division", "CWE-369"))
        elif isinstance(node, ast.ExceptHandler) and node.type is None:
            found.append(("bare_except", "CWE-396"))
        elif isinstance(node, ast.Assert):
            found.append(("assertion", ""))
        for name, cwe in found:
            yield "issue", name, function, node.lineno, node.end_lineno, cwe


def _over(files: DataFrame, walk: Callable[[ast.AST], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, source in zip(b["path"], b["source"], strict=True):
                try:
                    rows += [(path, *r) for r in walk(ast.parse(source or ""))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "error", "", "", getattr(e, "lineno", None), None, type(e).__name__))
            out = pd.DataFrame(rows, columns=FIELDS)
            yield out.astype({"line": "Int32", "end_line": "Int32"})

    return files.select("path", "source").mapInPandas(run, SCHEMA)


def code_facts(files: DataFrame) -> DataFrame:
    return _over(files, facts)


def code_issues(files: DataFrame) -> DataFrame:
    return _over(files, issues)


def call_edges(found: DataFrame) -> DataFrame:
    """(path, src, dst): calls resolved to functions of the file by their whole name, then as a method of the caller's
    class, then by their last part where only one function ends so."""
    fn = found.filter("kind = 'function'").select("path", F.col("name").alias("dst"))
    calls = found.filter("kind = 'call' and name <> ''").select("path", F.col("name").alias("src"), "target").distinct()
    own = F.when(F.col("target").startswith("self."), F.concat_ws(".", F.substring_index("src", ".", 1), F.substring_index("target", ".", -1))).otherwise(F.col("target"))
    calls = calls.withColumn("whole", own)
    exact = calls.join(fn, (calls["path"] == fn["path"]) & (calls["whole"] == fn["dst"])).select(calls["path"], "src", "target", "dst")
    rest = calls.join(exact.select("path", "src", "target"), ["path", "src", "target"], "left_anti").withColumn("last", F.substring_index("target", ".", -1))
    tails = fn.withColumn("last", F.substring_index("dst", ".", -1)).groupBy("path", "last").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    loose = rest.join(tails, ["path", "last"]).select("path", "src", "target", "dst")
    return exact.union(loose).select("path", "src", "dst").distinct()
