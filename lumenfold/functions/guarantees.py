"""What functions guarantee by what they call and how they are marked, and which of it holds where they are called: rules over
the rows of `source_flow.code_flow`, and an index that resolves names through imports by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What a guarantee says, how sure it is, and what it is drawn from.
MARKS = (("login_required", "route.requires_login == true", 0.95), ("admin_required", "route.requires_admin == true", 0.95))
CALLS = (
    ("basename", "filename.basename_only == true", 0.82),
    ("secure_filename", "filename.matches_allowed_pattern == true", 0.9),
    ("secure_filename", "filename.user_controlled == false", 0.8),
    ("uuid4", "identifier.server_generated == true", 0.9),
    ("token_urlsafe", "identifier.server_generated == true", 0.9),
    ("token_hex", "identifier.server_generated == true", 0.9),
    ("token_bytes", "identifier.server_generated == true", 0.9),
)
GENERATING = ("uuid4", "token_urlsafe", "token_hex", "token_bytes", "secure_filename")
GENERATED = (("filename.server_generated == true", 0.84), ("filename.user_controlled == false", 0.8))
SCOPES = (("source_id", "query.scoped_to_current_source == true", 0.94), ("source_uuid", "query.scoped_to_current_source == true", 0.94), ("user_id", "query.scoped_to_current_user == true", 0.94), ("owner_id", "query.scoped_to_current_user == true", 0.94))
PRINCIPALS = "current_user|current_source|logged_in|session"
BOUNDARY_FUNCTIONS, BOUNDARY_CALLS, BOUNDARY_SURE = ("verify", "store_contains", "path"), ("commonpath", "verify", "store_contains"), 0.92
IMPORTS = "path string, local string, module string, name string, level int"


def guarantees(flow: DataFrame) -> DataFrame:
    """(path, function, says, confidence, line, variables, used): the guarantees of functions, each once at its first line. `variables`
    are what the statement defines; `used` says if the call's result goes anywhere, and is null where no call is behind it."""
    none = F.lit(None)
    marks = F.transform(F.when(F.col("kind") == "entry", F.col("marks")), lambda m: F.struct(m.alias("mark"), none.cast("string").alias("name"), none.cast("boolean").alias("used"), none.cast("map<string,string>").alias("named")))
    calls = F.transform(F.when(F.col("kind") != "error", F.col("calls")), lambda c: F.struct(none.cast("string").alias("mark"), c["name"].alias("name"), c["used"].alias("used"), c["named"].alias("named")))
    no_items = F.array().cast("array<struct<mark:string,name:string,used:boolean,named:map<string,string>>>")
    each = flow.select("path", "function", "line", "defs", F.explode(F.concat(F.coalesce(marks, no_items), F.coalesce(calls, no_items))).alias("c")).select("path", "function", "line", "defs", "c.*")
    mark, name, of_mark = F.lower("mark"), F.lower("name"), F.array().cast("array<string>")
    says = lambda met, text, sure, variables=F.col("defs"), used=F.col("used"): F.when(met, F.struct(F.lit(text).alias("says"), F.lit(sure).alias("confidence"), variables.alias("variables"), used.alias("used")))
    any_of = lambda parts: reduce(or_, [name.endswith(part) for part in parts])
    files = F.exists("defs", lambda v: F.lower(v).contains("filename") | F.lower(v).endswith("path"))
    last = F.substring_index(F.lower("function"), ".", -1)
    found = [says(mark.endswith(part), text, sure, of_mark) for part, text, sure in MARKS]
    found += [says(name.endswith(part), text, sure) for part, text, sure in CALLS]
    found += [says(any_of(GENERATING) & files, text, sure, used=F.lit(True)) for text, sure in GENERATED]
    found += [says(name.endswith("filter_by") & F.try_element_at("named", F.lit(k)).rlike(PRINCIPALS), text, sure) for k, text, sure in SCOPES]
    found += [says((last == part) & any_of(BOUNDARY_CALLS), f"storage.{part}.enforces_store_boundary == true", BOUNDARY_SURE) for part in BOUNDARY_FUNCTIONS]
    each = each.select("path", "function", "line", F.explode(F.array_compact(F.array(*found))).alias("g"))
    first = F.min(F.struct("line", "g.variables", "g.used")).alias("f")
    return each.groupBy("path", "function", F.col("g.says").alias("says"), F.col("g.confidence").alias("confidence")).agg(first).select("path", "function", "says", "confidence", "f.line", "f.variables", "f.used")


def code_imports(files: DataFrame) -> DataFrame:
    """(path, local, module, name, level): the names that the files of (path, source) import, wherever they do; name is null for
    modules. Files that don't parse import nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, source in zip(b["path"], b["source"], strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, ast.Import):
                        rows += [(path, a.asname or a.name, a.name, None, 0) for a in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        rows += [(path, a.asname or a.name, n.module or "", a.name, n.level) for a in n.names]
            yield pd.DataFrame(rows, columns=["path", "local", "module", "name", "level"]).astype({"level": "int32"})

    return files.select("path", "source").mapInPandas(run, IMPORTS)


def resolved_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, local, target, name): imports with the file (path) of `paths` that they mean: a module's own file, or its
    package's. A name of a package may be a module of it; then name is null and local stands for that module."""
    parts = lambda c: F.filter(F.split(c, r"\."), lambda x: x != "")
    folder = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - F.greatest("level", F.lit(1)), F.lit(0)))
    base = F.when(F.col("level") > 0, F.concat(folder, parts(F.col("module")))).otherwise(parts(F.col("module")))
    df = imports.withColumn("base", F.array_join(base, "/")).distinct()
    inside = F.concat_ws("/", F.nullif("base", F.lit("")), F.col("name"))
    tries = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(inside, F.lit(".py")).alias("file"), F.lit(None).cast("string").alias("as")), F.struct(F.lit(1).alias("rank"), F.concat(inside, F.lit("/__init__.py")).alias("file"), F.lit(None).cast("string").alias("as")),
        F.struct(F.lit(2).alias("rank"), F.concat("base", F.lit(".py")).alias("file"), F.col("name").alias("as")), F.struct(F.lit(3).alias("rank"), F.concat("base", F.lit("/__init__.py")).alias("file"), F.col("name").alias("as")),
    )
    tries = F.when(F.col("name").isNull(), F.slice(tries, 3, 2)).otherwise(tries)
    asked = df.select("path", "local", F.explode(tries).alias("t")).select("path", "local", "t.*")
    known = paths.select(F.col("path").alias("file")).distinct()
    return asked.join(known, "file").groupBy("path", "local").agg(F.min(F.struct("rank", "file", "as")).alias("b")).select("path", "local", F.col("b.file").alias("target"), F.col("b.as").alias("name"))


def propagated(flow: DataFrame, found: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, function, line, call, target, says, confidence, variables, used): guarantees of called functions where they are called. A
    call means the function that its name stands for in the file: one that is imported, or a member of an imported module,
    else one of the file itself, else the only one in all files of that last name. variables and used are the caller's."""
    calls = flow.filter("kind <> 'error'").select("path", "function", "line", "defs", F.explode("calls").alias("c")).select("path", "function", "line", F.col("defs").alias("variables"), F.col("c.name").alias("call"), F.col("c.used").alias("used")).distinct()
    calls = calls.withColumns({"head": F.substring_index("call", ".", 1), "last": F.substring_index("call", ".", -1)})
    # The longest imported name that a call begins with: `pkg.mod.f` by `import pkg.mod`, `f` by `from m import f`.
    starts = F.transform(F.sequence(F.lit(1), F.size(F.split("call", r"\."))), lambda n: F.array_join(F.slice(F.split("call", r"\."), F.lit(1), n), "."))
    asked = calls.select("path", "call", F.explode(starts).alias("local")).distinct().join(imports, ["path", "local"])
    rest = F.expr("substring(call, length(local) + 2)")
    meant = F.concat_ws(".", F.col("name"), F.nullif(rest, F.lit("")))
    by_import = asked.groupBy("path", "call").agg(F.max(F.struct(F.length("local").alias("n"), F.col("target"), meant.alias("meant"))).alias("m")).select("path", "call", F.col("m.target").alias("_target"), F.col("m.meant").alias("_meant"))
    known = flow.filter("kind = 'entry'").select(F.col("path").alias("_path"), F.col("function").alias("_function")).distinct()
    here = known.select(F.col("_path").alias("path"), F.col("_function").alias("call"), F.col("_function").alias("_here"))
    only = known.groupBy(F.substring_index("_function", ".", -1).alias("last")).agg(F.min(F.struct("_path", "_function")).alias("_only"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("last", "_only")
    df = calls.join(by_import, ["path", "call"], "left").join(here, ["path", "call"], "left").join(only, "last", "left")
    target = F.when(F.col("_target").isNotNull(), F.struct(F.col("_target").alias("p"), F.col("_meant").alias("f"))).when(F.col("_here").isNotNull(), F.struct(F.col("path").alias("p"), F.col("_here").alias("f"))).otherwise(F.struct(F.col("_only._path").alias("p"), F.col("_only._function").alias("f")))
    df = df.withColumn("t", target).filter("t.p is not null").select("path", "function", "line", "call", "variables", "used", F.col("t.p").alias("tp"), F.col("t.f").alias("tf"))
    g = found.select(F.col("path").alias("tp"), F.col("function").alias("tf"), "says", "confidence")
    return df.join(g, ["tp", "tf"]).select("path", "function", "line", "call", F.concat_ws("::", "tp", "tf").alias("target"), "says", "confidence", "variables", "used")
