"""Unified diffs as rows, and lines that are followed through a series of them, forwards or back to where they began.

The running line numbers of both sides are window sums over the lines of a patch. A line moves by what is added and taken away
before it, so a commit moves all lines of a file by one sort of lines and edits together; no pairs of them are built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.tables import cut_lineage

# Fixed values.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]"
FILE_HEADER = r'^diff --git (?:"((?:[^"\\]|\\.)*)"|(\S+)) (?:"((?:[^"\\]|\\.)*)"|(\S+))$'
HUNK_HEADER = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(.*)$"


def diff_lines(patches: DataFrame) -> DataFrame:
    """(patch, seq, old_path, new_path, hunk, kind, old_line, new_line, text) for each line of the hunks of (patch, text).

    kind is `-`, `+` or ` `; old_line and new_line are where it stands on either side, or for a line that one side lacks the
    line there that comes next. A hunk lasts until the next header. File headers that can't be read give a row of kind
    `fault`, and what follows them belongs to no file. Null and empty texts have no rows."""
    pos = Window.partitionBy("patch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lines = patches.select("patch", F.posexplode(F.split("text", LINE_END)).alias("seq", "line"))
    opens, hunk = F.col("line").startswith("diff --git "), F.col("line").rlike(HUNK_HEADER)
    part = lambda k: F.nullif(F.regexp_extract("line", FILE_HEADER, k), F.lit(""))
    at = lambda k: F.regexp_extract("line", HUNK_HEADER, k)
    # A side without lines in the hunk is named by the line before it.
    first = lambda a, b: at(a).cast("long") + F.when(at(b).rlike("^0+$"), 1).otherwise(0)
    path = lambda a, b, side: F.regexp_replace(F.coalesce(part(a), part(b)), f"^{side}/", "")
    header = F.when(opens, F.struct(path(1, 2, "a").alias("old"), path(3, 4, "b").alias("new")))
    start = F.when(hunk, F.struct(first(1, 2).alias("old"), first(3, 4).alias("new"), F.lit(True).alias("in"))).when(opens, F.struct(F.lit(None).cast("long").alias("old"), F.lit(None).cast("long").alias("new"), F.lit(False).alias("in")))
    df = lines.withColumns({"_file": F.last(header, True).over(pos), "_start": F.last(start, True).over(pos), "_section": F.count(start).over(pos), "_hunks": F.count_if(hunk).over(pos)})
    body = (~opens) & ~hunk & F.coalesce(F.col("_start.in"), F.lit(False)) & ~F.col("line").startswith("\\")
    mark = F.substring("line", 1, 1)
    kind = F.when(opens & F.col("_file.old").isNull(), "fault").when(body, F.when(mark.isin("-", "+"), mark).otherwise(" "))
    df = df.withColumn("kind", kind).filter("kind is not null")
    before = Window.partitionBy("patch", "_section").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda other: F.coalesce(F.count_if(F.col("kind") != other).over(before), F.lit(0))
    df = df.withColumns({"old_line": F.col("_start.old") + count("+"), "new_line": F.col("_start.new") + count("-")})
    text = F.when(F.col("kind") == "fault", F.col("line")).when(F.substring("line", 1, 1).isin("-", "+", " "), F.expr("substring(line, 2)")).otherwise(F.col("line"))
    return df.select("patch", "seq", F.col("_file.old").alias("old_path"), F.col("_file.new").alias("new_path"), F.col("_hunks").alias("hunk"), "kind", "old_line", "new_line", text.alias("text"))


def hunks(lines: DataFrame) -> DataFrame:
    """(patch, old_path, new_path, hunk, removed, added): the changed lines of each hunk, by their numbers on their own side."""
    own = lambda kind, line: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col(line))))  # noqa: E731  one hunk of one text
    return lines.filter("kind <> 'fault'").groupBy("patch", "old_path", "new_path", "hunk").agg(own("-", "old_line").alias("removed"), own("+", "new_line").alias("added"))


def edits(lines: DataFrame) -> DataFrame:
    """(patch, path, kind, old_line, new_line) of changed lines: what `followed` and `blamed` need of a diff."""
    return lines.filter("kind in ('-', '+')").select("patch", F.col("new_path").alias("path"), "kind", "old_line", "new_line")


def followed(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, path, line, lost): where the line of a claim (id, path, line) is after all changes (patch, path, kind, old_line,
    new_line), taken in the order of `patch`; lost is the patch that takes it away, and line its place before that one.

    Round k moves the lines of every file over its k-th patch, so rounds are the most patches that a file has."""
    order = Window.partitionBy("path").orderBy("patch")
    turn = changes.select("path", "patch").distinct().withColumn("turn", F.row_number().over(order))
    moves = cut_lineage(changes.join(turn, ["path", "patch"]))
    most = turn.agg(F.max("turn")).first()[0] or 0
    live = cut_lineage(claims.select("id", "path", "line", F.lit(None).cast(changes.schema["patch"].dataType).alias("lost")))
    for k in range(1, most + 1):
        now = moves.filter(F.col("turn") == k)
        gone = now.filter("kind = '-'").select("path", F.col("old_line").alias("line"), F.col("patch").alias("_gone")).distinct()
        # An added line moves what stands at its place, a removed one what comes after it.
        marks = now.select("path", F.col("old_line").alias("line"), F.when(F.col("kind") == "+", 0).otherwise(2).alias("_turn"), F.when(F.col("kind") == "+", 1).otherwise(-1).alias("_by"), F.lit(None).cast(claims.schema["id"].dataType).alias("id"))
        asked = live.filter("lost is null").select("path", "line", F.lit(1).alias("_turn"), F.lit(0).alias("_by"), "id", F.lit(True).alias("_ask"))
        line = Window.partitionBy("path").orderBy("line", "_turn").rowsBetween(Window.unboundedPreceding, 0)
        moved = marks.withColumn("_ask", F.lit(False)).unionByName(asked).withColumn("_moved", F.sum("_by").over(line)).filter("_ask").select("id", "path", "line", "_moved")
        moved = moved.join(gone, ["path", "line"], "left").select("id", "path", F.when(F.col("_gone").isNull(), F.col("line") + F.col("_moved")).otherwise(F.col("line")).alias("line"), F.col("_gone").alias("lost"))
        live = cut_lineage(live.filter("lost is not null").unionByName(moved))
    return live


def blamed(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, path, line, introduced): the patch that added the line of a claim, as it stands after all changes, with its place
    there; null where it is older than all of them, with its place before them. Changes are taken back, the last one first."""
    back = changes.select((-F.col("patch")).alias("patch"), "path", F.when(F.col("kind") == "+", "-").otherwise("+").alias("kind"), F.col("new_line").alias("old_line"), F.col("old_line").alias("new_line"))
    return followed(claims, back).select("id", "path", "line", (-F.col("lost")).alias("introduced"))
