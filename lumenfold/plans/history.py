"""Queries of diffs, lines followed through them, order of events and canonical JSON on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import canonical as C
from lumenfold.operators import temporal as T
from lumenfold.plans.catalog import query
from lumenfold.sources import patches as P
from lumenfold.sources.tables import table

HUNKS = """SELECT l_orderkey AS patch, 'f' || o_custkey AS path, l_linenumber AS n, max(CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE ' ' END) AS kind, 1 + l_orderkey % 5 AS old_start, 2 + l_orderkey % 3 AS new_start, 't' || max(l_partkey) AS text
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""
NUMBERED = f"SELECT *, old_start + coalesce(count_if(kind <> '+') OVER w, 0)::BIGINT AS old_line, new_start + coalesce(count_if(kind <> '-') OVER w, 0)::BIGINT AS new_line FROM ({HUNKS}) WINDOW w AS (PARTITION BY patch ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def patches(spark, d):
    """A patch of one file for each order, with a line for each of its lines."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.max(F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(" "))
    rows = lines.groupBy("l_orderkey", "o_custkey", "l_linenumber").agg(F.concat(kind, F.lit("t"), F.max("l_partkey").cast("string")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "row"))), lambda x: x["row"]), "\n")
    name, key = F.col("o_custkey").cast("string"), F.col("l_orderkey")
    text = F.concat(F.lit("diff --git a/f"), name, F.lit(" b/f"), name, F.lit("\nindex 0..1\n--- a/f"), name, F.lit("\n+++ b/f"), name, F.lit("\n@@ -"), (1 + key % 5).cast("string"), F.lit(",7 +"), (2 + key % 3).cast("string"), F.lit(" @@ def f():\n"), F.col("body"), F.lit("\n\\ No newline at end of file"))
    return rows.groupBy("l_orderkey", "o_custkey").agg(body.alias("body")).select(F.col("l_orderkey").alias("patch"), text.alias("text"))


@query(f"SELECT patch, path AS old_path, path AS new_path, kind, old_line, new_line, text FROM ({NUMBERED})")
def q_diff_lines(spark, d):
    return P.diff_lines(patches(spark, d)).drop("seq", "hunk")


@query(f"SELECT patch, path AS old_path, path AS new_path, 1::BIGINT AS hunk, coalesce(list(old_line ORDER BY old_line) FILTER (kind = '-'), []) AS removed, coalesce(list(new_line ORDER BY new_line) FILTER (kind = '+'), []) AS added FROM ({NUMBERED}) GROUP BY patch, path")
def q_diff_hunks(spark, d):
    return P.hunks(P.diff_lines(patches(spark, d)))


def history_sql(old: str, new: str, gone: str, came: str, order: str, name: str) -> str:
    """Lines moved over the patches of their file, by the lists of a patch's edits."""
    return f"""WITH RECURSIVE x AS (SELECT patch, path, list({old}) FILTER (kind = '{gone}') AS gone, list({old}) FILTER (kind = '{came}') AS came FROM ({NUMBERED}) WHERE kind <> ' ' GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY patch {order}) AS turn FROM x),
r AS (SELECT c_custkey AS id, 'f' || c_custkey AS path, 1 + c_custkey % 9 AS line, NULL::BIGINT AS {name}, 0::BIGINT AS turn FROM customer
  UNION ALL SELECT id, r.path, CASE WHEN coalesce(list_contains(gone, line), false) THEN line ELSE line - len(list_filter(coalesce(gone, []), lambda g: g < line)) + len(list_filter(coalesce(came, []), lambda g: g <= line)) END, CASE WHEN coalesce(list_contains(gone, line), false) THEN patch END, c.turn
  FROM r JOIN c ON c.path = r.path AND c.turn = r.turn + 1 WHERE r.{name} IS NULL)
SELECT id, path, line, {name} FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1"""


def claims(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"), (1 + F.col("c_custkey") % 9).alias("line"))


@query(history_sql("old_line", "new_line", "-", "+", "", "lost"))
def q_line_followed(spark, d):
    return P.followed(claims(spark, d), P.edits(P.diff_lines(patches(spark, d))))


@query(history_sql("new_line", "old_line", "+", "-", "DESC", "introduced"))
def q_line_blamed(spark, d):
    return P.blamed(claims(spark, d), P.edits(P.diff_lines(patches(spark, d))))


OPERATIONS = {"signup": "Lock.acquire", "purchase": "lock.release", "click": "open_file", "view": "close_file", "error": "db.disconnect"}
HELD = """SELECT user_id, event_id, kind, held FROM (SELECT *, min(held) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id)) AS held FROM (SELECT *, sum(step) OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, event_id, ts, kind, CASE kind WHEN 'resource' THEN CASE WHEN event_type IN ('signup', 'click') THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END
    WHEN 'lock' THEN CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END ELSE CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END END AS step FROM events, (VALUES ('resource'), ('lock'), ('file')) k(kind)) WHERE step <> 0))) WHERE step = 1 AND coalesce(later, held) >= held"""


@query(HELD.replace("user_id, event_id, kind, held FROM", "user_id, event_id, kind, held::BIGINT AS held FROM", 1))
def q_unreleased(spark, d):
    """What the events of a user take and never give back, by kind of thing."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    name = F.lit("")
    for k, v in OPERATIONS.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("step")) for k, s in T.steps(F.col("op")).items()])
    e = e.withColumn("op", name).select("user_id", "event_id", "ts", F.explode(each).alias("_k")).select("user_id", "event_id", "ts", "_k.kind", "_k.step")
    return T.unreleased(e, ["user_id", "kind"], ["ts", "event_id"], "step").select("user_id", "event_id", "kind", "held")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95) GROUP BY 1")
def q_unhandled_calls(spark, d):
    e = table(spark, d, "events")
    return T.unhandled(e, e.filter("event_type = 'error' and value > 95"), "user_id", F.col("event_type").isin("click", "view"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","id":' || p_partkey || ',"size":{"list":[' || p_size || ',null,' || (p_size + 1) || '],"odd":' || CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END || '},"tag":{"a":"\\u00e9\\n","b":"' || p_partkey || '"}}') AS digest FROM part""")
def q_canonical_digest(spark, d):
    size = F.struct((F.col("p_size") % 2 == 1).alias("odd"), F.array("p_size", F.lit(None).cast("int"), F.col("p_size") + 1).alias("list"))
    value = F.struct(F.create_map(F.lit("b"), F.col("p_partkey").cast("string"), F.lit("a"), F.lit("é\n")).alias("tag"), size.alias("size"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    df = table(spark, d, "part").select("p_partkey", value.alias("v"))
    return df.select("p_partkey", C.digest(F.col("v"), df.schema["v"].dataType).alias("digest"))
