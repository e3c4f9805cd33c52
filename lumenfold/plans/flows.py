"""Queries of call summaries, taint, data flow and guards: parts and suppliers are functions that call each other, the lines
of an order the statements of one function with branches and loops. Whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import guarantees as H
from lumenfold.functions import source_flow as C
from lumenfold.functions import texts as X
from lumenfold.operators import dataflow as D
from lumenfold.operators import graphs as G
from lumenfold.operators import summaries as Y
from lumenfold.plans.catalog import query
from lumenfold.sources.tables import cut_lineage, table

#: Mostly downwards, with some edges back up, so that there are components of several functions.
CALLS = """SELECT DISTINCT l_partkey AS caller, l_suppkey AS callee, {args} AS args, l_returnflag <> 'R' AS used FROM lineitem WHERE l_linenumber = 1 AND l_suppkey * 3 < l_partkey
  UNION SELECT DISTINCT l_suppkey, l_partkey, {same}, true FROM lineitem WHERE l_quantity > 25 AND l_partkey <= 2 * l_suppkey"""
CALLS_SQL = CALLS.format(args="[nullif(l_quantity::INTEGER % 4, 3), nullif((l_quantity::INTEGER + 1) % 4, 3), nullif((l_quantity::INTEGER + 2) % 4, 3)]", same="[0, 1, 2]")
EFFECTS = """SELECT p_partkey AS function, CASE p_size % 3 WHEN 0 THEN 'sink' WHEN 1 THEN 'source' ELSE 'sanitizer' END AS kind, p_brand AS value, CAST(nullif(p_partkey % 4, 3) AS INTEGER) AS param, p_retailprice > 1000 AS used FROM part WHERE p_size <= 5"""
E_SQL = f"e AS (SELECT DISTINCT caller AS src, callee AS dst FROM ({CALLS_SQL}))"



def calls(spark, d):
    lines = table(spark, d, "lineitem")
    handed = lambda k: F.expr(f"nullif((cast(l_quantity as int) + {k}) % 4, 3)")
    down = lines.filter("l_linenumber = 1 and l_suppkey * 3 < l_partkey").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), F.array(handed(0), handed(1), handed(2)).alias("args"), (F.col("l_returnflag") != "R").alias("used"))
    up = lines.filter("l_quantity > 25 and l_partkey <= 2 * l_suppkey").select("l_suppkey", "l_partkey", F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(True))
    return down.union(up).distinct()


def call_edges(spark, d):
    return calls(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def effects(spark, d):
    return effects_of(table(spark, d, "part").filter("p_size <= 5"))


def effects_of(p):
    kind = F.when(F.expr("p_size % 3 = 0"), "sink").when(F.expr("p_size % 3 = 1"), "source").otherwise("sanitizer")
    return p.select(F.col("p_partkey").alias("function"), kind.alias("kind"), F.col("p_brand").alias("value"), F.expr("cast(nullif(p_partkey % 4, 3) as int)").alias("param"), (F.col("p_retailprice") > 1000).alias("used"))


@query(f"""WITH RECURSIVE {E_SQL}, n AS (SELECT p_partkey AS node FROM part UNION SELECT src FROM e UNION SELECT dst FROM e),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
k AS (SELECT DISTINCT x.component AS up, y.component AS down FROM e JOIN c x ON e.src = x.node JOIN c y ON e.dst = y.node),
l AS (SELECT DISTINCT component, 0 AS level FROM c UNION SELECT k.up, l.level + 1 FROM l JOIN k ON k.down = l.component AND k.up <> k.down)
SELECT node, component, level, component IN (SELECT up FROM k WHERE up = down) AS recursive FROM c JOIN (SELECT component, max(level)::INTEGER AS level FROM l GROUP BY component) USING (component)""")
def q_call_order(spark, d):
    """The order in which functions are summed up: components of calls, from those that call no other upwards."""
    return G.bottom_up(table(spark, d, "part").select(F.col("p_partkey").alias("node")), call_edges(spark, d))


#: Every line is a call, and every part has an effect.
ALL_CALLS = """SELECT DISTINCT CASE WHEN down THEN l_partkey ELSE l_suppkey END AS caller, CASE WHEN down THEN l_suppkey ELSE l_partkey END AS callee, NOT down OR l_returnflag <> 'R' AS used,
  CASE WHEN down THEN [nullif(l_quantity::INTEGER % 4, 3), nullif((l_quantity::INTEGER + 1) % 4, 3), nullif((l_quantity::INTEGER + 2) % 4, 3)] ELSE [0, 1, 2] END AS args FROM (SELECT *, l_suppkey * 3 < l_partkey AS down FROM lineitem)"""
ALL_EFFECTS = EFFECTS.replace(" WHERE p_size <= 5", "")


def all_calls(spark, d):
    down = F.expr("l_suppkey * 3 < l_partkey")
    handed = F.array(*[F.expr(f"nullif((cast(l_quantity as int) + {k}) % 4, 3)") for k in range(3)])
    ends = F.when(down, F.struct(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"))).otherwise(F.struct(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")))
    args = F.when(down, handed).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, d, "lineitem").select(ends.alias("ends"), args.alias("args"), (~down | (F.col("l_returnflag") != "R")).alias("used")).select("ends.*", "args", "used").distinct()


@query(f"""WITH RECURSIVE c AS ({ALL_CALLS}), s(function, kind, value, param, used, depth, via) USING KEY (function, kind, value, param, used) AS (SELECT DISTINCT function, kind, value, param, used, 0, NULL::BIGINT FROM ({ALL_EFFECTS})
  UNION SELECT n.function, n.kind, n.value, n.param, n.used, n.depth, n.via FROM (
    SELECT c.caller AS function, s.kind, s.value, CASE WHEN s.param IS NOT NULL THEN c.args[s.param + 1] END AS param, s.used AND c.used AS used, min(s.depth) + 1 AS depth, min(c.callee) AS via FROM s JOIN c ON c.callee = s.function WHERE s.param IS NULL OR c.args[s.param + 1] IS NOT NULL GROUP BY 1, 2, 3, 4, 5) n
  LEFT JOIN recurring.s k ON k.function = n.function AND k.kind = n.kind AND k.value = n.value AND k.param IS NOT DISTINCT FROM n.param AND k.used = n.used WHERE k.function IS NULL)
SELECT * FROM s UNION ALL SELECT DISTINCT caller, 'wrapper', callee::VARCHAR, NULL, used, 1, callee FROM c""")
def q_function_summaries(spark, d):
    """What every part and supplier does through its calls, however deep."""
    return Y.summarised(effects_of(table(spark, d, "part")), all_calls(spark, d), None)


@query(f"""WITH RECURSIVE c AS ({CALLS_SQL}), s AS (SELECT function, kind, value, param, used, 0 AS depth FROM ({EFFECTS})
  UNION SELECT c.caller, s.kind, s.value, CASE WHEN s.param IS NOT NULL THEN c.args[s.param + 1] END, s.used AND c.used, s.depth + 1 FROM s JOIN c ON c.callee = s.function WHERE s.depth < 3 AND (s.param IS NULL OR c.args[s.param + 1] IS NOT NULL))
SELECT function FROM (SELECT function, min(depth) AS depth FROM s GROUP BY function, kind, value, param, used) WHERE depth = 3 GROUP BY function""")
def q_summaries_cut_short(spark, d):
    """Functions whose summaries lack an effect when calls are followed to a depth of two."""
    c = calls(spark, d)
    return Y.cut_short(Y.summarised(effects(spark, d), c, 2), c, 2)


SANITIZERS = "SELECT s_suppkey AS node, CASE s_nationkey % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'command' WHEN 2 THEN 'all' ELSE 'sql' END AS kind FROM supplier WHERE s_nationkey < 8"
SINKS = "SELECT s_suppkey AS node, CASE WHEN s_acctbal < 4000 THEN 'sql' ELSE 'command' END AS kind FROM supplier WHERE s_nationkey >= 5"
SOURCES = "SELECT p_partkey AS node, p_brand AS label FROM part WHERE p_size = 50"


@query(f"""WITH RECURSIVE {E_SQL}, z AS (SELECT node, list(kind) AS kinds FROM ({SANITIZERS}) GROUP BY node), f AS (SELECT src, dst, coalesce(kinds, []) AS kinds FROM e LEFT JOIN z ON z.node = dst),
s AS (SELECT node, node AS source, label, []::VARCHAR[] AS clean, 0 AS depth FROM ({SOURCES}) UNION SELECT f.dst, source, label, list_sort(list_distinct(clean || kinds)), depth + 1 FROM s JOIN f ON f.src = s.node WHERE depth < 32)
SELECT source, label, sink, kind, sanitized, CASE WHEN sanitized THEN 0.4 ELSE 0.85 END::DOUBLE AS confidence, min(depth)::INTEGER AS depth, true AS whole FROM (
  SELECT source, label, t.node AS sink, t.kind, list_contains(clean, t.kind) OR list_contains(clean, 'all') AS sanitized, depth FROM s JOIN ({SINKS}) t ON t.node = s.node WHERE depth > 0) GROUP BY ALL""")
def q_taint_paths(spark, d):
    """Values of sources that reach a sink over calls; each path begins at its source, ends at its sink and is as long as it says."""
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    sanitizers = s.filter("s_nationkey < 8").selectExpr("s_suppkey AS node", "CASE s_nationkey % 4 WHEN 1 THEN 'command' WHEN 2 THEN 'all' ELSE 'sql' END AS kind")
    sinks = s.filter("s_nationkey >= 5").selectExpr("s_suppkey AS node", "CASE WHEN s_acctbal < 4000 THEN 'sql' ELSE 'command' END AS kind")
    found = Y.tainted(call_edges(spark, d), p.filter("p_size = 50").selectExpr("p_partkey AS node", "p_brand AS label"), sinks, sanitizers)
    whole = (F.size("path") == F.col("depth") + 1) & (F.col("path")[0] == F.col("source")) & (F.element_at("path", -1) == F.col("sink"))
    return found.withColumn("whole", whole).drop("path")


STATEMENTS = "SELECT DISTINCT l_orderkey AS unit, l_linenumber AS node, list(DISTINCT 'v' || l_suppkey % 3) AS defs, list_distinct(list('v' || l_partkey % 3) || list('v' || l_partkey % 2)) AS uses FROM lineitem GROUP BY 1, 2"
STEPS = """SELECT DISTINCT l_orderkey AS unit, l_linenumber AS src, l_linenumber + 1 AS dst FROM lineitem WHERE l_returnflag <> 'A'
  UNION SELECT l_orderkey, l_linenumber, l_linenumber + 2 FROM lineitem WHERE l_returnflag <> 'N' UNION SELECT l_orderkey, l_linenumber, l_linenumber - 2 FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber % 3 = 0"""


def statements(spark, d):
    lines = table(spark, d, "lineitem")
    name = lambda c, n: F.concat(F.lit("v"), (F.col(c) % n).cast("string"))
    return lines.groupBy(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("node")).agg(F.collect_set(name("l_suppkey", 3)).alias("defs"), F.array_union(F.collect_set(name("l_partkey", 3)), F.collect_set(name("l_partkey", 2))).alias("uses"))


def steps(spark, d):
    """What may run after a line: the next one, the one after it, or an earlier one."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("src"), "l_returnflag", "l_linestatus")
    to = F.array(F.when(F.col("l_returnflag") != "A", 1), F.when(F.col("l_returnflag") != "N", 2), F.when((F.col("l_linestatus") == "O") & (F.col("src") % 3 == 0), -2))
    return lines.select("unit", "src", F.explode(F.array_compact(to)).alias("by")).select("unit", "src", (F.col("src") + F.col("by")).alias("dst")).distinct()


@query(f"""WITH RECURSIVE s AS ({STATEMENTS}), e AS ({STEPS}), d AS (SELECT unit, node, unnest(defs) AS name FROM s),
r AS (SELECT d.unit, e.dst AS node, d.name, d.node AS definition FROM d JOIN e ON e.unit = d.unit AND e.src = d.node UNION SELECT r.unit, e.dst, r.name, r.definition FROM r JOIN s ON s.unit = r.unit AND s.node = r.node AND NOT list_contains(s.defs, r.name) JOIN e ON e.unit = r.unit AND e.src = r.node)
SELECT DISTINCT u.unit, u.name, r.definition, u.node AS use FROM (SELECT unit, node, unnest(uses) AS name FROM s) u JOIN r ON r.unit = u.unit AND r.node = u.node AND r.name = u.name""")
def q_def_use(spark, d):
    return D.def_use(statements(spark, d), steps(spark, d))


@query(f"SELECT unit, name, max(node) AS origin FROM (SELECT unit, node, unnest(defs) AS name FROM ({STATEMENTS})) GROUP BY 1, 2")
def q_variable_origins(spark, d):
    return D.origins(statements(spark, d))


@query(f"""WITH RECURSIVE e AS ({STEPS}), n AS (SELECT DISTINCT l_orderkey AS unit, l_linenumber AS node, l_returnflag AS f FROM lineitem), g AS (SELECT DISTINCT unit, node AS gate FROM n WHERE f = 'R'),
t AS (SELECT g.unit, gate, node AS target FROM g JOIN n ON n.unit = g.unit AND n.node <> g.gate),
r AS (SELECT unit, gate, 1 AS node FROM g UNION SELECT r.unit, r.gate, e.dst FROM r JOIN e ON e.unit = r.unit AND e.src = r.node AND NOT (e.src = r.gate AND e.dst = r.gate + 1))
SELECT DISTINCT t.unit, t.gate, target FROM t JOIN r ON r.unit = t.unit AND r.gate = t.gate AND r.node = t.target""")
def q_guard_bypassed(spark, d):
    """Branches of an order's lines as gates that let through to the next line; the lines that a way around the gate reaches."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("node"), "l_returnflag").distinct()
    gates = lines.filter("l_returnflag = 'R'").select("unit", F.col("node").alias("gate"), F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).distinct()
    targets = gates.select("unit", "gate").join(lines.select("unit", F.col("node").alias("target")), "unit").filter("gate <> target").distinct()
    entries = gates.select("unit", F.lit(1).alias("node")).distinct()
    return G.dominators_fail(steps(spark, d), entries, gates, targets)


@query("""WITH f AS (SELECT s_nationkey AS unit, s_suppkey AS source_line, s_suppkey * 15 AS sink_line, CASE WHEN s_acctbal < 0 THEN 0.4 ELSE 0.85 END::DOUBLE AS flow_confidence FROM supplier)
SELECT c_custkey, c_nationkey AS unit, c_custkey AS line, source_line, sink_line, flow_confidence FROM customer LEFT JOIN f ON unit = c_nationkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(sink_line - c_custkey), flow_confidence DESC, source_line) = 1""")
def q_attached_flows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"), F.col("c_custkey").alias("line"))
    flows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_suppkey").alias("source_line"), (F.col("s_suppkey") * 15).alias("sink_line"), F.when(F.col("s_acctbal") < 0, 0.4).otherwise(0.85).alias("confidence"))
    return D.attached(c, flows)


CODE = """SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) * 2 + 1 AS line, l_returnflag = 'R' AS maybe, 'v' || l_suppkey % 3 AS d, 'v' || l_partkey % 3 AS u1, 'v' || l_partkey % 2 AS u2
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)"""


def sources(spark, d):
    """A Python file with one function for each order: its lines assign one name from two others, some of them under a
    condition."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_suppkey").alias("supplier"), F.max("l_partkey").alias("part"))
    name = lambda c, n: F.concat(F.lit("v"), (F.col(c) % n).cast("string"))
    made = F.concat(name("supplier", 3), F.lit(" = g("), name("part", 3), F.lit(", "), name("part", 2), F.lit(")"))
    text = F.when(F.col("flag") == "R", F.concat(F.lit("    if True:\n        "), made)).otherwise(F.concat(F.lit("    pass\n    "), made))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("text")))), lambda x: x["text"])  # the lines of one order
    key = F.col("l_orderkey").cast("string")
    return lines.groupBy("l_orderkey").agg(rows.alias("rows")).select(F.concat(F.lit("f"), key, F.lit(".py")).alias("path"), F.concat(F.lit("def f"), key, F.lit("(v0, v1):\n"), F.array_join("rows", "\n"), F.lit("\n")).alias("source"))


@query(f"""WITH c AS ({CODE}), d AS (SELECT o, line, maybe, d AS name FROM c UNION ALL SELECT DISTINCT o, 1, false, unnest(['v0', 'v1']) FROM c), u AS (SELECT o, line, u1 AS name FROM c UNION SELECT o, line, u2 FROM c)
SELECT 'f' || u.o || '.py::f' || u.o AS unit, u.name, d.line AS def_line, u.line AS use_line FROM u JOIN d ON d.o = u.o AND d.name = u.name AND d.line < u.line
WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.o = u.o AND k.name = u.name AND NOT k.maybe AND k.line > d.line AND k.line < u.line)""")
def q_code_def_use(spark, d):
    """Definitions and uses by the lines of source text, conditions included."""
    flow = cut_lineage(C.code_flow(sources(spark, d)))  # parsed once
    s = C.statements(flow)
    found = D.def_use(s, C.edges(flow))
    at = s.select("unit", "node", "line")
    found = found.filter("name <> 'g'").join(at.toDF("unit", "definition", "def_line"), ["unit", "definition"]).join(at.toDF("unit", "use", "use_line"), ["unit", "use"])
    return found.select("unit", "name", F.col("def_line").cast("long").alias("def_line"), F.col("use_line").cast("long").alias("use_line"))


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber, max(l_returnflag) AS flag, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY l_linenumber) + 2 AS line FROM l)
SELECT 'o' || o || '.py' AS path, 'f' || o AS function, says, confidence::DOUBLE AS confidence, line, variables, used FROM (
  SELECT o, 'filename.basename_only == true' AS says, 0.82 AS confidence, min(line) AS line, ['v1'] AS variables, true AS used FROM n WHERE flag = 'R' GROUP BY o
  UNION ALL SELECT o, 'identifier.server_generated == true', 0.9, min(line), ['filename'], true FROM n WHERE flag = 'A' GROUP BY o
  UNION ALL SELECT o, 'filename.server_generated == true', 0.84, min(line), ['filename'], true FROM n WHERE flag = 'A' GROUP BY o
  UNION ALL SELECT o, 'filename.user_controlled == false', 0.8, min(line), ['filename'], true FROM n WHERE flag = 'A' GROUP BY o
  UNION ALL SELECT o, 'route.requires_login == true', 0.95, 2, []::VARCHAR[], NULL FROM n GROUP BY o HAVING max(s) = 'O')""")
def q_code_guarantees(spark, d):
    """What the functions of source text guarantee, one file for each order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    text = F.when(F.col("flag") == "R", "    v1 = os.path.basename(v0)").when(F.col("flag") == "A", "    filename = uuid4()").otherwise("    v2 = g(v0)")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("text")))), lambda x: x["text"])  # the lines of one order
    files = lines.groupBy("l_orderkey").agg(rows.alias("rows"), F.max("status").alias("status"))
    key = F.col("l_orderkey").cast("string")
    source = F.concat(F.when(F.col("status") == "O", "@auth.login_required\ndef f").otherwise("\ndef f"), key, F.lit("(v0):\n"), F.array_join("rows", "\n"), F.lit("\n"))
    return H.guarantees(C.code_flow(files.select(F.concat(F.lit("o"), key, F.lit(".py")).alias("path"), source.alias("source"))))


ROUND = "SELECT DISTINCT s_suppkey AS src, (s_suppkey * s_suppkey + 1) % (SELECT max(s_suppkey) + 1 FROM supplier) AS dst FROM supplier"


@query(f"""WITH RECURSIVE e AS ({ROUND}), p AS (SELECT src AS start, dst AS node, [src] AS path FROM e UNION ALL SELECT start, dst, list_append(path, node) FROM p JOIN e ON src = node WHERE node > start AND NOT list_contains(path, node))
SELECT array_to_string(path, ',') AS cycle FROM p WHERE node = start""")
def q_simple_cycles(spark, d):
    """Cycles of any length over an edge of every supplier."""
    keys = table(spark, d, "supplier").select("s_suppkey")
    e = keys.crossJoin(keys.agg((F.max("s_suppkey") + 1).alias("n"))).selectExpr("s_suppkey AS src", "(s_suppkey * s_suppkey + 1) % n AS dst")  # a single row
    return G.simple_cycles(e).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query(r"""WITH t AS (SELECT doc_id // 10 AS conversation, doc_id AS turn, CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN source ELSE CASE WHEN lang = 'en' THEN 'system' ELSE 'user' END END AS role, text FROM documents),
b AS (SELECT *, lag(role) OVER (PARTITION BY conversation ORDER BY turn) AS before, count(*) OVER (PARTITION BY conversation ORDER BY turn) AS n FROM t)
SELECT conversation, turn, issue FROM (SELECT conversation, turn, unnest([CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty_content' END, CASE WHEN length(text) > 10000 THEN 'long_content' END, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown_role' END,
  CASE WHEN role = 'system' AND before IS NOT NULL THEN 'late_system' END, CASE WHEN before IS NOT DISTINCT FROM role THEN 'repeated_role' END, CASE WHEN regexp_matches(text, '(?i)(password|secret|token|api_?key)[\t\n\x0b\f\r ]*[:=]') THEN 'secret' END]) AS issue FROM b) WHERE issue IS NOT NULL""")
def q_document_turns(spark, d):
    """Documents as the turns of conversations of ten, and the rules that they break."""
    docs = table(spark, d, "documents")
    role = F.when(F.expr("doc_id % 4 = 0"), "user").when(F.expr("doc_id % 4 = 1"), "assistant").when(F.expr("doc_id % 4 = 2"), F.col("source")).when(F.col("lang") == "en", "system").otherwise("user")
    return X.turn_issues(docs.select(F.expr("doc_id div 10").alias("conversation"), F.col("doc_id").alias("turn"), role.alias("role"), "text"), "conversation", "turn", "role", "text")


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag <> 'N' AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)""")
def q_new_cases(spark, d):
    """Parts and suppliers of open lines that no closed line has."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return lines.filter("l_returnflag = 'N'").join(lines.filter("l_returnflag <> 'N'"), ["l_partkey", "l_suppkey"], "left_anti").select("l_partkey", "l_suppkey").distinct()
