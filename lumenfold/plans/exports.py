"""Queries of the exports, of predicates in a closed subset and of a few checks, on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import predicates
from lumenfold.functions import scores as S
from lumenfold.operators import cases as K
from lumenfold.operators import exports as X
from lumenfold.operators import graphs as G
from lumenfold.plans.audit import JUDGED, SIGNALS, judged, pick, pick_sql, signals
from lumenfold.plans.catalog import query
from lumenfold.sources import advisories
from lumenfold.sources.tables import table


@query(f"""SELECT file, line, id AS rule_id, json_object('name', title, 'desc', CASE WHEN l_linenumber = 1 THEN title ELSE state END, 'severity', CASE WHEN severity = '' THEN 'info' ELSE severity END, 'type', 'Vulnerability', 'tool', 'scan', 'refs', CASE WHEN cwe = '' THEN []::VARCHAR[] ELSE [cwe] END,
  'data', json_object('rule_id', id, 'file', file, 'line', line, 'evidence', guard))::VARCHAR AS entry FROM (SELECT * REPLACE (CASE WHEN state = '' THEN title ELSE state END AS state) FROM ({SIGNALS}))""")
def q_export_vulnerabilities(spark, d):
    f = signals(spark, d).withColumns({"message": F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("state")), "rule_id": F.col("id"), "evidence": F.col("guard"), "source": F.lit("scan")})
    return X.vulnerabilities(f)


@query(f"""SELECT '/p/' || l_partkey AS path, CASE WHEN l_linenumber = 1 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN l_suppkey % 3 = 0 THEN 'user' ELSE 'admin' END AS role,
  json_object('method', CASE WHEN l_linenumber = 1 THEN 'GET' ELSE 'POST' END, 'path', '/p/' || l_partkey, 'role', CASE WHEN l_suppkey % 3 = 0 THEN 'user' ELSE 'admin' END, 'expected_allowed', NOT missing, 'detected_guards', [guard], 'missing_guards', CASE WHEN missing THEN ['owner'] ELSE []::VARCHAR[] END, 'mutation', l_linenumber <> 1)::VARCHAR AS entry FROM ({SIGNALS})""")
def q_export_access_requests(spark, d):
    s = signals(spark, d)
    seen = s.select(F.when(F.col("l_linenumber") != 1, "POST").alias("method"), F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.expr("l_suppkey % 3 <> 0"), "admin").otherwise("").alias("role"), F.array("guard").alias("guards"), F.when(F.col("missing"), F.array(F.lit("owner"))).otherwise(F.array().cast("array<string>")).alias("missing"), (F.col("l_linenumber") != 1).alias("mutation"))
    return X.access_requests(seen)


@query("SELECT DISTINCT word FROM (SELECT lower(p_brand) AS word FROM part UNION ALL SELECT unnest([" + ", ".join(f"'{w}'" for w in X.PARAMETERS) + "]))")
def q_export_parameter_words(spark, d):
    return X.parameter_words(table(spark, d, "part").select(F.lower("p_brand").alias("w")), "w")


@query(f"SELECT id AS case_id, '## ' || case_type || chr(10) || '- Status: ' || status || chr(10) || '- Priority: ' || priority || chr(10) || '- Place: `' || file || ':' || line || '`' AS lines FROM ({JUDGED})")
def q_export_markdown(spark, d):
    return X.case_lines(judged(spark, d).withColumnRenamed("id", "case_id"))


@query(f"""SELECT category, file, line AS at, id AS case_id, json_object('ruleId', category, 'ruleIndex', dense_rank() OVER (ORDER BY category) - 1, 'level', CASE priority WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END,
  'message', json_object('text', category || ': ' || file), 'locations', [json_object('physicalLocation', json_object('artifactLocation', json_object('uri', file), 'region', json_object('startLine', greatest(line, 1))))])::VARCHAR AS result FROM ({JUDGED})""")
def q_export_sarif_results(spark, d):
    return K.sarif_results(judged(spark, d).withColumnRenamed("id", "case_id"))


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN 'x <= 1' WHEN 1 THEN 'a != 1 or not b.c' WHEN 2 THEN 'k in s and v != 2' WHEN 3 THEN 'a' WHEN 5 THEN 'a >= b or b >= c' WHEN 7 THEN 'not rows[0].ok' WHEN 8 THEN '(a or b) and not c' END AS negated,
  CASE p_partkey % 10 WHEN 0 THEN 'x > 1' WHEN 1 THEN 'a == 1 and b.c' WHEN 2 THEN 'k not in s or v == 2' WHEN 3 THEN 'not a' WHEN 5 THEN 'a < b and b < c' WHEN 7 THEN 'rows[0].ok' WHEN 8 THEN 'not a and not b or c' END AS plain FROM part""")
def q_negated_predicates(spark, d):
    texts = ("x>1", "a == 1 and b.c", "k not in s or v == 2", "not a", "f(x) > 1", "a < b < c", "x is None", "rows[0].ok", "not (a or b) or c", "a ==")
    p = table(spark, d, "part").select("p_partkey", pick(texts, "p_partkey % 10").alias("t"))
    return p.select("p_partkey", predicates.negated(F.col("t")).alias("negated"), predicates.plain(F.col("t")).alias("plain"))


@query("SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING min(l_linestatus) <> max(l_linestatus)")
def q_boolean_constraints(spark, d):
    """Sets of signed atoms that can't all hold: an atom with both signs."""
    s = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_linestatus") == "O").alias("sign"))
    return G.contradictions(s, "l_partkey", "l_suppkey", "sign")


WORDS = ("Critical", " high", "medium", "LOW", "info", "unknown", "0.4", "7", "-1", "none")


@query(f"SELECT p_partkey, (CASE p_partkey % 10 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 WHEN 3 THEN 0.35 WHEN 4 THEN 0.2 WHEN 6 THEN 0.4 WHEN 7 THEN 1 WHEN 8 THEN 0 ELSE 0.5 END)::DOUBLE AS confidence FROM (SELECT p_partkey, {pick_sql(WORDS, 'p_partkey % 10')} AS w FROM part)")
def q_safe_float(spark, d):
    return table(spark, d, "part").select("p_partkey", S.safe_float(pick(WORDS, "p_partkey % 10")).alias("confidence"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https://[^/]+(/|$)') AND NOT regexp_matches(rtrim(url, '/'), '^https://[^/]+/fr(/|$)')")
def q_in_scope(spark, d):
    """Pages under a host of https, but for those under its /fr."""
    p = table(spark, d, "pages").select("page_id", "url")
    hosts = p.select(F.regexp_extract("url", "^https://[^/]+", 0).alias("h")).filter("h <> ''").distinct()
    patterns = hosts.select(F.col("h").alias("pattern"), F.lit(True).alias("included")).union(hosts.select(F.concat("h", F.lit("/fr/")), F.lit(False)))
    return advisories.in_scope(p, "url", patterns).select("page_id")


@query("""WITH p AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 5 AS "first", 2 AS n, CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 6 END AS total, o_orderdate AS fetched FROM orders),
x AS (SELECT *, lag("first" + n) OVER w AS e, lag(total) OVER w AS t, lag(fetched) OVER w AS b FROM p WINDOW w AS (PARTITION BY run ORDER BY page))
SELECT run, page, fault FROM (SELECT run, page, unnest([CASE WHEN coalesce(e, 0) <> "first" THEN 'gap' END, CASE WHEN t <> total THEN 'total_changed' END, CASE WHEN fetched < b THEN 'time_went_back' END, CASE WHEN "first" + n > total THEN 'beyond_total' END]) AS fault FROM x) WHERE fault IS NOT NULL""")
def q_page_chain(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    pages = o.select(F.col("o_custkey").alias("run"), page.alias("page"), F.expr("o_orderkey % 5").alias("first"), F.lit(2).alias("n"), F.expr("case when o_orderkey % 9 = 0 then 5 else 6 end").alias("total"), F.col("o_orderdate").alias("fetched_at"))
    return advisories.chain_faults(pages, "run")


@query("""SELECT name, version, advisory, spec FROM (SELECT 'p' || (p_partkey % 30) AS name, (p_size % 9) || '.' || (p_partkey % 4) AS version, p_size % 9 AS major FROM part) p JOIN (SELECT 'p' || s_suppkey % 30 AS package, 'A' || s_suppkey AS advisory, '<' || (s_suppkey % 9) || '.0' AS spec, s_suppkey % 9 AS bound FROM supplier) a ON name = package AND major < bound GROUP BY ALL""")
def q_vulnerable_pins(spark, d):
    pins = table(spark, d, "part").select(F.expr("concat('p', p_partkey % 30)").alias("name"), F.expr("concat(p_size % 9, '.', p_partkey % 4)").alias("version"))
    ranges = table(spark, d, "supplier").select(F.expr("concat('p', s_suppkey % 30)").alias("package"), F.expr("concat('A', s_suppkey)").alias("advisory"), F.lit(0).alias("place"), F.expr("concat('<', s_suppkey % 9, '.0')").alias("spec"))
    return advisories.vulnerable(pins, ranges)
