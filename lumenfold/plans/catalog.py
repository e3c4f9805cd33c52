"""All queries over the driver tables by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import scores as S
from lumenfold.functions import texts as X
from lumenfold.operators import graphs as G
from lumenfold.operators import metrics as M
from lumenfold.operators import relational as R
from lumenfold.sources.tables import table

FLAGSHIP = "q_cluster"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = r"[\x20\x09-\x0D]+"


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL for it."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def plain(c: str):
    return F.lower(F.trim(F.regexp_replace(c, WS, " ")))


@query(r"""SELECT sha256(lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')))) AS key, min(doc_id) AS representative, count(*) AS members,
  string_agg(DISTINCT source, ',' ORDER BY source) AS labels FROM documents GROUP BY 1""")
def q_cluster(spark, d):
    return R.clusters(table(spark, d, "documents"), F.sha2(plain("text"), 256), "doc_id", "source")


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text), lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def q_first_wins_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return R.first_by(docs, ["h", "lang"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1""")
def q_best_per_group(spark, d):
    return R.first_wins(table(spark, d, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"]).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 WHEN '5' THEN 4 ELSE 5 END, o_totalprice DESC, o_orderkey LIMIT 50""")
def q_priority_sort_topk(spark, d):
    rank = S.lookup(F.substring("o_orderpriority", 1, 1), {str(i + 1): i for i in range(5)}, 5)
    return table(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT l_partkey, CAST(floor(l_quantity / 10) AS BIGINT) AS bucket, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS best_rank, max(l_discount) AS max_discount,
  min(l_linenumber) AS first_line, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS suppliers FROM lineitem GROUP BY 1, 2""")
def q_correlation_merge(spark, d):
    keys = [F.col("l_partkey"), F.floor(F.col("l_quantity") / 10).alias("bucket")]
    best = {"best_rank": F.min(S.lookup(F.col("l_returnflag"), {"R": 0, "A": 1}, 2)), "max_discount": F.max("l_discount"), "first_line": F.min("l_linenumber")}
    return R.merged(table(spark, d, "lineitem"), keys, best, {"suppliers": F.col("l_suppkey")})


def predicted(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") < 1000).alias("predicted"))
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("truth", F.col("quality") == 0)


P = "SELECT l.doc_id, lang, n_chars < 1000 AS predicted, quality = 0 AS truth FROM labels l JOIN documents d USING (doc_id)"


@query(f"SELECT truth AS expected, predicted AS observed, count(*) AS n FROM ({P}) GROUP BY ALL")
def q_confusion(spark, d):
    return M.confusion(predicted(spark, d), "truth", "predicted")


@query(f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM (
  SELECT lang, count_if(truth AND predicted)::BIGINT AS tp, count_if(NOT truth AND predicted)::BIGINT AS fp, count_if(truth AND NOT predicted)::BIGINT AS fn FROM ({P}) GROUP BY ROLLUP (lang)))""")
def q_precision_recall(spark, d):
    return M.precision_recall(predicted(spark, d), F.col("truth"), F.col("predicted"), ["lang"])


@query(f"""SELECT lang, successes, total, greatest(0, (p + z * z / (2 * total) - z * sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)) AS low,
  least(1, (p + z * z / (2 * total) + z * sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)) AS high
  FROM (SELECT lang, count_if(truth)::BIGINT AS successes, count(*)::DOUBLE AS t, count(*) AS total, count_if(truth) / count(*) AS p, 1.959963984540054::DOUBLE AS z FROM ({P}) GROUP BY lang)""")
def q_wilson(spark, d):
    return M.intervals(predicted(spark, d), ["lang"], F.col("truth"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'introduced' WHEN o_orderkey % 3 = 1 THEN 'resolved' ELSE 'residual' END AS state FROM orders""")
def q_full_outer_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return R.outer_diff(o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 3 <> 1"), ["o_orderkey"])


@query("""SELECT c_custkey, decision, coalesce(n_events, 0) AS n_events, coalesce(verdicts, '') AS verdicts FROM customer LEFT JOIN (
  SELECT user_id, count(*) AS n_events, string_agg(event_type, ',' ORDER BY ts, event_id) AS verdicts,
    CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'signup') THEN 'signup' END AS decision
  FROM events GROUP BY user_id) ON user_id = c_custkey""")
def q_feedback(spark, d):
    f = R.by_precedence(table(spark, d, "events"), "user_id", "event_type", ["error", "purchase", "signup"], ["ts", "event_id"])
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(f, c["c_custkey"] == f["user_id"], "left").select("c_custkey", "decision", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("verdicts", F.lit("")).alias("verdicts"))


@query("""SELECT event_type, hour(ts)::INTEGER AS at_hour, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (hour(ts)), ())""")
def q_grouping_sets(spark, d):
    e = table(spark, d, "events").select("event_type", F.hour("ts").alias("at_hour"))
    return e.groupingSets([[F.col("event_type")], [F.col("at_hour")], []], "event_type", "at_hour").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, max_by(value, event_id) FILTER (event_type = 'click') AS click, max_by(value, event_id) FILTER (event_type = 'purchase') AS purchase, max_by(value, event_id) FILTER (event_type = 'view') AS "view" FROM events GROUP BY user_id""")
def q_pivot_matrix(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max_by("value", "event_id"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'click'), t AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT event_id, nearest_id FROM (SELECT p.event_id, t.event_id AS nearest_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(t.ts)), t.ts, t.event_id) AS n
  FROM p LEFT JOIN t ON p.user_id = t.user_id) WHERE n = 1""")
def q_nearest_join(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    return R.nearest(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'purchase'"), "user_id", "at", "event_id").select("event_id", "nearest_id")


@query("""SELECT p.p_partkey, s.s_suppkey FROM part p JOIN (SELECT s_suppkey, s_nationkey, s_suppkey % 40 AS lo, s_suppkey % 40 + 5 AS hi FROM supplier) s
  ON p.p_partkey % 25 = s.s_nationkey AND p.p_size BETWEEN s.lo AND s.hi""")
def q_range_join(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 25).alias("g"), F.col("p_size").alias("at"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("g"), (F.col("s_suppkey") % 40).alias("lo"), (F.col("s_suppkey") % 40 + 5).alias("hi"))
    return R.in_spans(p, s, "g", "at", "lo", "hi", 10).select("p_partkey", "s_suppkey")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND abs(length(x.name) - length(y.name)) < 2 WHERE levenshtein(x.name, y.name) = 1""")
def q_typosquat(spark, d):
    return R.near_names(table(spark, d, "part"), "p_name")


LINES = "".join(f" UNION ALL SELECT page_id, '{n}' AS pattern, list_position(list_transform(string_split(html, chr(10)), lambda x: regexp_matches(x, '{p}')), true) AS line FROM pages" for n, p in X.LINE_PATTERNS.items())[11:]


@query(f"SELECT page_id, pattern, line::BIGINT AS line FROM ({LINES}) WHERE line > 0")
def q_first_pattern(spark, d):
    return X.first_lines(table(spark, d, "pages"), "page_id", "html")


@query("""SELECT page_id, length(html) < 512 OR regexp_matches(html, '(?i)page not found|not found|404|does not exist|no longer available') AS missing FROM pages""")
def q_soft_missing(spark, d):
    return table(spark, d, "pages").select("page_id", X.soft_missing(F.lit(200), F.col("html")).alias("missing"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '(bearer)\s+[A-Za-z0-9._~+/=-]+', '\1 [REDACTED]', 'gi'), '(password|passwd|secret|token|api_?key)(\s*[:=]\s*)[^\s,;]+', '\1\2[REDACTED]', 'gi'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g') AS clean FROM conversations""")
def q_redact(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.redacted(F.col("text")).alias("clean"))


TOK = rf"list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9_]+)', 1), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in S.STOP_WORDS)}))"


@query(f"""WITH w AS (SELECT item_id, unnest({TOK}) AS w FROM benchmark), c AS (SELECT item_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 1024 AS dim, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT item_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS weight FROM c),
p AS (SELECT x.item_id AS a, y.item_id AS b, round(sum(x.weight * y.weight), 6) AS score FROM v x JOIN v y USING (dim) WHERE x.item_id <> y.item_id GROUP BY ALL HAVING round(sum(x.weight * y.weight), 6) >= 0.05)
SELECT a, b, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM p) WHERE rank <= 3""")
def q_hash_vector_topk(spark, d):
    return X.most_similar(X.hashed(table(spark, d, "benchmark"), "item_id", "text"), "item_id", 3, 0.05)


@query(f"""WITH t AS (SELECT item_id, list_distinct({TOK}) AS w FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS score FROM t x JOIN t y ON x.item_id < y.item_id WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.1""")
def q_jaccard_pairs(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(S.tokens(F.col("text"))).alias("w"))
    e = t.select("item_id", F.explode("w").alias("k"), F.size("w").alias("n"))
    x, y = e.toDF("a", "k", "na"), e.toDF("b", "k", "nb")
    both = x.join(y, "k").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    return both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("score")).filter("score >= 0.1")


EDGES = "SELECT s_suppkey AS src, s_suppkey * 7 % (SELECT max(s_suppkey) + 1 FROM supplier) AS dst FROM supplier"


def edges(spark, d):
    return all_edges(spark, d)


def all_edges(spark, d):
    """An edge of every supplier, to any of them."""
    keys = table(spark, d, "supplier").select("s_suppkey")
    return keys.crossJoin(keys.agg((F.max("s_suppkey") + 1).alias("n"))).selectExpr("s_suppkey AS src", "s_suppkey * 7 % n AS dst")


@query(f"""WITH RECURSIVE e AS ({EDGES}), r AS (SELECT 1::BIGINT AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r WHERE node <> 1""")
def q_reach(spark, d):
    return G.impact(edges(spark, d), spark.createDataFrame([(1,)], "node long"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), r AS (SELECT s_suppkey AS node, 0 AS depth FROM supplier WHERE s_suppkey <= 5 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2000)
SELECT s_suppkey AS node, coalesce(depth, -1)::INTEGER AS depth FROM supplier LEFT JOIN (SELECT node, min(depth) AS depth FROM r GROUP BY node) ON node = s_suppkey""")
def q_depth(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return nodes.join(G.depths(edges(spark, d), nodes.filter("node <= 5")), "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depth"))


@query(f"""WITH RECURSIVE e AS ({EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT s_suppkey AS node FROM supplier UNION SELECT dst FROM e), r AS (SELECT node, node AS root FROM n UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def q_components(spark, d):
    e = edges(spark, d)
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node")).union(e.select("dst")).distinct()
    return G.clusters(nodes, e)


@query(f"WITH e AS ({EDGES}) SELECT DISTINCT x.src AS a, x.dst AS via, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND x.src <> x.dst AND x.dst <> y.dst")
def q_two_hop(spark, d):
    return G.two_hops(edges(spark, d))


@query("""WITH e AS (SELECT DISTINCT s_suppkey % 13 AS src, s_suppkey * 5 % 13 AS dst FROM supplier)
SELECT src::VARCHAR AS cycle FROM e WHERE src = dst UNION ALL SELECT x.src || ',' || x.dst FROM e x JOIN e y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst
UNION ALL SELECT x.src || ',' || x.dst || ',' || y.dst FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst""")
def q_cycles(spark, d):
    e = table(spark, d, "supplier").selectExpr("s_suppkey % 13 AS src", "s_suppkey * 5 % 13 AS dst")
    return G.short_cycles(e).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("cycle"))


@query(None)
def q_propagation(spark, d):
    nodes = table(spark, d, "supplier").selectExpr("s_suppkey AS node", "0.05 + 0.9 * (s_suppkey % 17) / 17 AS confidence")
    e = all_edges(spark, d).selectExpr("src", "dst", "CASE src % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'CONTRADICTS' ELSE 'OTHER' END AS relation", "CAST(src % 2 AS DOUBLE) AS weight")
    return G.propagate(nodes, e)


@query("""SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING bool_or(value > 50) AND bool_or(value <= 50)""")
def q_boolean_contradiction(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("value") > 50).alias("sign"))
    return G.contradictions(e.filter("sign is not null"), "user_id", "event_type", "sign")


@query("""WITH r AS (SELECT count(DISTINCT event_type) AS runs FROM events), s AS (SELECT user_id, count(DISTINCT event_type) AS seen FROM events GROUP BY user_id) SELECT user_id, seen, seen = runs AS in_all, 2 * seen > runs AS in_majority FROM s, r""")
def q_majority_stability(spark, d):
    return M.stability(table(spark, d, "events"), "user_id", "event_type")


@query("""SELECT doc_id, score::INTEGER AS score, CASE WHEN score >= 80 THEN 'reportable_candidate' WHEN score >= 50 THEN 'needs_manual_validation' WHEN score >= 20 THEN 'weak_signal' ELSE 'likely_false_positive' END AS verdict FROM (
  SELECT doc_id, greatest(0, least(79, (CASE WHEN lang = 'en' THEN 25 ELSE 0 END) + (CASE WHEN n_chars > 1000 THEN 20 ELSE 0 END) + (CASE WHEN contains(text, '@') THEN 25 ELSE 0 END) + (CASE WHEN contains(text, 'token') THEN 15 ELSE 0 END) - (CASE WHEN contains(text, '###') THEN 40 ELSE 0 END) - (CASE WHEN n_chars < 100 THEN 10 ELSE 0 END))) AS score FROM documents)""")
def q_score_cascade(spark, d):
    text, n = F.col("text"), F.col("n_chars")
    score = S.additive([(F.col("lang") == "en", 25), (n > 1000, 20), (text.contains("@"), 25), (text.contains("token"), 15), (text.contains("###"), -40), (n < 100, -10)], 0, 79)
    cuts = ((80, "reportable_candidate"), (50, "needs_manual_validation"), (20, "weak_signal"))
    return table(spark, d, "documents").select("doc_id", score.alias("score")).withColumn("verdict", S.cut(F.col("score"), cuts, "likely_false_positive"))


TURN = """SELECT conv_id, turn, unnest([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_content' END, CASE WHEN length(text) > 10000 THEN 'long_content' END, CASE WHEN role NOT IN ('system', 'user', 'assistant') THEN 'unknown_role' END,
  CASE WHEN role = 'system' AND before IS NOT NULL THEN 'late_system' END, CASE WHEN before IS NOT DISTINCT FROM role THEN 'repeated_role' END, CASE WHEN regexp_matches(text, '(?i)(password|secret|token|api_?key)\\s*[:=]') THEN 'secret' END]) AS issue
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"""


@query(f"SELECT * FROM ({TURN}) WHERE issue IS NOT NULL")
def q_turn_issues(spark, d):
    return X.turn_issues(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(f"SELECT c.conv_id, greatest(0, 100 - 10 * count(issue))::BIGINT AS score FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM ({TURN}) WHERE issue IS NOT NULL) i ON c.conv_id = i.conv_id GROUP BY 1")
def q_dataset_score(spark, d):
    turns = table(spark, d, "conversations")
    n = X.turn_issues(turns, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return turns.select("conv_id").distinct().join(n, "conv_id", "left").select("conv_id", F.greatest(F.lit(0), 100 - 10 * F.coalesce("n", F.lit(0))).alias("score"))


@query("""SELECT column0 AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) v(column0) LEFT JOIN events ON event_type = column0 GROUP BY 1""")
def q_status_counts(spark, d):
    return R.zero_filled(table(spark, d, "events"), "event_type", ["click", "error", "purchase", "signup", "view", "refund"])


@query("""SELECT event_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM events GROUP BY 1""")
def q_health(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = e.agg(F.sum("n").alias("t"))
    return e.join(F.broadcast(total)).select("event_type", "n", (F.col("n") * 100.0 / F.col("t")).alias("percent"))


@query("""SELECT event_type, min(value) AS low, avg(value) AS mean, max(value) AS high, max(value) - min(value) AS span FROM events GROUP BY 1""")
def q_distribution(spark, d):
    return M.distribution(table(spark, d, "events"), ["event_type"], "value")


@query("""WITH c AS (SELECT user_id, event_id, least(0.95, value / 100) AS c, event_type <> 'error' AS s FROM events), v AS (SELECT user_id, 1 - exp(sum(CASE WHEN s THEN ln(greatest(1 - c, 1e-12)) ELSE 0 END)) AS score, count_if(NOT s)::BIGINT AS refuting FROM c GROUP BY 1)
SELECT user_id, round(score, 9) AS score, refuting, CASE WHEN score >= 0.7 THEN 'confirmed' WHEN score <= 0.2 AND refuting >= 2 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM v""")
def q_noisy_or(spark, d):
    e = table(spark, d, "events").select("user_id", F.least(F.lit(0.95), F.col("value") / 100).alias("c"), (F.col("event_type") != "error").alias("s"))
    return M.verdicts(e, "user_id", "c", "s").withColumn("score", F.round("score", 9))


@query("""SELECT event_type, 1 + sum(r)::DOUBLE AS alpha, 1 + sum(1 - r)::DOUBLE AS beta, (1 + sum(r)) / (2 + count(*)) AS mean FROM (SELECT event_type, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM events) GROUP BY 1""")
def q_beta_posterior(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("r"))
    return M.posteriors(e, "event_type", "r")


@query("""SELECT user_id, count(*) AS seen, min(ts) AS first_at, max(ts) AS last_at, bool_or(event_type = 'purchase') AS validated FROM events GROUP BY 1""")
def q_memory_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("validated"), "event_id")
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    state = old.groupBy("user_id").agg(F.count(F.lit(1)).alias("seen"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("validated").alias("validated"))
    return R.upsert(state, new, "user_id")


@query("""SELECT user_id, min_by(src, (src, event_id)) AS source, min_by(event_id, (src, event_id)) AS event_id FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS src FROM events) GROUP BY user_id""")
def q_union_first_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    parts = [e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'"), e.filter("event_type not in ('purchase', 'signup')")]
    parts = [p.select("user_id", "event_id", F.lit(i).alias("source")) for i, p in enumerate(parts)]
    return R.union_first_wins(parts, ["user_id"], ["event_id"])


@query("""SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 400""")
def q_eviction(spark, d):
    return R.evicted(table(spark, d, "events").select("event_id", "value"), 500, 0.8, [F.desc("value"), F.col("event_id")])


@query("""SELECT c_custkey, CASE WHEN b >= 0.9 THEN 'critical' WHEN b >= 0.8 THEN 'high' WHEN b >= 0.6 THEN 'medium' WHEN b >= 0.3 THEN 'low' ELSE 'info' END AS severity FROM (SELECT c_custkey, c_acctbal / 10000 AS b FROM customer)""")
def q_severity_cut(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.cut(F.col("c_acctbal") / 10000, S.SEVERITY_CUTS, "info").alias("severity"))


@query("""SELECT s_suppkey, (1 - r) * 0.4::DOUBLE + e * 0.3::DOUBLE + (1 - c) * 0.3::DOUBLE AS fragility FROM (SELECT s_suppkey, CASE s_nationkey % 6 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.2 ELSE 0.1 END AS r, CASE s_suppkey % 3 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 0.7 ELSE 0.9 END AS e, (s_suppkey % 10) / 10::DOUBLE AS c FROM supplier)""")
def q_fragility(spark, d):
    r = S.lookup(F.concat(F.lit("C"), (F.col("s_nationkey") % 6 + 1).cast("string")), S.ROBUSTNESS, 0.1)
    e = S.lookup(F.when(F.col("s_suppkey") % 3 == 0, "held").when(F.col("s_suppkey") % 3 == 1, "hoped").otherwise("unknown"), {"held": 0.3, "hoped": 0.7}, 0.9)
    return table(spark, d, "supplier").select("s_suppkey", S.fragility(r, e, F.col("s_suppkey") % 10 / 10.0).alias("fragility"))


@query("""SELECT s_suppkey, round(ln(q / (1 - q)), 9) AS logit, round(1 / (1 + exp(-ln(q / (1 - q)) - ln(3.0))), 9) AS raised, greatest(0.01, p * 0.95::DOUBLE) AS decayed FROM (SELECT s_suppkey, p, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM (SELECT s_suppkey, (s_suppkey % 9 + 1) / 10::DOUBLE AS p FROM supplier))""")
def q_bayes(spark, d):
    p = (F.col("s_suppkey") % 9 + 1) / 10.0
    return table(spark, d, "supplier").select("s_suppkey", F.round(S.logit(p), 9).alias("logit"), F.round(S.bayes_update(p, F.lit(True)), 9).alias("raised"), S.decay(p).alias("decayed"))


@query(r"""SELECT substr(sha256(lower(trim(regexp_replace(p_name, '[\x20\x09-\x0D]+', ' ', 'g'))) || chr(31) || lower(trim(regexp_replace(p_brand, '[\x20\x09-\x0D]+', ' ', 'g')))), 1, 16) AS key, p_partkey FROM part""")
def q_cluster_key(spark, d):
    return table(spark, d, "part").select(S.key_of(F.col("p_name"), F.col("p_brand")).alias("key"), "p_partkey")


@query(f"SELECT item_id, len({TOK})::BIGINT AS n_tokens, len(list_distinct({TOK}))::BIGINT AS n_distinct FROM benchmark")
def q_tokenise(spark, d):
    t = S.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def q_identity_difference(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_custkey").subtract(o.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def q_new_case_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)""")
def q_feedback_semi(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi")


@query("""SELECT n_name, r_name, count(*) AS suppliers, median(s_acctbal) AS middle FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def q_dimension_join(spark, d):
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.median("s_acctbal").alias("middle"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY""")
def q_drift_window(spark, d):
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    return o.join(F.broadcast(last)).filter("o_orderdate >= last - INTERVAL 90 DAY").select("o_orderkey", "o_custkey")


@query("""SELECT user_id, event_type FROM (SELECT user_id, event_type, count(DISTINCT hour(ts)) AS n FROM events GROUP BY 1, 2) WHERE n >= 3""")
def q_self_consistency(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.countDistinct(F.hour("ts")).alias("n"))
    return n.filter("n >= 3").select("user_id", "event_type")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, hour(ts)) >= 2 AND value >= 70 AS critical FROM events""")
def q_corroboration(spark, d):
    e = table(spark, d, "events").withColumn("h", F.hour("ts"))
    n = e.groupBy("user_id", "h").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, ["user_id", "h"]).select("event_id", "user_id", ((F.col("n") >= 2) & (F.col("value") >= 70)).alias("critical"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN (json_extract_string(props, '$.k')::BIGINT) >= 50 THEN 'high' ELSE 'low' END AS band FROM events""")
def q_json_project(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), S.first_match([(k >= 50, "high")], "low").alias("band"))


@query("""SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events) WHERE s = 1 GROUP BY 1""")
def q_sessions(spark, d):
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("first", before.isNull() | (F.col("ts") - before > F.expr("INTERVAL 30 MINUTE")))
    return e.filter("first").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT x.s_suppkey AS a, y.s_suppkey AS b, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0.2 THEN 'low' ELSE 'info' END AS severity FROM (
  SELECT x.*, y.*, greatest(x.f, y.f) * 0.5::DOUBLE + (1 - least(x.r, y.r)) * 0.5::DOUBLE AS s FROM (SELECT s_suppkey, s_nationkey, (s_suppkey % 7) / 7::DOUBLE AS f, (s_suppkey % 5) / 5::DOUBLE AS r FROM supplier) x
  JOIN (SELECT s_suppkey, s_nationkey, (s_suppkey % 7) / 7::DOUBLE AS f, (s_suppkey % 5) / 5::DOUBLE AS r FROM supplier) y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey) t""".replace("SELECT x.s_suppkey AS a, y.s_suppkey AS b, CASE", "SELECT a, b, CASE").replace("SELECT x.*, y.*, greatest", "SELECT x.s_suppkey AS a, y.s_suppkey AS b, greatest"))
def q_conflict_severity(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 7 / 7.0).alias("f"), (F.col("s_suppkey") % 5 / 5.0).alias("r"))
    x, y = s.toDF("a", "g", "fa", "ra"), s.toDF("b", "g", "fb", "rb")
    return x.join(y, "g").filter("a < b").select("a", "b", S.conflict_severity(F.col("fa"), F.col("fb"), F.col("ra"), F.col("rb")).alias("severity"))


@query("""WITH d AS (SELECT s_nationkey, count(*) AS dependents FROM supplier GROUP BY 1) SELECT n_nationkey, least(coalesce(dependents, 0) / 10, 1.0::DOUBLE) * 0.5::DOUBLE + (1 - 0.4::DOUBLE) * 0.5::DOUBLE AS risk FROM nation LEFT JOIN d ON s_nationkey = n_nationkey ORDER BY risk DESC, n_nationkey LIMIT 10""")
def q_fragile_roots(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("dependents"))
    risk = S.structural_risk(F.coalesce("dependents", F.lit(0)), F.lit(0.4)).alias("risk")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select("n_nationkey", risk).orderBy(F.desc("risk"), "n_nationkey").limit(10)


@query("""SELECT event_type, avg(CASE WHEN value <= 40 THEN 1.0::DOUBLE ELSE 0.0 END) AS debt FROM events GROUP BY 1""")
def q_debt(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(F.col("value") <= 40, 1.0).otherwise(0.0)).alias("debt"))


@query("""SELECT event_type AS metric, avg_value, bound, avg_value >= bound AS passed FROM (SELECT event_type, avg(value) AS avg_value FROM events GROUP BY 1) JOIN (VALUES ('click', 50.0::DOUBLE), ('purchase', 49.0)) b(k, bound) ON k = event_type""")
def q_gates(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("avg_value"))
    return M.gates(m, "metric", "avg_value", {"click": 50.0, "purchase": 49.0}, {})


@query("""SELECT total, min(s) AS needed FROM (SELECT total, s, (s / total::DOUBLE + z * z / (2 * total) - z * sqrt(s / total::DOUBLE * (1 - s / total::DOUBLE) / total + z * z / (4 * total * total))) / (1 + z * z / total) AS low
  FROM (SELECT DISTINCT p_size::BIGINT AS total, 1.959963984540054::DOUBLE AS z FROM part), LATERAL (SELECT unnest(range(0, total + 1)) AS s)) WHERE low > 0.5 GROUP BY total UNION ALL
  SELECT total, NULL FROM (SELECT DISTINCT p_size::BIGINT AS total FROM part) WHERE total < 4""")
def q_least_successes(spark, d):
    return M.least_successes(table(spark, d, "part").select(F.col("p_size").cast("long").alias("total")), "total", 0.5)


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type)::INTEGER AS place, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY place <= 2""")
def q_topk_per_group(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("place <= 2")


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) <= 100 AS within FROM lineitem""")
def q_running_budget(spark, d):
    from pyspark.sql import Window

    run = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (run <= 100).alias("within"))
