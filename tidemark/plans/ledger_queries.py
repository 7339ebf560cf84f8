"""Queries over revisions, graphs, runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import graph, ledger
from tidemark.plans.inputs import AS_OF_SQL, as_of, table
from tidemark.streaming import digest

FIELDS = ["o_orderstatus", "o_orderpriority"]


def _revisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", *FIELDS)
    return ledger.numbered_revisions(orders, "o_custkey", ["o_orderdate", "o_orderkey"], FIELDS)


def f_changed_fields(spark, sf_dir):
    return _revisions(spark, sf_dir).select("o_orderkey", "revision", F.array_join("changed", ",").alias("changed"))


def f_latest_material(spark, sf_dir):
    material = _revisions(spark, sf_dir).filter((F.col("revision") > 1) & F.array_contains("changed", "o_orderstatus"))
    return material.groupBy("o_custkey").agg(F.max("revision").alias("revision"), F.count("*").alias("material"))


def f_append(spark, sf_dir):
    latest = _revisions(spark, sf_dir).groupBy("o_custkey").agg(F.max_by(F.struct("revision", *FIELDS), "revision").alias("r")).select("o_custkey", "r.*")
    incoming = latest.withColumn("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus")))
    return ledger.append_revisions(latest, incoming, "o_custkey", FIELDS)


def f_outcomes(spark, sf_dir):
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    found = F.when(key % 7 == 0, F.concat(status, F.lit("!"))).otherwise(status)
    owner = F.when(key % 11 == 0, "other").otherwise("me")
    result = ledger.outcome(found, status, owner, F.lit("me"), key % 13 == 0)
    return table(spark, sf_dir, "orders").groupBy(result.alias("outcome")).agg(F.count("*").alias("n"))


def f_claimable(spark, sf_dir):
    key = F.col("o_orderkey")
    until = F.when(key % 3 == 0, F.timestamp_add("DAY", F.lit(1), as_of())).when(key % 3 == 1, F.timestamp_add("DAY", F.lit(-1), as_of()))
    work = table(spark, sf_dir, "orders").select("o_orderkey", until.alias("leased_until"), F.lit("a").alias("content_hash"), F.when(key % 5 == 0, "b").otherwise("a").alias("leased_hash"))
    return ledger.claimable(work, as_of()).select("o_orderkey")


def a_attempts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ledger.first_usable(events, "user_id", F.col("event_type") != "error", ["ts", "event_id"])


def a_runs(spark, sf_dir):
    errors = F.count_if(F.col("event_type") == "error")
    status = F.when(F.col("errors") == F.col("n"), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), errors.alias("errors"))
    return days.select("day", status.alias("status"), F.col("errors").alias("error_count"))


def h_warming(spark, sf_dir):
    recent = table(spark, sf_dir, "events").filter((F.col("ts") >= F.timestamp_add("DAY", F.lit(-7), as_of())) & (F.col("ts") <= as_of()))
    daily = recent.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ledger.positive_growth(daily, "user_id", "day", "n")


def d_redirects(spark, sf_dir):
    key = F.col("p_partkey")
    redirects = table(spark, sf_dir, "part").filter(key % 10 == 0).select(key.alias("src"), F.expr("p_partkey div 2").alias("dst"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_discount").alias("confidence"))
    return graph.redirected_edges(edges, redirects)


def h_levels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    halves = part.filter("p_partkey >= 2").select(F.expr("p_partkey div 2").alias("src"), F.col("p_partkey").alias("dst"))
    thirds = part.filter("p_partkey % 3 = 0").select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst"))
    return graph.levels(halves.unionByName(thirds))


def h_slug_levels(spark, sf_dir):
    """Levels of slugs, some of them on cycles, ranked by first appearance."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    edge = lambda a, b, place: part.select(F.concat(F.lit("n-"), F.expr(a)).alias("src"), F.concat(F.lit("n-"), F.expr(b)).alias("dst"), F.expr(place).alias("position"), "p_partkey")
    halves = edge("p_partkey div 2", "p_partkey", "(p_partkey * 7919L) % 1000003").filter("p_partkey >= 2")
    thirds = edge("p_partkey div 3", "p_partkey", "1000003 + p_partkey").filter("p_partkey % 3 = 0")
    back = edge("p_partkey", "p_partkey div 8", "3000000 + p_partkey").filter("p_partkey % 250 = 0")
    return graph.levels(halves.unionByName(thirds).unionByName(back))


def g_overflow(spark, sf_dir):
    cell = Window.partitionBy("p_brand", "p_type")
    rank = F.row_number().over(cell.orderBy("p_partkey"))
    ranked = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", rank.alias("rank"), F.count("*").over(cell).alias("n"))
    shown = F.when(F.col("n") <= 3, F.col("n")).otherwise(2)
    return ranked.filter(F.col("rank") <= shown).select("p_partkey", "rank", (F.col("n") - shown).alias("hidden"))


def i_weekly(spark, sf_dir):
    return digest.run_available(spark, f"{sf_dir}/events.parquet", digest.weekly_counts)


QUERIES = {f.__name__: f for f in (f_changed_fields, f_latest_material, f_append, f_outcomes, f_claimable, a_attempts, a_runs, h_warming, d_redirects, h_levels, h_slug_levels, g_overflow, i_weekly)}

REVISIONS = """r AS (SELECT *, row_number() OVER h AS revision, lag(o_orderstatus) OVER h AS s0, lag(o_orderpriority) OVER h AS p0
  FROM orders WINDOW h AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

ORACLES = {
    "f_changed_fields": f"""WITH {REVISIONS} SELECT o_orderkey, revision, concat_ws(',', CASE WHEN revision = 1 OR o_orderstatus IS DISTINCT FROM s0 THEN 'o_orderstatus' END,
  CASE WHEN revision = 1 OR o_orderpriority IS DISTINCT FROM p0 THEN 'o_orderpriority' END) AS changed FROM r""",
    "f_latest_material": f"WITH {REVISIONS} SELECT o_custkey, max(revision) AS revision, count(*) AS material FROM r WHERE revision > 1 AND o_orderstatus IS DISTINCT FROM s0 GROUP BY 1",
    "f_append": f"""WITH {REVISIONS}, l AS (SELECT o_custkey, max(revision) AS revision, arg_max(o_orderstatus, revision) AS s FROM r GROUP BY 1)
SELECT o_custkey, revision + (o_custkey % 2 = 0 AND s <> 'F')::INT AS revision, o_custkey % 2 = 0 AND s <> 'F' AS appended FROM l""",
    "f_outcomes": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'superseded' WHEN o_orderkey % 7 = 0 THEN 'conflict' WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'updated' END AS outcome,
  count(*) AS n FROM orders GROUP BY 1""",
    "f_claimable": "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)",
    "a_attempts": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, min(i) FILTER (WHERE event_type <> 'error') AS best, count(*) AS n FROM k GROUP BY 1)
SELECT b.user_id, CASE WHEN best IS NULL THEN 'error' WHEN best = 1 THEN 'success' ELSE 'degraded' END AS status, k.event_id AS chosen, coalesce(best - 1, n) AS failures_before
FROM b LEFT JOIN k ON b.user_id = k.user_id AND b.best = k.i""",
    "a_runs": """SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN bool_and(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'error') THEN 'partial' ELSE 'success' END AS status,
  count(*) FILTER (WHERE event_type = 'error') AS error_count FROM events GROUP BY 1""",
    "h_warming": f"""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY AND ts <= {AS_OF_SQL} GROUP BY ALL),
s AS (SELECT user_id, greatest(n - coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY day), n), 0) AS step FROM d) SELECT user_id, sum(step)::BIGINT AS warming FROM s GROUP BY 1""",
    "d_redirects": """WITH RECURSIVE w(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 10 = 0 UNION SELECT w.src, w.dst // 2 FROM w WHERE w.dst % 10 = 0),
m AS (SELECT l_suppkey AS src, coalesce(w.dst, l_partkey) AS dst, l_discount FROM lineitem LEFT JOIN w ON w.src = l_partkey AND w.dst % 10 <> 0)
SELECT src, dst, max(l_discount) AS confidence, count(*) AS evidence FROM m WHERE src <> dst GROUP BY ALL""",
    "h_levels": """WITH RECURSIVE e AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey % 3 = 0),
w(node, d) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, d + 1 FROM w JOIN e ON w.node = e.src),
p AS (SELECT node, max(d) AS depth FROM w GROUP BY 1)
SELECT node, depth, row_number() OVER (PARTITION BY depth ORDER BY node) AS rank, count(*) OVER (PARTITION BY depth) AS column_size FROM p""",
    "h_slug_levels": """WITH RECURSIVE f AS (SELECT p_partkey // 2 AS s, p_partkey AS t, (p_partkey * 7919) % 1000003 AS pos FROM part WHERE p_partkey >= 2 UNION ALL SELECT p_partkey // 3, p_partkey, 1000003 + p_partkey FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT p_partkey, p_partkey // 8, 3000000 + p_partkey FROM part WHERE p_partkey % 250 = 0), e AS (SELECT DISTINCT s, t FROM f WHERE s <> t), k AS (SELECT s, t FROM e WHERE s > t),
c(start, node) AS (SELECT DISTINCT t, t FROM k UNION SELECT c.start, e.t FROM c JOIN e ON c.node = e.s), u AS (SELECT DISTINCT node FROM c WHERE start IN (SELECT k.t FROM k JOIN c c2 ON c2.start = k.t AND c2.node = k.s)),
v AS (SELECT s, t FROM e WHERE s NOT IN (FROM u) AND t NOT IN (FROM u)), n AS (SELECT node, min(pos) AS first FROM (SELECT s AS node, 2 * pos AS pos FROM f WHERE s <> t UNION ALL SELECT t, 2 * pos + 1 FROM f WHERE s <> t) GROUP BY node),
w(node, d) AS (SELECT node, 0 FROM n WHERE node NOT IN (FROM u) AND node NOT IN (SELECT t FROM v) UNION SELECT v.t, d + 1 FROM w JOIN v ON w.node = v.s), m AS (SELECT node, max(d) AS d FROM w GROUP BY node),
p AS (SELECT n.node, n.first, coalesce(m.d, (SELECT max(d) + 1 FROM m)) AS depth FROM n LEFT JOIN m ON n.node = m.node)
SELECT 'n-' || node AS node, depth, row_number() OVER (PARTITION BY depth ORDER BY first) AS rank, count(*) OVER (PARTITION BY depth) AS column_size FROM p""",
    "g_overflow": """WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part)
SELECT p_partkey, rank, CASE WHEN n <= 3 THEN 0 ELSE n - 2 END AS hidden FROM r WHERE rank <= CASE WHEN n <= 3 THEN n ELSE 2 END""",
    "i_weekly": """SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY ALL""",
}
