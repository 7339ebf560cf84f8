"""Queries over the catalog, its runs, and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans.inputs import AS_OF_SQL, as_of, table
from tidemark.sources import catalog as ct


def _pick(key, *values):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(key, *values):
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


K_VALUES, P_VALUES = ("feed", "html", "json", "xml"), (None, "github-issues", "claude-changelog", "hacker-news", "odd")
L_VALUES, F_VALUES, G_VALUES = ("official", "practitioner", "community", "press"), (*ct.FAMILIES, "other"), ("en", "zh", "mixed", "fr")


def a_catalog_rules(spark, sf_dir):
    k = F.col("s_suppkey")
    fallback = F.struct(F.when(k % 12 == 0, "http://f.example.com").otherwise("https://f.example.com").alias("url"), _pick(k, *K_VALUES).alias("kind"), _pick(k, *P_VALUES).alias("parser"))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k % 97).alias("id"), F.when(k % 13 != 0, F.col("s_name")).alias("name"),
        F.concat(_pick(k, "https://", "http://", "https://u:p@"), F.lit("x.example.com/"), k).alias("url"), F.when(k % 17 != 0, "https://home.example.com").alias("homepage"),
        _pick(k, *K_VALUES).alias("kind"), _pick(k, *L_VALUES).alias("layer"), _pick(k, *F_VALUES).alias("family"), _pick(k, *G_VALUES).alias("language"), _pick(k, *P_VALUES).alias("parser"),
        F.when(k % 4 == 0, F.array(F.lit("^/a"), F.when(k % 8 == 0, "").otherwise("b"))).alias("patterns"),
        F.array(F.lit("interview"), F.when(k % 5 == 0, "interview").when(k % 5 == 1, "essay").otherwise("podcast-transcript")).alias("roles"),
        F.when(k % 3 == 0, F.array_repeat(fallback, (k % 11).cast("int"))).alias("fallbacks"),
    )
    return ct.violations(rows)


def a_catalog_dimension(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    stored = rows.filter(k % 4 != 0).select(k.alias("source_id"), F.col("s_name").alias("name"), F.lit("old").alias("family"), F.lit(True).alias("active"))
    listed = rows.filter(k % 3 != 0).select(k.alias("source_id"), F.upper("s_name").alias("name"), F.lit("new").alias("family"))
    return ct.synced(stored, listed)


def a_catalog_facts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.lit("old").alias("name"))
    listed = docs.select("source_id").distinct().filter(F.substring("source_id", 4, 9).cast("int") % 3 != 0).withColumn("name", F.upper("source_id"))
    return ct.synced_facts(docs, listed)


def _tried(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id").agg(F.max("ts").alias("last_attempt"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


CADENCES = ("1h", "2h", "4h", "8h", "12h", "24h", "3h", None)
NOW, NOW_SQL = "2024-01-30 12:00:00", "TIMESTAMP '2024-01-30 12:00:00'"
TRIED = "t AS (SELECT user_id, max(ts) AS last_attempt, max(ts) FILTER (WHERE event_type <> 'error') AS last_success, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1)"


def a_due(spark, sf_dir):
    state = ct.due_state(_pick(F.col("user_id"), *CADENCES), F.when(F.col("user_id") % 10 != 0, F.col("last_attempt")), F.lit(NOW).cast("timestamp"))
    return _tried(spark, sf_dir).select("user_id", state.alias("state"))


def a_dataset_due(spark, sf_dir):
    state = ct.due_state(_pick(F.col("user_id"), *CADENCES), F.col("last_success"), F.lit(NOW).cast("timestamp"), least_hours=4)
    return _tried(spark, sf_dir).select("user_id", state.alias("state"))


def a_endpoints(spark, sf_dir):
    e, t = F.col("event_id"), F.col("event_type")
    attempts = table(spark, sf_dir, "events").select(
        F.expr("event_id div 6").alias("source_id"), F.when(e % 6 >= 3, "relay").otherwise("direct").alias("role"), (e % 3).alias("position"), F.when(t == "error", "FETCH_ERROR").when(t == "click", "HTTP 500").alias("failure"),
        F.when(t == "view", 0).otherwise(F.col("user_id")).alias("items"), (F.col("user_id") % 5 == 0).alias("may_be_empty"),
    )
    return ct.resolved_endpoints(attempts)


def a_health(spark, sf_dir):
    k = F.col("user_id")
    seen = _tried(spark, sf_dir)
    health = seen.select(k.alias("source_id"), F.col("last_attempt").alias("last_attempt_at"), F.col("last_success").alias("last_success_at"), F.lit("success").alias("last_status"), F.lit(None).cast("string").alias("last_error"), (k * 2).alias("item_count"))
    results = seen.filter(k % 3 != 0).select(k.alias("source_id"), _pick(k, "success", "degraded", "error").alias("status"), F.lit(NOW).cast("timestamp").alias("at"), F.when(k % 3 == 2, "boom").alias("error"), (k % 4).alias("accepted"))
    return ct.updated_health(health, results)


def a_status(spark, sf_dir):
    last = F.when(F.col("last_type") == "error", "error").when(F.col("last_type") == "click", "degraded").when(F.col("last_type") == "view", None).otherwise("success")
    hours = F.coalesce(ct.cadence_hours(_pick(F.col("user_id"), *CADENCES)), F.lit(24))
    return _tried(spark, sf_dir).select("user_id", ct.status(last, F.col("last_success"), hours, F.lit(NOW).cast("timestamp")).alias("status"))


def a_coverage_fallback(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, F.struct((k % 50).alias("configured"), (k % 40).alias("available"), F.when(k % 2 == 0, k % 30).alias("effective"))).alias("coverage"),
        F.when(k % 5 != 0, k % 90).alias("source_count"), F.when(k % 7 == 0, k % 80).alias("available_count"), F.when(k % 2 == 0, k % 11).alias("healthy_count"), (k % 6).alias("degraded_count"),
    )
    return ct.coverage_or_counts(rows)


def a_run_summary(spark, sf_dir):
    results = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH").alias("run"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("user_id") % 2 == 0, "rules").otherwise("openai")).alias("mode"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("faults"),
    )
    return ct.run_summary(results, "run")


def a_active(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("source_id"), F.col("s_name").alias("name"), _pick(k, "P1", "P0", "P2").alias("priority"), F.when(k % 7 != 0, k % 4 != 0).alias("active"))
    return ct.active_sources(rows)


def _messages(spark, sf_dir):
    """Messages about pages, as an operator would log them."""
    n = F.col("page_id")
    said = _pick(n, "HTTP 404 at ", "fetch failed for ", "rate limit hit: ", "invalid JSON from ", "no relation in ", "theme lost: ", "claim key used twice in ", "boom ", "http 503 ", "needs-review ", "中文 ", "缺少 ", "evidence lost ")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(said, "url", F.lit("?token=s3cret"), F.lit(" s3cret")).alias("message"), _pick(n, "failed", "conflict", "failed", "superseded", "failed").alias("status"))


SAID = _sql_pick("page_id", "HTTP 404 at ", "fetch failed for ", "rate limit hit: ", "invalid JSON from ", "no relation in ", "theme lost: ", "claim key used twice in ", "boom ", "http 503 ", "needs-review ", "中文 ", "缺少 ", "evidence lost ")
MESSAGES = f"m AS (SELECT page_id, url, {SAID} || url || '?token=s3cret' || ' s3cret' AS message, {_sql_pick('page_id', 'failed', 'conflict', 'failed', 'superseded', 'failed')} AS status FROM pages)"


def b_safe_messages(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("page_id", tx.error_code(F.col("message")).alias("code"), tx.safe_message(F.col("message"), F.lit("s3cret")).alias("safe"), tx.safe_endpoint(F.col("url")).alias("endpoint"))


def b_failures(spark, sf_dir):
    return _messages(spark, sf_dir).select("page_id", tx.failure_category(F.col("message"), F.col("status")).alias("category"))


QUERIES = {f.__name__: f for f in (
    a_catalog_rules, a_catalog_dimension, a_catalog_facts, a_due, a_dataset_due, a_endpoints, a_health, a_status, a_coverage_fallback, a_run_summary, a_active, b_safe_messages, b_failures,
)}

HTTPS = r"(?i)^https://[^/?#@\s]+([/?#]|$)"
DUE = "CASE c WHEN '1h' THEN 1 WHEN '2h' THEN 2 WHEN '4h' THEN 4 WHEN '8h' THEN 8 WHEN '12h' THEN 12 WHEN '24h' THEN 24 END"


def _fits(kind, parser):
    listed = ", ".join(map(repr, ct.JSON_PARSERS))
    return f"CASE {kind} WHEN 'json' THEN coalesce({parser}, '') IN ({listed}) WHEN 'html' THEN coalesce({parser}, '') IN ('', 'claude-changelog') ELSE coalesce({parser}, '') = '' END"


def _rule(name, condition):
    return f"SELECT id, '{name}' AS rule FROM r WHERE {condition}"


ORACLES = {
    "a_catalog_rules": f"""WITH b AS (SELECT s_suppkey AS k, 's' || (s_suppkey % 97) AS id, CASE WHEN s_suppkey % 13 <> 0 THEN s_name END AS name, {_sql_pick('s_suppkey', 'https://', 'http://', 'https://u:p@')} || 'x.example.com/' || s_suppkey AS url,
  CASE WHEN s_suppkey % 17 <> 0 THEN 'https://home.example.com' END AS homepage, {_sql_pick('s_suppkey', *K_VALUES)} AS kind, {_sql_pick('s_suppkey', *L_VALUES)} AS layer, {_sql_pick('s_suppkey', *F_VALUES)} AS family,
  {_sql_pick('s_suppkey', *G_VALUES)} AS language, {_sql_pick('s_suppkey', *P_VALUES)} AS parser FROM supplier), r AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM b)
{_rule('required', "coalesce(name, '') = '' OR homepage IS NULL")} UNION ALL {_rule('unique-id', 'same > 1')} UNION ALL {_rule('kind', "kind = 'xml'")} UNION ALL {_rule('layer', "layer = 'press'")}
UNION ALL {_rule('family', "family = 'other'")} UNION ALL {_rule('language', "language = 'fr'")} UNION ALL {_rule('url', f"NOT regexp_matches(url, '{HTTPS}')")} UNION ALL {_rule('homepage', 'homepage IS NULL')}
UNION ALL {_rule('parser', f"NOT ({_fits('kind', 'parser')})")} UNION ALL {_rule('pattern', 'k % 8 = 0')} UNION ALL {_rule('role', 'k % 5 = 1')} UNION ALL {_rule('role-twice', 'k % 5 = 0')}
UNION ALL {_rule('fallbacks', 'k % 3 = 0 AND k % 11 > 8')} UNION ALL {_rule('fallback', f"k % 3 = 0 AND k % 11 > 0 AND (k % 12 = 0 OR kind = 'xml' OR NOT ({_fits('kind', 'parser')}))")}""",
    "a_catalog_dimension": """SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 3 <> 0 THEN upper(s_name) ELSE s_name END AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'new' ELSE 'old' END AS family,
  s_suppkey % 3 <> 0 AS active FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 4 <> 0""",
    "a_catalog_facts": "SELECT doc_id, source AS source_id, CASE WHEN CAST(substr(source, 4) AS INT) % 3 <> 0 THEN upper(source) ELSE 'old' END AS name FROM documents",
    "a_due": f"""WITH {TRIED}, c AS (SELECT *, {_sql_pick('user_id', *CADENCES)} AS c FROM t)
SELECT user_id, CASE WHEN {DUE} IS NULL THEN 'bad-cadence' WHEN user_id % 10 = 0 OR epoch({NOW_SQL})::BIGINT - floor(epoch(last_attempt)) >= ({DUE}) * 3600 THEN 'due' ELSE 'waiting' END AS state FROM c""",
    "a_dataset_due": f"""WITH {TRIED}, c AS (SELECT *, {_sql_pick('user_id', *CADENCES)} AS c FROM t)
SELECT user_id, CASE WHEN {DUE} IS NULL THEN 'bad-cadence' WHEN last_success IS NULL OR epoch({NOW_SQL})::BIGINT - floor(epoch(last_success)) >= greatest({DUE}, 4) * 3600 THEN 'due' ELSE 'waiting' END AS state FROM c""",
    "a_endpoints": """WITH a AS (SELECT event_id // 6 AS source_id, CASE WHEN event_id % 6 >= 3 THEN 'relay' ELSE 'direct' END AS role, event_id % 3 AS position, CASE event_type WHEN 'error' THEN 'FETCH_ERROR' WHEN 'click' THEN 'HTTP 500' END AS failure,
  CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS items, user_id % 5 = 0 AS may FROM events),
u AS (SELECT *, failure IS NULL AND (items > 0 OR may) AS ok, row_number() OVER (PARTITION BY source_id ORDER BY role, position) AS n FROM a), b AS (SELECT source_id, min(n) FILTER (WHERE ok) AS best, count(*) AS total FROM u GROUP BY 1),
f AS (SELECT u.source_id, count(*) AS failures, arg_min(coalesce(failure, 'EMPTY_RESULT'), n) AS first_failure FROM u JOIN b ON u.source_id = b.source_id WHERE NOT ok AND n < coalesce(best, total + 1) GROUP BY 1)
SELECT b.source_id, CASE WHEN best IS NULL THEN 'error' WHEN role = 'direct' AND position = 0 THEN 'success' ELSE 'degraded' END AS status, role, position, items, coalesce(failures, 0) AS failures, first_failure
FROM b LEFT JOIN u ON b.source_id = u.source_id AND n = best LEFT JOIN f ON b.source_id = f.source_id""",
    "a_health": f"""WITH {TRIED} SELECT user_id AS source_id, CASE WHEN user_id % 3 <> 0 THEN {NOW_SQL} ELSE last_attempt END AS last_attempt_at, CASE WHEN user_id % 3 = 1 THEN {NOW_SQL} ELSE last_success END AS last_success_at,
  CASE user_id % 3 WHEN 1 THEN 'degraded' WHEN 2 THEN 'error' ELSE 'success' END AS last_status, CASE WHEN user_id % 3 = 2 THEN 'boom' END AS last_error, user_id * 2 + CASE WHEN user_id % 3 <> 0 THEN user_id % 4 ELSE 0 END AS item_count FROM t""",
    "a_status": f"""WITH {TRIED}, c AS (SELECT *, {_sql_pick('user_id', *CADENCES)} AS c, CASE last_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'degraded' WHEN 'view' THEN NULL ELSE 'success' END AS s FROM t),
l AS (SELECT *, epoch({NOW_SQL})::BIGINT - coalesce(floor(epoch(last_success)), 0) > coalesce({DUE}, 24) * 5400 + 900 AS late FROM c)
SELECT user_id, CASE WHEN s = 'error' THEN 'error' WHEN s IS NOT NULL AND late THEN 'late' WHEN s = 'degraded' THEN 'degraded' WHEN s = 'success' THEN 'normal' ELSE 'pending' END AS status FROM l""",
    "a_coverage_fallback": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 90 ELSE 0 END AS configured,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 40 WHEN o_orderkey % 7 = 0 THEN o_orderkey % 80 ELSE CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 11 ELSE 0 END + o_orderkey % 6 END AS available,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 30 ELSE 0 END AS effective FROM orders""",
    "a_run_summary": """WITH r AS (SELECT strftime(ts, '%Y-%m-%d %H') AS run, event_type = 'error' AS bad, CASE WHEN event_type = 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN 'rules' ELSE 'openai' END END AS mode FROM events)
SELECT run, CASE WHEN bool_and(bad) THEN 'failed' WHEN bool_or(bad) THEN 'partial' ELSE 'success' END AS status, count(*) FILTER (WHERE bad) AS error_count,
  CASE count(DISTINCT mode) WHEN 0 THEN 'none' WHEN 1 THEN min(mode) ELSE 'mixed' END AS analysis_mode FROM r GROUP BY 1""",
    "a_active": f"SELECT s_suppkey AS source_id, s_name AS name, {_sql_pick('s_suppkey', 'P1', 'P0', 'P2')} AS priority, true AS active FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 4 <> 0 ORDER BY priority, name",
    "b_safe_messages": rf"""WITH {MESSAGES}, c AS (SELECT *, regexp_extract(message, '(?i)\bHTTP\s+(\d{{3}})\b', 1) AS n FROM m)
SELECT page_id, CASE WHEN n = '' THEN 'FETCH_ERROR' ELSE 'HTTP ' || n END AS code,
  CASE WHEN n <> '' THEN 'HTTP ' || n ELSE substr(replace(regexp_replace(message, '(?i)https://([^/?#\s"''<>]+)([^?#\s"''<>]*)[^\s"''<>]*', '\1\2', 'g'), 's3cret', '[redacted]'), 1, 500) END AS safe,
  regexp_replace(url, '(?i)^https?://([^/?#]+)([^?#]*).*$', '\1\2') AS endpoint FROM c""",
    "b_failures": f"WITH {MESSAGES} SELECT page_id, CASE WHEN status = 'conflict' THEN 'article-input-conflict' WHEN status = 'superseded' THEN 'analysis-superseded' "
    + " ".join(f"WHEN regexp_matches(message, '{p}') THEN '{n}'" for n, p in tx.FAILURES) + " ELSE 'concept-analysis-failed' END AS category FROM m",
}
