"""Queries over streams, and over tables that are brought up to date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import signals as sg
from tidemark.operators import upserts as up
from tidemark.plans.article_queries import EVENT
from tidemark.plans.identity_queries import _titled, assign_sql
from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of, table
from tidemark.plans.selection_queries import _pick, _sql_pick
from tidemark.storage import materialize, new_path
from tidemark.streaming import digest, items


def _events(spark, sf_dir):
    return items.stream_of(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def i_new_urls(spark, sf_dir):
    url = F.concat(F.lit("https://e/"), "user_id", F.lit("/"), "event_type")
    final = table(spark, sf_dir, "events").filter("user_id % 5 = 0").select(url.alias("url"))
    found = items.new_urls(_events(spark, sf_dir).select("ts", url.alias("url")), final, "ts")
    return items.appended_rows(found).select("url")


def i_timely(spark, sf_dir):
    at = F.lit("2024-01-20").cast("timestamp")
    rows = items.timely(_events(spark, sf_dir).select("event_id", "ts"), "ts", at, 10)
    return items.appended_rows(rows)


def i_velocity(spark, sf_dir):
    """Velocity and the other parts of heat, out of a stream's hourly panes."""
    rows = lambda df: items.panes(df.select((F.col("user_id") % 10).alias("grp"), "event_type", F.floor("value").alias("value"), F.col("ts").cast("timestamp").alias("ts")), "grp", "event_type", "value")
    return items.sliding_heat(digest.run_available(spark, f"{sf_dir}/events.parquet", rows), "grp")


def i_pulses(spark, sf_dir):
    rows = lambda df: items.day_counts(df.select("event_type", F.col("ts").cast("timestamp").alias("ts")), "event_type")
    days = digest.run_available(spark, f"{sf_dir}/events.parquet", rows)
    week, month = (items.sliding_pulses(days, "event_type", n).withColumn("days", F.lit(n)) for n in (7, 30))
    return week.unionByName(month)


def i_assign(spark, sf_dir):
    """The same signals as the batch form gives, out of a stream of items."""
    art = _titled(articles(spark, sf_dir).filter("publish_decision <> 'reject'"))
    rows = art.select("id", "concept_slug", F.col("place").cast("long").alias("place"), "title", "tags", "independent_group", "event_key", (F.col("publish_decision") == "publish").alias("joins"))
    source = new_path(spark, "arriving")
    rows.write.parquet(source)
    return items.assign_stream(items.stream_of(spark, source), new_path(spark, "assigning"))()


def _stored(spark, sf_dir):
    art = articles(spark, sf_dir)
    d = F.col("doc_id")
    stored = art.filter(d % 3 != 0).select("url", "publish_decision", "relevance_score", F.concat(F.lit("old "), d).alias("title"))
    incoming = art.filter(d % 2 == 0).select("url", F.lit("publish").alias("publish_decision"), (F.col("relevance_score") + 1).alias("relevance_score"), F.concat(F.lit("new "), d).alias("title"))
    return stored, incoming


def i_upsert(spark, sf_dir):
    stored, incoming = _stored(spark, sf_dir)
    source = new_path(spark, "arriving")
    incoming.write.parquet(source)
    return items.upsert_stream(items.stream_of(spark, source), materialize(stored, "stored"), "url", F.col("publish_decision") == "watch", new_path(spark, "upserting"))


def d_upserted(spark, sf_dir):
    stored, incoming = _stored(spark, sf_dir)
    return up.upserted(stored, incoming, "url", F.col("publish_decision") == "watch")


def d_retired(spark, sf_dir):
    art = articles(spark, sf_dir).select("doc_id", "url", "publish_decision", F.concat(F.lit("cand "), "concept_slug").alias("candidate_concept"))
    return up.retired(art, art.filter("doc_id % 4 = 0")).select("url", "publish_decision", "candidate_concept", "changed")


def d_compared(spark, sf_dir):
    d = F.col("doc_id")
    stored = articles(spark, sf_dir).select("doc_id", "url", F.sha2("text", 256).alias("hash"), "publish_decision", "title", F.col("editorial_score").alias("score"))
    seen = F.struct(F.when(d % 10 == 0, "stale").otherwise(F.col("hash")).alias("hash"), "publish_decision", F.when(d % 14 == 0, F.lit(None)).otherwise(F.col("title")).alias("title"), "score")
    proposed = stored.filter(d % 2 == 0).select("url", seen.alias("seen"), F.struct(F.concat(F.lit("up "), "title").alias("title"), (F.col("score") + 1).alias("score")).alias("next"), (d % 22 == 0).alias("failed"))
    return up.compare_and_set(stored, proposed, "url", ["hash", "publish_decision"], ["title", "score"]).select("doc_id", "title", "score", "outcome")


def f_appended(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    fields = lambda change: [F.when(change, F.upper("p_name")).otherwise(F.col("p_name")).alias("definition"), F.when(k % 3 == 0, F.lit("x")).otherwise(F.col("p_brand")).alias("origin")]
    stage = lambda n: _pick(k + n, "emerging", "candidate", "validated", "emerging", "archived")
    at = lambda days: F.timestamp_add("DAY", F.lit(days), F.lit("2024-01-01").cast("timestamp"))
    current = part.filter(k % 7 != 0).select(k.alias("slug"), stage(0).alias("stage"), *fields(F.lit(False)), (k % 9 + 1).alias("revision"), at(0).alias("created_at"), at(1).alias("changed_at"))
    current = current.withColumn("origin", F.when(F.col("slug") % 6 == 0, "y").otherwise(F.col("origin")))
    return up.appended(current, part.select(k.alias("slug"), stage(1).alias("stage"), *fields(k % 4 == 0)), ["definition", "origin"], as_of())


def _attempts(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("at"), _pick(k, "completed", "failed", "completed", "conflict", "running").alias("status"), F.when(k % 2 == 0, F.concat(F.lit("s"), k % 50)).alias("slug"), (k % 8).alias("revision"))


def f_audit(spark, sf_dir):
    outputs = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("place"), F.concat(F.lit("o"), F.col("l_partkey") % 30).alias("slug"), (F.col("l_suppkey") % 5).alias("revision"))
    return up.audit(_attempts(spark, sf_dir), outputs).withColumn("outputs", F.array_join("outputs", ","))


def f_knowledge_status(spark, sf_dir):
    k = F.col("p_partkey")
    concepts = table(spark, sf_dir, "part").select(k.alias("slug"), _pick(k, "emerging", "candidate", "archived").alias("stage"), F.when(k % 8 == 0, k + 1).alias("merged_into"), (k % 5).alias("revision"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slug"), F.col("l_suppkey").alias("url"))
    last = _attempts(spark, sf_dir).groupBy("url").agg(F.max_by("status", F.struct("at", "id")).alias("status"))
    return up.knowledge_status(concepts, lines, lines, last)


def f_newest_failures(spark, sf_dir):
    last = _attempts(spark, sf_dir).groupBy("url").agg(F.max_by(F.struct("status", "at"), F.struct("at", "id")).alias("l")).select("url", "l.*")
    return up.newest_failures(last)


def e_latest_lists(spark, sf_dir):
    """The newest watched community items and the newest named candidates."""
    art = articles(spark, sf_dir).withColumn("at", sg.event_time())
    newest = lambda df, kind, n: df.orderBy(F.desc("at"), "url").limit(n).select(F.lit(kind).alias("kind"), "doc_id")
    watched = art.filter("publish_decision = 'watch'")
    return newest(watched.filter("source_layer = 'community'"), "community", 160).unionByName(newest(art.filter("publish_decision <> 'reject' AND doc_id % 3 <> 0"), "candidate", 120))


QUERIES = {f.__name__: f for f in (
    i_new_urls, i_timely, i_velocity, i_pulses, i_assign, i_upsert, d_upserted, d_retired, d_compared, f_appended, f_audit, f_knowledge_status, f_newest_failures, e_latest_lists,
)}

UPSERT = f"""o AS (SELECT url, doc_id, publish_decision, relevance_score FROM art WHERE doc_id % 3 <> 0), n AS (SELECT url, doc_id, relevance_score + 1 AS relevance_score FROM art WHERE doc_id % 2 = 0),
j AS (SELECT coalesce(o.url, n.url) AS url, o.doc_id AS od, n.doc_id AS nd, o.publish_decision AS op, o.relevance_score AS os, n.relevance_score AS ns, n.url IS NOT NULL AND (o.url IS NULL OR o.publish_decision = 'watch') AS changed FROM o FULL JOIN n ON o.url = n.url),
u AS (SELECT url, CASE WHEN changed THEN 'publish' ELSE op END AS publish_decision, CASE WHEN changed THEN ns ELSE os END AS relevance_score, CASE WHEN changed THEN 'new ' || nd ELSE 'old ' || od END AS title, changed FROM j)"""
ATTEMPTS = f"""att AS (SELECT o_orderkey AS id, o_custkey AS url, o_orderdate AS t, {_sql_pick('o_orderkey', 'completed', 'failed', 'completed', 'conflict', 'running')} AS status, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_orderkey % 50) END AS slug, o_orderkey % 8 AS revision FROM orders),
la AS (SELECT url, count(*) AS attempts, arg_max(id, (t, id)) AS id FROM att GROUP BY 1)"""

ORACLES = {
    "i_new_urls": "SELECT DISTINCT 'https://e/' || user_id || '/' || event_type AS url FROM events WHERE user_id % 5 <> 0",
    "i_timely": "WITH v AS (SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-21' THEN ts END AS ts FROM events) SELECT * FROM v WHERE ts IS NULL OR epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) <= 864000",
    "i_assign": assign_sql("false", "doc_id >= 0"),
    "i_velocity": """WITH w AS (SELECT user_id % 10 AS grp, event_type, greatest(floor(value)::BIGINT, 0) AS value, unnest(range(24)) AS h, ts FROM events), s AS (SELECT *, date_trunc('hour', ts) - to_hours(h) AS start FROM w),
c AS (SELECT grp, start, count(*) AS n, count(DISTINCT event_type) AS groups, sum(value) AS total, epoch_us(start + INTERVAL 24 HOUR) - epoch_us(max(ts)) AS age FROM s GROUP BY grp, start),
p AS (SELECT *, least(100, ln(1 + total) / ln(10001) * 100) AS e, 100 * exp(-(age / 3600000000.0) / 72) AS f, least(100, 30 + log2(n + 1) * 22) AS v, least(100, 18 + log2(groups + 1) * 24) AS pa FROM c)
SELECT grp, start, n, groups, round(e, 1) AS engagement, round(f, 1) AS freshness, round(v, 1) AS velocity, round(pa, 1) AS participation, round(e * 0.35 + f * 0.25 + v * 0.2 + pa * 0.2, 1) AS score FROM p""",
    "i_pulses": """WITH w AS (SELECT event_type, unnest(range(7)) AS d, ts, 7 AS days FROM events UNION ALL SELECT event_type, unnest(range(30)), ts, 30 FROM events) SELECT event_type, date_trunc('day', ts) - to_days(d::INT) AS start, count(*) AS n, days FROM w GROUP BY ALL""",
    "i_upsert": f"WITH {ART}, {UPSERT} SELECT url, publish_decision, relevance_score, title FROM u",
    "d_upserted": f"WITH {ART}, {UPSERT} SELECT * FROM u",
    "d_retired": f"WITH {ART}, c AS (SELECT *, doc_id % 4 = 0 AND publish_decision = 'watch' AS changed FROM art) SELECT url, CASE WHEN changed THEN 'reject' ELSE publish_decision END AS publish_decision, CASE WHEN NOT changed THEN 'cand ' || concept_slug END AS candidate_concept, changed FROM c",
    "d_compared": f"""WITH {ART}, c AS (SELECT doc_id, title, editorial_score AS score, CASE WHEN doc_id % 2 <> 0 THEN NULL WHEN doc_id % 22 = 0 THEN 'failed' WHEN doc_id % 10 = 0 OR doc_id % 14 = 0 THEN 'conflict' ELSE 'updated' END AS outcome FROM art)
SELECT doc_id, CASE WHEN outcome = 'updated' THEN 'up ' || title ELSE title END AS title, score + coalesce((outcome = 'updated')::INT, 0) AS score, outcome FROM c""",
    "f_appended": f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 7 = 0 AS fresh, p_partkey % 4 = 0 AND upper(p_name) <> p_name AS redefined, p_partkey % 6 = 0 AS moved, {_sql_pick('p_partkey', 'emerging', 'candidate', 'validated', 'emerging', 'archived')} AS old, {_sql_pick('p_partkey + 1', 'emerging', 'candidate', 'validated', 'emerging', 'archived')} AS new FROM part),
o AS (SELECT *, CASE WHEN fresh THEN 'created' WHEN NOT redefined AND NOT moved THEN 'unchanged' WHEN old NOT IN ('candidate', 'archived') AND new = 'candidate' THEN 'rejected' ELSE 'appended' END AS outcome FROM p)
SELECT k AS slug, outcome, CASE WHEN fresh THEN 1 ELSE k % 9 + 1 + (outcome = 'appended')::INT END AS revision, CASE WHEN fresh THEN {AS_OF_SQL} ELSE TIMESTAMP '2024-01-01' END AS created_at, CASE WHEN fresh OR (outcome = 'appended' AND redefined) THEN {AS_OF_SQL} ELSE TIMESTAMP '2024-01-02' END AS changed_at FROM o""",
    "f_audit": f"""WITH {ATTEMPTS}, o AS (SELECT l_orderkey AS id, string_agg('o' || (l_partkey % 30) || ':' || (l_suppkey % 5), ',' ORDER BY l_linenumber, 'o' || (l_partkey % 30), l_suppkey % 5) AS outputs FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT la.url, status, attempts, coalesce(outputs, CASE WHEN status = 'completed' AND slug IS NOT NULL THEN slug || ':' || revision END, '') AS outputs FROM la JOIN att ON la.id = att.id LEFT JOIN o ON la.id = o.id""",
    "f_knowledge_status": f"""WITH {ATTEMPTS}, c AS (SELECT {_sql_pick('p_partkey', 'emerging', 'candidate', 'archived')} AS stage, p_partkey % 8 = 0 AS merged, p_partkey % 5 AS revision FROM part), l AS (SELECT status FROM la JOIN att ON la.id = att.id)
SELECT count(*) FILTER (WHERE NOT merged AND stage = 'emerging') AS formal, count(*) FILTER (WHERE NOT merged AND stage = 'candidate') AS candidates, count(*) FILTER (WHERE merged) AS merged, sum(revision)::BIGINT AS revisions, (SELECT count(*) FROM lineitem) AS claims,
  (SELECT count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem) AS evidence, (SELECT count(*) FROM l WHERE status IN ('failed', 'conflict')) AS failed, (SELECT count(*) FROM l WHERE status <> 'completed') AS pending FROM c""",
    "f_newest_failures": f"""WITH {ATTEMPTS} SELECT la.url, status, t AS "at" FROM la JOIN att ON la.id = att.id WHERE status IN ('failed', 'conflict') ORDER BY t DESC, la.url LIMIT 10""",
    "e_latest_lists": f"""WITH {ART}, a AS (SELECT 'community' AS kind, doc_id FROM art WHERE publish_decision = 'watch' AND source_layer = 'community' ORDER BY {EVENT} DESC, url LIMIT 160), b AS (SELECT 'candidate', doc_id FROM art WHERE publish_decision <> 'reject' AND doc_id % 3 <> 0 ORDER BY {EVENT} DESC, url LIMIT 120)
SELECT * FROM a UNION ALL SELECT * FROM b""",
}
