"""Queries over what readers see."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.operators import signals as sg
from tidemark.operators import views as vw
from tidemark.plans.article_queries import AGE_S, EVENT, PUB, REP, WEIGHT, published
from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of, table
from tidemark.plans.selection_queries import _pick, _sql_pick

KINDS = ("官方", "社区讨论", None, "概念雷达", "项目发布", "英文社区", "中文媒体")
NOW = "TIMESTAMP '2024-01-20 10:00:00'"


def _now():
    return F.lit("2024-01-20 10:00:00").cast("timestamp")


def e_inferred(spark, sf_dir):
    d = F.col("doc_id")
    kind = _pick(d, *KINDS)
    title = F.when(d % 9 == 0, F.concat(F.lit("新"), "title")).otherwise(F.col("title"))
    return articles(spark, sf_dir).select("doc_id", vw.inferred_layer(F.when(d % 2 == 0, F.col("source_layer")), kind).alias("layer"), vw.inferred_language(_pick(d, "zh", "fr", "mixed", "de", None), kind, title).alias("language"))


def e_evidence(spark, sf_dir):
    d = F.col("doc_id")
    items = published(spark, sf_dir).withColumns({"source_name": F.concat(F.lit("n"), F.substring("source_id", 4, 9).cast("int") % 7), "source_class": _pick(d, *KINDS)})
    stages = items.select("signal_slug").distinct().withColumn("stage", F.when(F.length("signal_slug") == 4, "Spark").otherwise("Emerging"))
    return vw.evidence_nodes(items.filter(F.col("doc_id") % 3 != 1), stages).select("signal_slug", "rank", "label", F.when(F.col("label").startswith("n"), F.col("kind") == "independent").otherwise(F.col("kind") == "conflict").alias("sure"))


def e_all_sources(spark, sf_dir):
    items = published(spark, sf_dir).withColumn("group", F.regexp_replace("concept_slug", r"\d$", ""))
    reps = items.groupBy("group").agg(F.min_by("url", F.struct("relevance_score", "url")).alias("rep_url"))
    return vw.sources_with_representative(items, reps, "group")


def _signals(spark, sf_dir):
    return published(spark, sf_dir).groupBy(F.col("signal_slug").alias("slug"), "concept_slug").agg(F.max(sg.event_time()).alias("newest_at"), F.max_by("title", F.struct("relevance_score", "url")).alias("title"), F.min("doc_id").alias("place"))


def e_weekly(spark, sf_dir):
    return vw.weekly_leads(_signals(spark, sf_dir))


def _concepts(spark, sf_dir):
    n = F.substring("concept_slug", 2, 9).cast("int")
    return articles(spark, sf_dir).groupBy("concept_slug").agg(F.round(F.avg("relevance_score") * 10, 1).alias("heat")).select(
        F.col("concept_slug").alias("slug"), F.concat(F.lit("Name "), "concept_slug").alias("name"), F.when(n % 6 == 0, "Candidate").when(n % 7 == 0, "archived").otherwise("Emerging").alias("stage"), "heat", F.when(n % 4 != 0, n * 3.0).alias("maturity"),
        F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("themes"), F.when(n % 3 == 0, "new").otherwise("").alias("daily_delta"), n.alias("n"),
    )


CONCEPTS = """co AS (SELECT concept_slug AS slug, 'Name ' || concept_slug AS name, CAST(substr(concept_slug, 2) AS INT) AS n, round(avg(relevance_score) * 10, 1) AS heat FROM art GROUP BY 1),
cn AS (SELECT *, CASE WHEN n % 6 = 0 THEN 'Candidate' WHEN n % 7 = 0 THEN 'archived' ELSE 'Emerging' END AS stage, CASE WHEN n % 4 <> 0 THEN n * 3.0::DOUBLE END AS maturity, n % 6 <> 0 AND n % 7 <> 0 AS formal FROM co)"""
SIGNALS = "sg AS (SELECT signal_slug AS slug, concept_slug, max({e}) AS newest_at, arg_max(title, (relevance_score, url)) AS title, min(doc_id) AS place FROM pub GROUP BY ALL)".replace("{e}", EVENT)


def e_formal(spark, sf_dir):
    return vw.formal_concepts(_concepts(spark, sf_dir), _signals(spark, sf_dir).withColumnRenamed("slug", "signal"))


def e_discussion_pulses(spark, sf_dir):
    return vw.discussion_pulses(articles(spark, sf_dir), as_of())


def e_stream(spark, sf_dir):
    art = articles(spark, sf_dir)
    pulses = vw.discussion_pulses(art.filter("doc_id % 2 = 0"), as_of())
    community = art.filter("source_layer = 'community' AND publish_decision IN ('publish', 'watch')").select("url", F.timestamp_add("HOUR", F.lit(-1), sg.event_time()).alias("at"), F.lit("en").alias("language"))
    return vw.discussion_stream(pulses, community)


def e_alias_pulses(spark, sf_dir):
    words = published(spark, sf_dir).filter("doc_id % 6 = 0").select(F.concat(F.lit("m"), F.col("doc_id") % 9).alias("model"), F.concat(F.lit("M"), F.col("doc_id") % 9).alias("name"), F.regexp_extract("title", r"^\p{L}{2,}", 0).alias("alias")).filter("alias <> ''")
    return vw.alias_pulses(published(spark, sf_dir), words, as_of(), 4).withColumn("urls", F.array_join("urls", " "))


def e_relations(spark, sf_dir):
    art = articles(spark, sf_dir)
    d = F.col("doc_id")
    edges = art.select(F.col("concept_slug").alias("source"), _pick(d, "extends", "uses", "enables").alias("type"), F.concat(F.lit("c"), (d * 7) % 27).alias("target"), F.col("relevance_score").alias("confidence"), "url")
    return vw.public_relations(edges, _concepts(spark, sf_dir).filter(~F.lower("stage").isin("candidate", "archived")), art.filter("publish_decision = 'publish'"), ("extends", "enables"))


def e_snapshot_status(spark, sf_dir):
    d = F.col("doc_id")
    items = articles(spark, sf_dir).withColumn("mode", F.when(d % 5 == 0, "openai").otherwise("rules"))
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("id"), _pick(k, "success", "failed", "partial", "failed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("finished_at"))
    return vw.snapshot_status(items, runs, as_of())


def e_public(spark, sf_dir):
    items = published(spark, sf_dir)
    rows = items.groupBy(F.col("signal_slug").alias("slug")).agg(F.max("relevance_score").alias("relevance_score"), F.array_sort(F.collect_list(F.struct("url", "source_id", F.col("source_layer").alias("layer")))).alias("sources"))
    return vw.public_signals(rows).select("slug", F.to_json("sources").alias("sources"))


def e_read_back(spark, sf_dir):
    n = F.col("n")
    body = F.struct("slug", F.when(n % 2 == 0, F.col("name")).alias("name"), F.when(n % 3 == 0, F.concat(F.lit("C "), "name")).alias("canonicalName"), F.when(n % 4 != 0, F.col("stage")).alias("stage"), F.when(n % 5 != 0, F.col("heat") * 3 - 40).alias("heat"), F.when(n % 10 != 0, F.lit(140.0)).alias("temperature"), F.col("maturity"), F.when(n % 2 == 0, F.col("themes")).alias("aliases"), F.when(n % 3 == 1, F.array(F.struct(F.lit("c1").alias("target")))).alias("relations"))
    return vw.read_concepts(_concepts(spark, sf_dir).select(F.when(n == 13, "{broken").otherwise(F.to_json(body)).alias("body")))


def _revisions(spark, sf_dir):
    """Revisions of customers: orders, with a heat of their own."""
    from tidemark.plans.ledger_queries import _revisions as numbered

    rows = numbered(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    # within the last 40 days, by number, so that every day of them has some
    at = F.timestamp_add("MINUTE", (-((F.col("o_orderkey") * 37) % 57600)).cast("int"), _now())
    price = F.col("o_totalprice") / 1000
    return rows.select(F.col("o_custkey").alias("slug"), "revision", at.alias("at"), F.array_contains("changed", "o_orderstatus").alias("material"), (F.col("o_orderkey") % 3 == 0).alias("controversial"), F.round(price, 1).alias("heat_after"), F.round(price * ((F.col("o_orderkey") % 5) / 3), 1).alias("heat_before"))


REV = f"""rv AS (SELECT *, row_number() OVER h AS revision, lag(o_orderstatus) OVER h AS s0 FROM orders WINDOW h AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
rw AS (SELECT o_custkey AS slug, revision, {NOW} - to_minutes((o_orderkey * 37) % 57600) AS "at", revision = 1 OR o_orderstatus IS DISTINCT FROM s0 AS material, o_orderkey % 3 = 0 AS controversial, round(o_totalprice / 1000, 1) AS heat_after, round(o_totalprice / 1000 * ((o_orderkey % 5) / 3), 1) AS heat_before FROM rv)"""
DAY = "CAST({} + INTERVAL 8 HOUR AS DATE)"
WEEK = f"BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW}"


def h_new_today(spark, sf_dir):
    made = _revisions(spark, sf_dir).filter("revision = 1").select("slug", F.col("at").alias("created_at"))
    return vw.new_today(made, _now(), 20)


def h_revised_today(spark, sf_dir):
    return vw.revised_today(_revisions(spark, sf_dir), _now(), 20)


def h_warming_top(spark, sf_dir):
    return vw.warming(_revisions(spark, sf_dir), _now(), 20).withColumns({"total": F.round("total", 3), "largest": F.round("largest", 3)})


def h_contested(spark, sf_dir):
    evidence = articles(spark, sf_dir).select(F.col("doc_id").alias("slug"), "stance", "publish_decision", "published_at")
    return vw.contested(evidence, _revisions(spark, sf_dir), _now(), 60)


def h_learning(spark, sf_dir):
    events = articles(spark, sf_dir).select(F.col("concept_slug").alias("slug"), F.col("published_at").alias("at"))
    return vw.learning_priority(_concepts(spark, sf_dir), events, _now(), 10)


def h_concepts(spark, sf_dir):
    c = _concepts(spark, sf_dir)
    tag = lambda df, name: df.select("slug", F.lit(name).alias("kind"))
    return tag(vw.filtered_concepts(c), "all").unionByName(tag(vw.filtered_concepts(c, theme="a"), "theme")).unionByName(tag(vw.filtered_concepts(c, "emerging", "b"), "both"))


def h_signal_list(spark, sf_dir):
    rows = _signals(spark, sf_dir).withColumns({"topic": _pick(F.col("place"), "x", "y"), "stage": _pick(F.col("place"), "Spark", "Emerging", "Cooling")})
    return vw.filtered_signals(rows, "x", "Spark").select("slug", "place", "lead")


def h_detail(spark, sf_dir):
    asked = _concepts(spark, sf_dir).select(F.explode(F.array(F.col("slug"), F.concat(F.lit("old-"), "slug"))).alias("slug"))
    redirects = _concepts(spark, sf_dir).select(F.concat(F.lit("old-"), "slug").alias("from_slug"), F.col("slug").alias("into_slug"))
    return vw.related_signals(asked, redirects, published(spark, sf_dir).select("signal_slug", F.when(F.col("doc_id") % 2 == 0, F.col("concept_slug")).otherwise("c1").alias("concept_slug"), "url"))


def h_claim_ledger(spark, sf_dir):
    d = F.col("doc_id")
    art = articles(spark, sf_dir)
    claims = art.filter(d % 4 != 1).groupBy(F.col("concept_slug").alias("slug"), (d % 5).alias("key")).agg(F.collect_list(F.when(d % 3 == 0, F.replace("url", F.lit("https:"), F.lit("http:"))).otherwise(F.col("url"))).alias("urls"))
    evidence = art.select(F.col("concept_slug").alias("slug"), "url", F.when(d % 2 == 0, F.substring("title", 1, 20)).otherwise(" ").alias("title"))
    return vw.claim_ledger(claims, evidence)


def h_citations(spark, sf_dir):
    d = F.col("doc_id")
    cites = articles(spark, sf_dir).groupBy(F.col("concept_slug").alias("slug"), F.concat(F.lit("f"), d % 6).alias("field")).agg(F.collect_list("url").alias("urls"))
    return vw.field_citations(cites, ["f1", "f4"])


def h_graph(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return vw.graph_nodes(edges)


def _models(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("provider"), F.round((k % 97 + 1) / 50, 4).alias("cost"), F.round(k % 89 + 0.5, 2).alias("coding"), F.round((k * 7) % 83 + 0.25, 2).alias("intelligence"))


MODELS = "mo AS (SELECT p_partkey AS id, p_brand AS provider, round((p_partkey % 97 + 1) / 50, 4) AS cost, (p_partkey % 89 + 0.5)::DOUBLE AS coding, ((p_partkey * 7) % 83 + 0.25)::DOUBLE AS intelligence FROM part)"


def g_scaled(spark, sf_dir):
    return vw.scaled_models(_models(spark, sf_dir)).select("id", "x", "y", "size")


def g_diverse(spark, sf_dir):
    return vw.diverse_top(_models(spark, sf_dir), 24).select("id", "provider", "priority")


def g_tail(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return vw.grouped_tail(counts, "name")


def g_models(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        F.when(k % 23 == 0, " ").otherwise(F.concat(F.lit(" m"), k % 1500)).alias("id"), k.alias("place"), F.concat("p_name", F.lit(" ")).alias("name"), F.col("p_brand").alias("provider"), _pick(k, "#AABBCC", "red", None).alias("colour"), (k % 17 == 0).alias("deprecated"),
        _pick(k, "2024-01-02", "Jan 2", None).alias("released"), F.when(k % 19 == 0, "n/a").otherwise((k % 89 / 7).cast("string")).alias("coding"), F.when(k % 29 == 0, "NaN").otherwise((k % 83).cast("string")).alias("intelligence"), (k % 31 / 8).cast("string").alias("cost"),
    )
    return md.normalised(rows, 5)


def g_effort_families(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("provider"), F.concat(F.initcap("p_name"), _pick(k, " (High)", " low", "", " (thinking, 32k)", " Max Pro")).alias("name"), (k % 37).alias("cost"))
    return md.families(rows).withColumn("ids", F.array_join("ids", ","))


def h_status(spark, sf_dir):
    """What the status page shows: the snapshot's figures and when its runs were."""
    status = e_snapshot_status(spark, sf_dir)
    return status.select(F.when(F.col("stale"), "stale").otherwise("live").alias("state"), "run_status", "last_good", "items", "published")


QUERIES = {f.__name__: f for f in (
    g_models, g_effort_families, h_status, e_inferred, e_evidence, e_all_sources, e_weekly, e_formal, e_discussion_pulses, e_stream, e_alias_pulses, e_relations, e_snapshot_status, e_public, e_read_back, h_new_today, h_revised_today, h_warming_top, h_contested, h_learning, h_concepts,
    h_signal_list, h_detail, h_claim_ledger, h_citations, h_graph, g_scaled, g_diverse, g_tail,
)}

KIND = _sql_pick("doc_id", *KINDS)
GROUPED = "gr AS (SELECT *, regexp_replace(concept_slug, '\\d$', '') AS \"group\" FROM pub)"

ORACLES = {
    "e_inferred": f"""WITH {ART}, k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source_layer END AS l, {_sql_pick('doc_id', 'zh', 'fr', 'mixed', 'de', None)} AS s, coalesce({KIND}, '') AS k FROM art)
SELECT doc_id, CASE WHEN l IS NOT NULL THEN l WHEN contains(k, '社区') THEN 'community' WHEN contains(k, '概念雷达') THEN 'practitioner' ELSE 'official' END AS layer,
  CASE WHEN s IN ('zh', 'mixed') THEN s WHEN contains(k, '中文') THEN 'zh' WHEN contains(k, '英文') THEN 'en' WHEN doc_id % 9 = 0 THEN 'zh' ELSE 'en' END AS language FROM k""",
    "e_evidence": f"""WITH {ART}, {PUB}, i AS (SELECT signal_slug, 'n' || (CAST(substr(source_id, 4) AS INT) % 7) AS label, {WEIGHT} AS w, {EVENT} AS t FROM pub WHERE doc_id % 3 <> 1), b AS (SELECT signal_slug, label, max((w, t)) AS o, max(w) AS w FROM i GROUP BY ALL),
r AS (SELECT signal_slug, row_number() OVER (PARTITION BY signal_slug ORDER BY o DESC, label) AS rank, label, w = 2 AS sure FROM b QUALIFY rank <= 5)
SELECT * FROM r UNION ALL SELECT signal_slug, max(rank) + 1, 'waiting for independent sources', true FROM r WHERE length(signal_slug) = 4 GROUP BY 1 HAVING max(rank) < 2""",
    "e_all_sources": f"""WITH {ART}, {PUB}, {GROUPED}, p AS (SELECT "group", arg_min(url, (relevance_score, url)) AS rep FROM gr GROUP BY 1), o AS (SELECT "group", url, row_number() OVER (PARTITION BY "group" ORDER BY {WEIGHT} DESC, {EVENT} DESC, url) AS n FROM gr),
q AS (SELECT o."group", url, CASE WHEN url = rep AND n > 8 THEN 8 WHEN n = 8 THEN 8.5 ELSE n END AS n FROM o JOIN p ON o."group" = p."group") SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY n) AS rank, url FROM q WHERE n <= 8.5 QUALIFY rank <= 8""",
    "e_weekly": f"""WITH {ART}, {PUB}, {SIGNALS} SELECT isoyear(newest_at) || '-W' || lpad(weekofyear(newest_at)::VARCHAR, 2, '0') AS week, count(*) AS signals, arg_min(slug, place) AS lead, arg_min(title, place) AS title FROM sg GROUP BY 1 ORDER BY 1 DESC LIMIT 8""",
    "e_formal": f"WITH {ART}, {PUB}, {CONCEPTS}, {SIGNALS} SELECT cn.slug, name, stage, heat, maturity, count(sg.slug) AS signals FROM cn LEFT JOIN sg ON sg.concept_slug = cn.slug WHERE formal GROUP BY ALL",
    "e_discussion_pulses": f"""WITH {ART}, w AS (SELECT *, greatest({AGE_S} / 3600.0, 0) AS age FROM art WHERE publish_decision = 'watch' AND source_layer = 'community'),
p AS (SELECT url, {EVENT} AS "at", least(100, ln(1 + engagement_count) / ln(10001) * 100) AS e, least(100, 100 * exp(-age / 72.0)) AS f, CASE WHEN age <= 24 THEN 52 ELSE 0 END AS v FROM w) SELECT url, "at", 'en' AS language, round(e * 0.35 + f * 0.25 + v * 0.2 + 42 * 0.2, 1) AS score FROM p""",
    "e_stream": f"""WITH {ART}, p AS (SELECT url, 0 AS kind, {EVENT} AS t FROM art WHERE publish_decision = 'watch' AND source_layer = 'community' AND doc_id % 2 = 0 UNION ALL SELECT url, 1, {EVENT} - INTERVAL 1 HOUR FROM art WHERE source_layer = 'community' AND publish_decision IN ('publish', 'watch'))
SELECT url, arg_min(t, (kind, t)) AS "at", 'en' AS language, CASE WHEN min(kind) = 0 THEN 'pulse' ELSE 'signal' END AS kind FROM p GROUP BY 1""",
    "e_alias_pulses": f"""WITH {ART}, {PUB}, a AS (SELECT 'm' || (doc_id % 9) AS model, 'M' || (doc_id % 9) AS name, lower(regexp_extract(title, '^\\p{{L}}{{2,}}', 0)) AS term FROM pub WHERE doc_id % 6 = 0),
h AS (SELECT DISTINCT model, name, url, source_layer AS l, {AGE_S} <= 604800 AS w, {EVENT} AS t FROM pub JOIN a ON term <> '' AND contains(lower(concat_ws(' ', title, text)), term) WHERE {AGE_S} BETWEEN 0 AND 2592000), n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY t DESC, url) AS k FROM h)
SELECT model, name, count(*) FILTER (WHERE w) AS week, count(*) AS month, count(*) FILTER (WHERE w AND l = 'official') AS week_official, count(*) FILTER (WHERE w AND l = 'practitioner') AS week_practitioner, count(*) FILTER (WHERE w AND l = 'community') AS week_community,
  count(*) FILTER (WHERE l = 'official') AS month_official, count(*) FILTER (WHERE l = 'practitioner') AS month_practitioner, count(*) FILTER (WHERE l = 'community') AS month_community, string_agg(url, ' ' ORDER BY k) FILTER (WHERE k <= 4) AS urls FROM n GROUP BY ALL""",
    "e_relations": f"""WITH {ART}, {CONCEPTS}, e AS (SELECT concept_slug AS source, {_sql_pick('doc_id', 'extends', 'uses', 'enables')} AS type, 'c' || ((doc_id * 7) % 27) AS target, relevance_score, url FROM art WHERE publish_decision = 'publish')
SELECT source, type, target, max(relevance_score) AS confidence, count(DISTINCT url) AS evidence FROM e WHERE type <> 'uses' AND source <> target AND source IN (SELECT slug FROM cn WHERE formal) AND target IN (SELECT slug FROM cn WHERE formal) GROUP BY ALL""",
    "e_snapshot_status": f"""WITH {ART}, r AS (SELECT o_orderkey AS id, {_sql_pick('o_orderkey', 'success', 'failed', 'partial', 'failed')} AS status, o_orderdate FROM orders), l AS (SELECT arg_max(status, id) AS run_status, arg_max(o_orderdate, id) FILTER (WHERE status <> 'failed') AS last_good FROM r)
SELECT (SELECT count(*) FROM art) AS items, (SELECT count(*) FROM art WHERE publish_decision = 'publish') AS published, 'mixed' AS mode, run_status, last_good, last_good IS NULL OR epoch({AS_OF_SQL}) - epoch(last_good) > 43200 AS stale FROM l""",
    "e_public": f"""WITH {ART}, {PUB} SELECT signal_slug AS slug, '[' || string_agg('{{"url":"' || url || '","layer":"' || source_layer || '"}}', ',' ORDER BY url) || ']' AS sources FROM pub GROUP BY 1""",
    "e_read_back": f"""WITH {ART}, {CONCEPTS} SELECT slug, CASE WHEN n % 3 = 0 THEN 'C ' || name WHEN n % 2 = 0 THEN name END AS name, CASE WHEN n % 4 <> 0 THEN stage ELSE 'candidate' END AS stage, greatest(0.0, least(100.0, CASE WHEN n % 5 <> 0 THEN heat * 3 - 40 WHEN n % 10 <> 0 THEN 140.0 ELSE 0.0 END)) AS heat,
  CASE WHEN maturity IS NOT NULL THEN greatest(0.0, least(100.0, maturity)) END AS maturity, CASE WHEN n % 2 = 0 THEN 2 ELSE 0 END AS aliases, CASE WHEN n % 3 = 1 THEN 1 ELSE 0 END AS relations FROM cn WHERE n <> 13""",
    "h_new_today": f"WITH {REV} SELECT slug, \"at\" AS created_at FROM rw WHERE revision = 1 AND {DAY.format(chr(34) + 'at' + chr(34))} = {DAY.format(NOW)} ORDER BY 2 DESC, 1 LIMIT 20",
    "h_revised_today": f"""WITH {REV}, t AS (SELECT slug, max(("at", revision)) AS m FROM rw WHERE revision > 1 AND material AND {DAY.format('"at"')} = {DAY.format(NOW)} GROUP BY 1) SELECT slug, m[1] AS "at", m[2] AS revision FROM t ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""",
    "h_warming_top": f"""WITH {REV}, s AS (SELECT slug, "at", heat_after - heat_before AS step FROM rw WHERE "at" {WEEK} AND heat_after > heat_before) SELECT slug, round(sum(step), 3) AS total, round(max(step), 3) AS largest, max("at") AS latest FROM s GROUP BY 1 ORDER BY sum(step) DESC, max(step) DESC, max("at") DESC, slug LIMIT 20""",
    "h_contested": f"""WITH {ART}, {REV}, u AS (SELECT doc_id AS slug, published_at AS "at" FROM art WHERE stance = 'conflict' AND publish_decision = 'publish' AND published_at {WEEK} UNION ALL SELECT slug, "at" FROM rw WHERE revision > 1 AND material AND controversial AND "at" {WEEK})
SELECT slug, max("at") AS "at" FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60""",
    "h_learning": f"""WITH {ART}, {CONCEPTS}, f AS (SELECT concept_slug AS slug, max(published_at) AS "at" FROM art WHERE published_at {WEEK} GROUP BY 1)
SELECT slug, round(heat + CASE WHEN n % 3 = 0 THEN 18 ELSE 0 END - coalesce(maturity, 50) * 0.15::DOUBLE, 3) AS priority, "at" FROM cn JOIN f USING (slug) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""",
    "h_concepts": f"WITH {ART}, {CONCEPTS}, f AS (SELECT * FROM cn WHERE formal) SELECT slug, 'all' AS kind FROM f UNION ALL SELECT slug, 'theme' FROM f WHERE n % 2 = 0 UNION ALL SELECT slug, 'both' FROM f",
    "h_signal_list": f"WITH {ART}, {PUB}, {SIGNALS}, f AS (SELECT * FROM sg WHERE place % 2 = 0 AND place % 3 = 0) SELECT slug, place, place = (SELECT min(place) FROM f) AS lead FROM f",
    "h_detail": f"""WITH {ART}, {PUB}, {CONCEPTS}, q AS (SELECT slug AS asked, slug AS concept FROM cn UNION ALL SELECT 'old-' || slug, slug FROM cn), s AS (SELECT signal_slug, CASE WHEN doc_id % 2 = 0 THEN concept_slug ELSE 'c1' END AS cs, url FROM pub)
SELECT asked, concept, signal_slug AS signal, count(DISTINCT url) AS sources FROM q JOIN s ON cs = concept OR signal_slug = concept OR starts_with(signal_slug, concept || '-') GROUP BY ALL""",
    "h_claim_ledger": f"""WITH {ART}, c AS (SELECT concept_slug AS slug, doc_id % 5 AS key, doc_id, url, title FROM art WHERE doc_id % 4 <> 1), g AS (SELECT DISTINCT slug, key FROM c), u AS (SELECT * FROM c WHERE doc_id % 3 <> 0)
SELECT g.slug, g.key, url, CASE WHEN url IS NOT NULL THEN coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(trim(substr(title, 1, 20)), '') END, regexp_extract(url, '^https://([^/?#]+)', 1)) END AS label FROM g LEFT JOIN u ON g.slug = u.slug AND g.key = u.key""",
    "h_citations": f"WITH {ART} SELECT concept_slug AS slug, url FROM art WHERE doc_id % 6 IN (1, 4)",
    "h_graph": """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS place, unnest([l_suppkey, l_partkey]) AS node FROM lineitem WHERE l_suppkey <> l_partkey) SELECT node, min(place) AS first, count(*) AS degree FROM e GROUP BY 1""",
    "g_scaled": f"""WITH {MODELS}, d AS (SELECT greatest(0.001, least(min(cost), 0.01) * 0.72) AS c0, greatest(1, greatest(max(cost), 1) * 1.32) AS c1, greatest(0, floor(least(min(coding), 0) / 10) * 10) AS k0, greatest(10, ceil(greatest(max(coding), 10) / 10) * 10) AS k1, least(min(intelligence), 0) AS i0, greatest(max(intelligence), 1) AS i1 FROM mo)
SELECT id, round(greatest(0.0, least(1.0, (ln(cost) - ln(c0)) / (ln(c1) - ln(c0)))), 6)::DOUBLE AS x, round((coding - k0) / (k1 - k0), 6)::DOUBLE AS y, round(greatest(0.0, least(1.0, (intelligence - i0) / (i1 - i0))), 6)::DOUBLE AS size FROM mo, d""",
    "g_diverse": f"""WITH {MODELS}, p AS (SELECT *, round(coding * 0.58 + intelligence * 0.34 + greatest(0, -log10(greatest(cost, 0.001))) * 3.2, 9)::DOUBLE AS priority FROM mo), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, coding DESC, intelligence DESC, cost, id) AS n, row_number() OVER (PARTITION BY provider ORDER BY priority DESC, coding DESC, intelligence DESC, cost, id) AS own FROM p),
l AS (SELECT * FROM r WHERE own = 1 ORDER BY n LIMIT 10), o AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM l) ORDER BY n LIMIT greatest(0, 24 - (SELECT count(*) FROM l))) SELECT id, provider, priority FROM l UNION ALL SELECT id, provider, priority FROM o""",
    "g_tail": """WITH b AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM b) SELECT CASE WHEN k <= 13 THEN name ELSE 'Other' END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
    "g_models": """WITH p AS (SELECT *, p_partkey AS k FROM part WHERE p_partkey % 23 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 29 <> 0 AND p_partkey % 31 <> 0), f AS (SELECT 'm' || (k % 1500) AS id, arg_min(p_name, k) AS name, arg_min(p_brand, k) AS provider, min(k) AS k FROM p GROUP BY 1)
SELECT id, name, provider, regexp_replace(lower(provider), '[^a-z0-9]+', '-', 'g') AS provider_slug, CASE WHEN k % 3 = 0 THEN '#aabbcc' END AS colour, CASE WHEN k % 3 = 0 THEN '2024-01-02' END AS released, round(k % 89 / 7, 2)::DOUBLE AS coding, (k % 83)::DOUBLE AS intelligence, round(k % 31 / 8, 6)::DOUBLE AS cost FROM f""",
    "g_effort_families": """WITH m AS (SELECT p_partkey AS id, p_brand AS provider, lower(p_name) || CASE WHEN p_partkey % 5 = 4 THEN ' max pro' ELSE '' END AS family, p_partkey % 37 AS cost FROM part) SELECT provider, family, count(*) AS members, string_agg(id, ',' ORDER BY cost, id) AS ids FROM m GROUP BY ALL HAVING count(*) > 1""",
}
ORACLES["h_status"] = f"SELECT CASE WHEN stale THEN 'stale' ELSE 'live' END AS state, run_status, last_good, items, published FROM ({ORACLES['e_snapshot_status']})"
