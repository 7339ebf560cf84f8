"""Queries over stages, maintenance, merged relations and what keeps knowledge from being public."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph, ledger, search, views
from tidemark.operators import knowledge as kn
from tidemark.operators import payloads as pl
from tidemark.plans import payload_queries as pq
from tidemark.plans.article_queries import CONCEPT_HEAT
from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of, table
from tidemark.plans.ledger_queries import _revisions

STAGES = ("archived", "validated", "contested", "cooling", "emerging", "candidate", "validated")


def _judged(spark, sf_dir):
    """Every concept's support, current state by number, and the age of its newest published evidence."""
    art = articles(spark, sf_dir)
    public = F.col("publish_decision") == "publish"
    ages = art.groupBy("concept_slug").agg(F.max(F.when(public, F.col("published_at"))).alias("newest"), F.count_if(F.col("publish_decision").isin("publish", "watch")).alias("alive"))
    n = F.substring("concept_slug", 2, 9).cast("int")
    age = F.floor((F.unix_seconds(as_of()) - F.unix_seconds("newest")) / 86400)
    rows = kn.support(art).join(ages, "concept_slug").withColumns({"n": n, "current": F.element_at(F.array(*map(F.lit, STAGES)), n % len(STAGES) + 1), "age": age})
    n = F.col("n")
    return kn.lifecycle(rows, n % 3 != 0, F.col("current"), n * 37 % 500, n % 7 != 1, n % 8 != 2, F.col("age"), n % 4 == 1, n % 3)


def f_stages(spark, sf_dir):
    return _judged(spark, sf_dir).select("concept_slug", "current", "maturity", "stage")


def _relations(spark, sf_dir):
    return pq._payloads(spark, sf_dir).relations


def _maintenance(spark, sf_dir):
    rows = _judged(spark, sf_dir).join(kn.concept_heat(articles(spark, sf_dir), as_of(), ("publish",)), "concept_slug", "left").withColumn("heat", F.coalesce("heat", F.lit(0.0)))
    n, slug = F.col("n"), F.col("concept_slug").alias("slug")
    states = rows.select(slug, F.col("current").alias("stage"), F.when(n % 2 == 0, F.col("maturity")).otherwise(50).alias("maturity"), F.col("heat"), (F.col("alive") > 0).alias("supported"), (n % 10 != 9).alias("usable"))
    return kn.maintenance(states, rows.select(slug, "stage", "maturity", "heat"), _relations(spark, sf_dir))


def f_maintenance(spark, sf_dir):
    """What maintenance makes of every concept: updated, unchanged or failed, and the relations that it drops."""
    return _maintenance(spark, sf_dir)[0]


def f_maintained_relations(spark, sf_dir):
    return _maintenance(spark, sf_dir)[1].select("slug", "type", "target", F.size("urls").alias("urls"))


def _merges(spark, sf_dir):
    """Chains of merges, 1 into 2 into 3, and one circle."""
    n = F.col("n")
    slugs = pq._base(spark, sf_dir)[1].filter((n % 4).isin(1, 2) | n.isin(11, 12))
    return slugs.select(F.col("slug").alias("src"), F.concat(F.lit("c"), F.when(n == 11, 12).when(n == 12, 11).otherwise(n + 1)).alias("dst"))


def d_canonical(spark, sf_dir):
    formal = pq._base(spark, sf_dir)[1].filter("n % 5 <> 0").select("slug")
    return graph.canonical_relations(_relations(spark, sf_dir), _merges(spark, sf_dir), formal).withColumn("urls", F.array_join("urls", " "))


def f_chained_survivors(spark, sf_dir):
    """Concepts after merges that follow each other."""
    merges = _merges(spark, sf_dir).select(F.col("src").alias("from_slug"), F.col("dst").alias("into_slug"))
    p, _ = pl.survivors(pq._payloads(spark, sf_dir), merges)
    return pq._counts(p).filter("part <> 'citation'")


def f_findings(spark, sf_dir):
    formal = pq._formal(spark, sf_dir)
    integrity = pq.f_recovered(spark, sf_dir).withColumn("slug", F.col("slug").cast("string"))
    return pl.readiness_findings(pq.f_quality_issues(spark, sf_dir), integrity, formal, formal.filter("slug <> 'c3'"))


def f_integrity(spark, sf_dir):
    revisions = _revisions(spark, sf_dir).select((F.col("o_orderstatus") == "F").alias("valid"))
    return pl.integrity_counts(pq.f_recovered(spark, sf_dir), revisions)


LOGGED = ("o_orderstatus", "o_orderpriority")


def _states(spark, sf_dir):
    """Orders of a customer as revisions of a concept, with gaps in the fields."""
    rows = _revisions(spark, sf_dir).select(F.col("o_custkey").alias("slug"), "revision", "o_orderkey", *LOGGED)
    states = rows.select("slug", "revision", "o_orderkey", F.explode(F.create_map(*[x for f in LOGGED for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    return rows.select("slug", "revision"), states.filter("o_orderkey % 5 <> 0 OR field <> 'o_orderpriority'").drop("o_orderkey")


def f_field_log(spark, sf_dir):
    return ledger.field_log(*_states(spark, sf_dir))


def f_recovered_fields(spark, sf_dir):
    """Fields of the current revision if valid, else of the newest valid one, put together from the log."""
    revisions = _revisions(spark, sf_dir).select(F.col("o_custkey").alias("slug"), "revision", (F.col("o_orderstatus") == "F").alias("valid"))
    current = revisions.groupBy("slug").agg(F.max(F.struct("revision", "valid")).alias("r")).select("slug", "r.*")
    return pl.recovered_fields(current, revisions, f_field_log(spark, sf_dir))


def f_claimed(spark, sf_dir):
    """Attempts after a claim, those of owners that lost their lease superseded, and whether their work is claimed."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("id"))
    key = F.col("id")
    work = orders.withColumn("content_hash", F.lit("a"))
    leases = orders.filter(key % 3 != 2).select("id", F.when(key % 5 == 0, "b").otherwise("a").alias("content_hash"), F.when(key % 2 == 0, "one").otherwise("two").alias("owner"), F.timestamp_add("DAY", F.when(key % 3 == 0, 1).otherwise(-1), as_of()).alias("leased_until"))
    attempts = orders.select("id", F.lit("one").alias("owner"), F.when(key % 7 == 0, "completed").otherwise("running").alias("status"))
    claims, after = ledger.claimed(work, leases, attempts, as_of(), F.lit("me"))
    return after.join(claims.select("id", F.lit(True).alias("claimed")), "id", "left").select("id", "status", F.coalesce("claimed", F.lit(False)).alias("claimed"))


def e_gated(spark, sf_dir):
    """Two snapshots: one whose gates are open, and one that an issue holds back."""
    public = articles(spark, sf_dir).filter("publish_decision = 'publish'").select("url", "source_layer", "independent_group")
    of = lambda layer: public.filter(F.col("source_layer") == layer)
    none = public.filter("url = ''")
    return views.gated(of("official"), none, none).unionByName(views.gated(of("practitioner"), none, of("practitioner")))


NEEDLE = " C1"


def h_search_all(spark, sf_dir):
    """Items, concepts with their lists and themes, and sources that mention the needle."""
    fields = pq._payloads(spark, sf_dir).fields
    labels = fields.filter("field = 'themes'").select(F.col("value").alias("theme"), F.concat(F.lit("Label of "), F.upper("slug")).alias("label"))
    order = [*pl.TEXT_FIELDS[:9], *pl.ARRAY_FIELDS]
    art, suppliers = articles(spark, sf_dir), table(spark, sf_dir, "supplier")
    kinds = {
        "signal": art.select(F.col("url").alias("id"), F.concat_ws(" ", "title", "signal_slug").alias("text")), "concept": search.concept_texts(fields, labels.distinct(), order).select(F.col("slug").alias("id"), "text"),
        "source": suppliers.select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", "s_name", F.concat(F.lit("c"), "s_suppkey")).alias("text")),
    }
    return search.search(kinds, NEEDLE)


QUERIES = {f.__name__: f for f in (f_stages, f_maintenance, f_maintained_relations, d_canonical, f_chained_survivors, f_findings, f_integrity, f_field_log, f_recovered_fields, f_claimed, e_gated, h_search_all)}

JUDGED = f"""ag AS (SELECT concept_slug, CAST(substr(concept_slug, 2) AS INT) AS k, count(*) FILTER (WHERE publish_decision <> 'reject') AS alive, count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support') AS g,
  count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support' AND source_layer = 'official') AS o, count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support' AND source_layer = 'practitioner') AS p,
  count(*) FILTER (WHERE publish_decision = 'publish' AND stance = 'conflict') AS c, floor((epoch({AS_OF_SQL}) - epoch(max(published_at) FILTER (WHERE publish_decision = 'publish'))) / 86400) AS age FROM art GROUP BY 1),
ba AS (SELECT *, k % 3 <> 0 AND k % 7 <> 1 AND k % 8 <> 2 AND g >= 2 AND o + p > 0 AS base, ({list(STAGES)})[k % {len(STAGES)} + 1] AS current, k * 37 % 500 AS idle FROM ag),
ju AS (SELECT concept_slug, k, alive, current, CASE WHEN k % 3 <> 0 THEN 25 ELSE 0 END + CASE WHEN k % 7 <> 1 THEN 25 ELSE 0 END + least(25, o * 25) + least(25, p * 25) AS maturity,
  CASE WHEN current = 'archived' OR (k % 4 = 1 AND (idle > 365 OR (current = 'cooling' AND k % 3 >= 1))) THEN 'archived' WHEN base AND c > 0 THEN 'contested' WHEN current IN ('validated', 'contested', 'cooling') AND idle > 180 AND (age IS NULL OR age > 180) THEN 'cooling'
  WHEN NOT base THEN 'candidate' WHEN g >= 3 AND p >= 1 THEN 'validated' ELSE 'emerging' END AS stage FROM ba)"""
KEPT = f"""{JUDGED}, ta AS (SELECT concept_slug AS target FROM ju WHERE current NOT IN ('candidate', 'archived') AND alive > 0), rl AS (SELECT slug, type, target, count(*) AS urls, target IN (FROM ta) OR coalesce((SELECT k % 10 = 9 FROM ju WHERE concept_slug = slug), false) AS stays FROM re GROUP BY ALL)"""
MERGED = """mg AS (SELECT slug AS src, 'c' || CASE n WHEN 11 THEN 12 WHEN 12 THEN 11 ELSE n + 1 END AS dst FROM sl WHERE n % 4 IN (1, 2) OR n IN (11, 12)),
wk(src, dst) AS (SELECT src, dst FROM mg UNION SELECT wk.src, mg.dst FROM wk JOIN mg ON wk.dst = mg.src), ends AS (SELECT src, dst FROM wk WHERE dst NOT IN (SELECT src FROM mg))"""
RECURSIVE = pq.WITH.replace("WITH ", "WITH RECURSIVE ", 1)

LOG = """st AS (SELECT o_custkey AS slug, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision, o_orderstatus AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders),
lg AS (SELECT slug, revision, 'o_orderstatus' AS field, lag(s) OVER h AS before, s AS value FROM st WINDOW h AS (PARTITION BY slug ORDER BY revision) UNION ALL SELECT slug, revision, 'o_orderpriority', lag(p) OVER h, p FROM st WINDOW h AS (PARTITION BY slug ORDER BY revision))"""

ORACLES = {
    "f_stages": f"WITH {ART}, {JUDGED} SELECT concept_slug, current, maturity, stage FROM ju",
    "f_maintenance": f"""{pq.WITH}, {KEPT}, lo AS (SELECT slug, count(*) FILTER (WHERE NOT stays) AS dropped FROM rl GROUP BY 1)
SELECT concept_slug AS slug, CASE WHEN k % 10 = 9 THEN 'failed' WHEN current <> stage OR (k % 2 = 1 AND maturity <> 50) OR coalesce(dropped, 0) > 0 THEN 'updated' ELSE 'unchanged' END AS outcome, coalesce(dropped, 0) AS dropped FROM ju LEFT JOIN lo ON slug = concept_slug""",
    "f_maintained_relations": f"{pq.WITH}, {KEPT} SELECT slug, type, target, urls FROM rl WHERE stays",
    "d_canonical": f"""{RECURSIVE}, {MERGED}, cm AS (SELECT coalesce(a.dst, slug) AS slug, type, coalesce(b.dst, target) AS target, confidence, url FROM re LEFT JOIN ends a ON a.src = slug LEFT JOIN ends b ON b.src = target)
SELECT slug, type, target, max(confidence)::DOUBLE AS confidence, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM cm WHERE slug <> target AND target IN (SELECT slug FROM sl WHERE n % 5 <> 0 AND (slug NOT IN (SELECT src FROM mg) OR slug IN (SELECT src FROM ends))) GROUP BY ALL""",
    "f_chained_survivors": f"""{RECURSIVE}, {MERGED}, mv AS (SELECT slug AS origin, coalesce(dst, slug) AS slug FROM sl LEFT JOIN ends ON slug = src), e2 AS (SELECT mv.slug, url, list_distinct(flatten(list(supports))) AS supports FROM ev JOIN mv ON ev.slug = origin GROUP BY ALL),
r2 AS (SELECT mv.slug, type, coalesce(dst, target) AS target, url FROM re JOIN mv ON re.slug = origin LEFT JOIN ends ON target = src)
SELECT DISTINCT mv.slug, 'claim' AS part, key AS item, '' AS said FROM cl JOIN mv ON cl.slug = origin UNION ALL SELECT slug, 'evidence', url, coalesce((SELECT string_agg(k, ' ' ORDER BY k) FROM (SELECT unnest(supports) AS k)), '') FROM e2
UNION ALL SELECT slug, 'relation', type || ' ' || target, string_agg(DISTINCT url, ' ' ORDER BY url) FROM r2 WHERE slug <> target GROUP BY slug, type, target""",
    "f_findings": f"""{pq.WITH}, {pq.FULL}, {pq.QUALITY}, {pq.RECOVERED}, al AS (SELECT slug, code, item FROM qi UNION ALL SELECT slug, 'FORMAL_CONCEPT_MISSING_FROM_SNAPSHOT', '' FROM fo WHERE slug = 'c3' UNION ALL SELECT slug::VARCHAR, 'CORRUPT_CONCEPT_PAYLOAD', '' FROM rr WHERE status = 'corrupt'),
wa AS (SELECT slug::VARCHAR AS slug, 'RECOVERED_CONCEPT_PAYLOAD' AS code, revision::VARCHAR AS item FROM rr WHERE status = 'recovered')
SELECT 'issue' AS level, row_number() OVER (ORDER BY slug, code, item) AS place, * FROM al QUALIFY place <= 40 UNION ALL SELECT 'warning', row_number() OVER (ORDER BY slug, code, item) AS place, * FROM wa QUALIFY place <= 20""",
    "f_integrity": f"""WITH {pq.RECOVERED}, a AS (SELECT count(*) FILTER (WHERE status = 'healthy') AS healthy, count(*) FILTER (WHERE status = 'recovered') AS recovered, count(*) FILTER (WHERE status = 'corrupt') AS corrupt FROM rr),
b AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS valid_revisions, count(*) FILTER (WHERE o_orderstatus <> 'F') AS invalid_revisions FROM orders) SELECT * FROM a, b""",
    "f_field_log": f"""WITH {LOG} SELECT slug, revision, field, before, value FROM lg WHERE before IS DISTINCT FROM value""",
    "f_recovered_fields": f"""WITH {pq.RECOVERED}, {LOG} SELECT lg.slug, lg.revision AS at, field, value FROM lg JOIN rr ON lg.slug = rr.slug AND lg.revision = rr.revision WHERE value IS NOT NULL""",
    "f_claimed": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'completed' WHEN o_orderkey % 3 <> 2 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AND o_orderkey % 2 = 0 THEN 'superseded' ELSE 'running' END AS status,
  NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS claimed FROM orders""",
    "e_gated": f"WITH {ART} SELECT url, source_layer, independent_group FROM art WHERE publish_decision = 'publish' AND source_layer = 'official'",
    "h_search_all": f"""{pq.WITH}, lb AS (SELECT slug, 'Label of ' || upper(slug) AS value FROM fi WHERE field = 'themes' AND value <> ''), tx AS (SELECT slug, value FROM fi WHERE field IN {pq._in([*pl.TEXT_FIELDS[:9], *(f for f in pl.ARRAY_FIELDS if f != 'themes')])}
UNION ALL SELECT a.slug, 'Label of ' || upper(b.slug) FROM fi a JOIN fi b ON a.field = 'themes' AND b.field = 'themes' AND a.value = b.value)
SELECT 'signal' AS kind, url AS id FROM art WHERE contains(lower(concat_ws(' ', title, signal_slug)), 'c1') UNION ALL SELECT DISTINCT 'concept', slug FROM tx WHERE contains(lower(value), 'c1')
UNION ALL SELECT 'source', s_suppkey::VARCHAR FROM supplier WHERE contains(lower(concat_ws(' ', s_name, 'c' || s_suppkey)), 'c1')""",
}
