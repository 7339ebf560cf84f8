"""Queries over the article view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import clustering as cl
from tidemark.operators import knowledge as kn
from tidemark.operators import scoring as sc
from tidemark.operators import signals as sg
from tidemark.operators import views as vw
from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of, table
from tidemark.sources import catalog as ct

#: A test lexicon for the invented prose.
STRONG, WEAK, NEGATIVE = ["ering", "ndnt", "edst"], ["tion", "the", "thth", "ung"], ["eaux", "heed"]
ROUND = 6

EVENT = "coalesce(published_at, discovered_at)"
WEIGHT = "CASE source_layer WHEN 'official' THEN 3 WHEN 'practitioner' THEN 2 ELSE 1 END"
AGE_S = f"(epoch({AS_OF_SQL}) - epoch({EVENT}))"


def _has(text: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::INT" for t in terms) + ")"


def flagship_signals(spark, sf_dir):
    return sg.ranked_signals(articles(spark, sf_dir), as_of())


MIX = f"""strongest AS (SELECT signal_slug, independent_group, max({WEIGHT}) AS w FROM pub GROUP BY ALL),
mix AS (SELECT signal_slug, count(*) FILTER (WHERE w = 3) AS official, count(*) FILTER (WHERE w = 2) AS practitioner, count(*) FILTER (WHERE w = 1) AS community FROM strongest GROUP BY 1),
ver AS (SELECT *, CASE WHEN official > 0 AND practitioner + community > 0 THEN 'cross-verified' WHEN official > 0 THEN 'official-only'
  WHEN practitioner > 0 AND practitioner + community > 1 THEN 'independently-observed' WHEN practitioner > 0 THEN 'practitioner-only' ELSE 'community-only' END AS verification FROM mix),
verc AS (SELECT *, CASE verification WHEN 'cross-verified' THEN 'high' WHEN 'community-only' THEN 'to be traced' ELSE 'medium' END AS confidence FROM ver)"""


def _heat(items: str, key: str) -> str:
    return f"""sums AS (SELECT {key}, sum(greatest(engagement_count, 0)) AS total, min(greatest({AGE_S} / 3600.0, 0)) AS freshest,
  count(*) FILTER (WHERE greatest({AGE_S} / 3600.0, 0) <= 24) AS recent, count(DISTINCT independent_group) AS groups FROM {items} GROUP BY 1),
parts AS (SELECT {key}, least(100, ln(1 + total) / ln(10001) * 100) AS engagement, least(100, 100 * exp(-freshest / 72.0)) AS freshness,
  CASE WHEN recent > 0 THEN least(100, 30 + log2(recent + 1) * 22) ELSE 0 END AS velocity, CASE WHEN groups > 0 THEN least(100, 18 + log2(groups + 1) * 24) ELSE 0 END AS participation FROM sums),
heat AS (SELECT {key}, round(engagement, 1) AS engagement, round(freshness, 1) AS freshness, round(velocity, 1) AS velocity, round(participation, 1) AS participation,
  round(engagement * 0.35 + freshness * 0.25 + velocity * 0.2 + participation * 0.2, 1) AS score FROM parts)"""


PUB = "pub AS (SELECT * FROM art WHERE publish_decision = 'publish')"
REP = f"""rep AS (SELECT signal_slug, url AS rep_url, source_layer AS rep_layer, editorial_score AS rep_editorial FROM pub
  QUALIFY row_number() OVER (PARTITION BY signal_slug ORDER BY {WEIGHT} DESC, editorial_score DESC, relevance_score DESC, {EVENT} DESC, url) = 1)"""
CNT = f"""cnt AS (SELECT signal_slug, count(*) AS evidence_count, count(DISTINCT independent_group) AS independent_groups, max(relevance_score) AS max_relevance, max({EVENT}) AS newest_at FROM pub GROUP BY 1)"""


def published(spark, sf_dir):
    return articles(spark, sf_dir).filter(F.col("publish_decision") == "publish")


def e_source_mix(spark, sf_dir):
    return sg.verification(sg.source_mix(published(spark, sf_dir), "signal_slug"))


def e_heat(spark, sf_dir):
    return sg.heat(articles(spark, sf_dir), "concept_slug", as_of())


def e_representative(spark, sf_dir):
    return sg.representatives(published(spark, sf_dir), "signal_slug")


def e_sources(spark, sf_dir):
    return sg.signal_sources(published(spark, sf_dir))


def e_latest(spark, sf_dir):
    return published(spark, sf_dir).withColumn("at", sg.event_time()).orderBy(F.desc("at"), "url").limit(320).select("url", "at")


def e_recency(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", sg.recency_label(as_of(), sg.event_time()).alias("label"))


def e_digest(spark, sf_dir):
    return sg.weekly_digest(published(spark, sf_dir))


def e_pulses(spark, sf_dir):
    return sg.pulses(articles(spark, sf_dir), STRONG + WEAK + NEGATIVE, as_of())


def e_discussion(spark, sf_dir):
    watched = articles(spark, sf_dir).filter((F.col("publish_decision") == "watch") & (F.col("source_layer") == "community"))
    return watched.groupBy("source_language").agg(F.count_distinct("url").alias("pulses"), F.max(sg.event_time()).alias("newest_at"))


def e_concepts(spark, sf_dir):
    items = articles(spark, sf_dir)
    related = items.filter(F.col("publish_decision") == "publish").groupBy("concept_slug").agg(F.count_distinct("signal_slug").alias("signals"))
    heat = kn.concept_heat(items, as_of())
    return heat.join(related, "concept_slug", "left").select("concept_slug", "heat", F.coalesce("signals", F.lit(0)).alias("signals"))


def e_status(spark, sf_dir):
    return articles(spark, sf_dir).agg(
        F.count("*").alias("items"), F.count_if(F.col("publish_decision") == "publish").alias("published"), F.count_if(F.col("publish_decision") == "watch").alias("watched"),
        F.max(sg.event_time()).alias("newest_at"), (F.max(sg.event_time()) < as_of() - F.expr("INTERVAL 12 HOURS")).alias("stale"),
    )


def c_relevance(spark, sf_dir):
    trusted = F.col("source_family") == "official"
    return articles(spark, sf_dir).select("doc_id", sc.lexicon_relevance(F.col("text"), F.col("title"), trusted, STRONG, WEAK, NEGATIVE).cast("long").alias("relevance"))


def c_valid_age(spark, sf_dir):
    items = articles(spark, sf_dir).withColumn("valid_at", sc.valid_time(F.col("published_at"), as_of() - F.expr("INTERVAL 5 DAYS")))
    return items.filter(sc.within_age(F.col("valid_at"), as_of(), 20)).select("doc_id", "valid_at")


def c_explore(spark, sf_dir):
    return sc.explorable(articles(spark, sf_dir), as_of(), NEGATIVE).select("doc_id")


def c_first_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"\?.*$", "").alias("url"), "page_id")
    return sc.first_by_url(pages, "page_id").select("url", "page_id")


def c_fair(spark, sf_dir):
    return sc.fair_order(articles(spark, sf_dir).select("doc_id", "source_id"), "source_id", "doc_id").select("doc_id", F.col("turn").cast("long").alias("turn"), "first_position")


def c_guards(spark, sf_dir):
    return sc.guards(articles(spark, sf_dir)).select("doc_id", F.col("guarded_evidence").cast("long").alias("guarded_evidence"), F.col("guarded_editorial").cast("long").alias("guarded_editorial"))


def c_blend(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.round(sc.blended_relevance(F.col("relevance_score"), F.col("novelty_score").cast("double"), F.col("source_family") == "repository"), 3).alias("relevance"))


def c_publish(spark, sf_dir):
    return sc.publish_top(articles(spark, sf_dir)).select("doc_id", "relevance_score", "editorial_score")


def c_watch(spark, sf_dir):
    items = articles(spark, sf_dir)
    return items.filter((F.col("publish_decision") == "watch") & (F.col("relevance_score") >= 3) & F.col("source_family").isin("repository", "community")).select("doc_id", "relevance_score")


def c_topic(spark, sf_dir):
    cases = F.when(F.regexp_like("text", F.lit("ering|edst")), "first").when(F.regexp_like("text", F.lit("ung")), "second").when(F.regexp_like("text", F.lit("eaux")), "third").otherwise("other")
    return articles(spark, sf_dir).select("doc_id", cases.alias("topic"))


def c_tags(spark, sf_dir):
    tags = F.slice(F.array_compact(F.array(F.col("concept_slug"), *[F.when(F.contains(F.lower("text"), F.lit(t)), F.lit(t)) for t in STRONG + WEAK + NEGATIVE])), 1, 4)
    return articles(spark, sf_dir).select("doc_id", F.array_join(tags, ",").alias("tags"))


def c_language_gate(spark, sf_dir):
    letters, accented = F.regexp_count("text", F.lit(r"\p{L}")), F.regexp_count("text", F.lit(r"[\x{00C0}-\x{024F}]"))
    return articles(spark, sf_dir).select("doc_id", ((accented >= 8) & (accented / F.greatest(letters, F.lit(1)) >= 0.05)).alias("ready"))


def c_retry(spark, sf_dir):
    attempts = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("done"))
    queue = articles(spark, sf_dir).filter(F.col("publish_decision").isin("publish", "watch")).join(attempts, "doc_id", "left").filter(F.coalesce("done", F.lit(0)) != 1)
    return queue.orderBy(F.col("done").isNotNull(), sg.event_time(), "url").limit(200).select("doc_id")


def d_window(spark, sf_dir):
    return published(spark, sf_dir).filter(F.unix_seconds(as_of()) - F.unix_seconds(sg.event_time()) <= 21 * 86400).select("doc_id", "concept_slug")


def d_tokens(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(tx.tokens(F.col("title"))), " ").alias("tokens"))


def d_jaccard(spark, sf_dir):
    """Pairs of one signal whose titles share tokens at 0.375 or more."""
    return cl.similar_pairs(published(spark, sf_dir).select("doc_id", "signal_slug", tx.tokens(F.col("title")).alias("tokens")), "signal_slug")


def d_upsert(spark, sf_dir):
    """New rows replace stored ones only where the stored decision is watch."""
    items = articles(spark, sf_dir)
    stored = items.filter(F.col("doc_id") % 3 != 0).select("url", F.col("publish_decision").alias("old"))
    new = items.filter(F.col("doc_id") % 2 == 0).select("url", F.lit("publish").alias("new"))
    joined = stored.join(new, "url", "full")
    changed = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("old") == "watch"))
    return joined.select("url", F.when(changed, F.col("new")).otherwise(F.col("old")).alias("decision"), changed.alias("changed"))


def d_compare_and_set(spark, sf_dir):
    """Changes apply only to rows that still look as they did; outcomes are counted."""
    items = articles(spark, sf_dir).select("url", F.sha2("text", 256).alias("hash"), "doc_id")
    proposed = items.filter(F.col("doc_id") % 2 == 0).select("url", F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(F.col("hash")).alias("seen"))
    outcome = F.when(F.col("hash").eqNullSafe(F.col("seen")), "updated").otherwise("conflict")
    return proposed.join(items, "url", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def a_coverage(spark, sf_dir):
    items = articles(spark, sf_dir)
    sources = items.groupBy("source_id", "source_layer", "source_family", "independent_group").agg((F.max("doc_id") % 10 != 0).alias("available"), (F.count_if(F.col("publish_decision") == "publish") > 2).alias("effective"))
    return ct.coverage(sources)


def a_catalog_sync(spark, sf_dir):
    """Sources still listed stay active; facts take the listed name."""
    listed = table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 4 != 0).select(F.concat(F.lit("src"), (F.col("s_suppkey") % 40).cast("string")).alias("source_id"), "s_name").groupBy("source_id").agg(F.min("s_name").alias("name"))
    facts = articles(spark, sf_dir).select("doc_id", "source_id")
    return facts.join(listed, "source_id", "left").select("doc_id", F.coalesce("name", "source_id").alias("source_name"), F.col("name").isNotNull().alias("active"))


def f_heat(spark, sf_dir):
    return kn.concept_heat(articles(spark, sf_dir), as_of())


def f_lifecycle(spark, sf_dir):
    supported = kn.support(articles(spark, sf_dir))
    number = F.substring("concept_slug", 2, 9).cast("int")
    current = F.when(number % 11 == 0, "archived").when(number % 5 == 0, "validated").otherwise("candidate")
    done = kn.lifecycle(supported, number % 3 != 0, current, F.lit(200))
    return done.select("concept_slug", "groups", "conflicts", "maturity", "stage")


def f_quality(spark, sf_dir):
    """(concept, claim, code): claims without any or without public evidence."""
    claims = articles(spark, sf_dir).groupBy("concept_slug", (F.col("doc_id") % 6).alias("claim")).agg(F.count_if(F.col("publish_decision") == "publish").alias("public"), F.count_if((F.col("publish_decision") == "publish") & (F.col("source_layer") == "practitioner")).alias("practice"))
    codes = F.array_compact(F.array(F.when(F.col("public") == 0, "claim_without_public_evidence"), F.when(F.col("practice") == 0, "no_practitioner_evidence")))
    return claims.select("concept_slug", "claim", F.explode(codes).alias("code"))


def f_projection(spark, sf_dir):
    """Evidence that is still public, and the claims it supports."""
    items = articles(spark, sf_dir).filter((F.col("publish_decision") == "publish") & (F.col("stance") == "support"))
    return items.groupBy("concept_slug").agg(F.count_distinct("url").alias("evidence"), F.count_distinct(F.col("doc_id") % 6).alias("claims"))


def f_status(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("publish_decision").agg(F.count_distinct("concept_slug").alias("concepts"), F.count("*").alias("evidence"), F.count_distinct("concept_slug", F.col("doc_id") % 6).alias("claims"))


def h_search(spark, sf_dir):
    """Case-insensitive search over items, parts and suppliers, as one typed list."""
    needle = F.lit("ing")
    hit = lambda df, kind, key, *cols: df.filter(F.contains(F.lower(F.concat_ws(" ", *cols)), needle)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    return hit(articles(spark, sf_dir), "item", "url", "title", "source_id").unionByName(hit(table(spark, sf_dir, "part"), "part", "p_partkey", "p_name", "p_type")).unionByName(hit(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_name"))


def h_claims(spark, sf_dir):
    items = articles(spark, sf_dir)
    return items.groupBy("concept_slug", (F.col("doc_id") % 6).alias("claim")).agg(F.count_distinct("url").alias("urls"), F.min("url").alias("first_url"))


def h_priority(spark, sf_dir):
    heat = sg.heat(articles(spark, sf_dir), "concept_slug", as_of()).select("concept_slug", "score")
    number = F.substring("concept_slug", 2, 9).cast("int")
    return heat.select("concept_slug", F.round(F.col("score") + F.when(number % 2 == 0, 18).otherwise(0) - 0.15 * 50, 2).alias("priority")).orderBy(F.desc("priority"), "concept_slug").limit(3)


def b_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("lang"), F.col("source"), F.col("text")).alias("content_hash"))


def b_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("?utm_source=x&id=1&ref=a#top")).alias("url"))
    return pages.select("page_id", tx.canonical_url(F.col("url")).alias("url"))


def b_failure(spark, sf_dir):
    cases = F.when(F.regexp_like("text", F.lit("(?i)ering")), "timeout").when(F.regexp_like("text", F.lit("(?i)eaux")), "network").otherwise("unknown")
    return table(spark, sf_dir, "documents").groupBy(cases.alias("category")).agg(F.count("*").alias("n"))


def d_alias(spark, sf_dir):
    """The first owner of each alias key, and how many owners claim it."""
    names = table(spark, sf_dir, "part").select(tx.alias_key(F.col("p_name")).alias("alias"), F.col("p_brand").alias("owner"), "p_partkey")
    return names.groupBy("alias").agg(F.min_by("owner", "p_partkey").alias("owner"), F.count_distinct("owner").alias("owners"))


def g_top_brands(spark, sf_dir):
    """The largest 13 brands, and all others together."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))
    return vw.grouped_tail(brands, "name", other="other")


QUERIES = {f.__name__: f for f in (
    flagship_signals, e_source_mix, e_heat, e_representative, e_sources, e_latest, e_recency, e_digest, e_pulses, e_discussion, e_concepts, e_status,
    c_relevance, c_valid_age, c_explore, c_first_url, c_fair, c_guards, c_blend, c_publish, c_watch, c_topic, c_tags, c_language_gate, c_retry,
    d_window, d_tokens, d_jaccard, d_upsert, d_compare_and_set, d_alias, a_coverage, a_catalog_sync, f_heat, f_lifecycle, f_quality, f_projection, f_status,
    h_search, h_claims, h_priority, b_hash, b_url, b_failure, g_top_brands)}

CONCEPT_HEAT = f"""used AS (SELECT * FROM art WHERE publish_decision IN ('publish', 'watch')),
grp AS (SELECT concept_slug, independent_group, max(CASE source_layer WHEN 'official' THEN 8 WHEN 'practitioner' THEN 7 ELSE 4 END + CASE publish_decision WHEN 'publish' THEN 4 ELSE 1 END
  + CASE stance WHEN 'support' THEN 3 WHEN 'conflict' THEN 4 ELSE 1 END) AS best, min(greatest((epoch({AS_OF_SQL}) - epoch(published_at)) / 86400.0, 0)) AS newest,
  count(*) FILTER (WHERE greatest((epoch({AS_OF_SQL}) - epoch(published_at)) / 86400.0, 0) <= 30) AS recent, sum(engagement_count) AS eng FROM used GROUP BY ALL),
con AS (SELECT concept_slug, count(*) AS n, sum(best) AS best, min(newest) AS newest, sum(recent) AS recent, sum(eng) AS eng FROM grp GROUP BY 1),
cheat AS (SELECT concept_slug, round(least(100.0, 5 + least(16, n * 4) + best + CASE WHEN newest <= 3 THEN 18 WHEN newest <= 7 THEN 14 WHEN newest <= 30 THEN 10 WHEN newest <= 90 THEN 6 WHEN newest <= 180 THEN 3 ELSE 0 END
  + least(10, recent * 2) + least(12.0, log10(eng + 1) * 2.4)), 1)::DOUBLE AS heat FROM con)"""

ORACLES = {
    "flagship_signals": f"""WITH {ART}, {PUB}, {MIX}, {_heat("pub", "signal_slug")}, {REP}, {CNT}
SELECT * FROM verc JOIN heat USING (signal_slug) JOIN rep USING (signal_slug) JOIN cnt USING (signal_slug)
ORDER BY CAST(newest_at AS DATE) DESC, CASE verification WHEN 'cross-verified' THEN 4 WHEN 'official-only' THEN 3 WHEN 'independently-observed' THEN 2 WHEN 'practitioner-only' THEN 1 ELSE 0 END DESC,
  max_relevance DESC, newest_at DESC, signal_slug LIMIT 80""",
    "e_source_mix": f"WITH {ART}, {PUB}, {MIX} SELECT * FROM verc",
    "e_heat": f"WITH {ART}, {_heat('art', 'concept_slug')} SELECT * FROM heat",
    "e_representative": f"WITH {ART}, {PUB}, {REP} SELECT * FROM rep",
    "e_sources": f"""WITH {ART}, {PUB} SELECT signal_slug, row_number() OVER (PARTITION BY signal_slug ORDER BY {WEIGHT} DESC, {EVENT} DESC, url) AS rank, url FROM pub QUALIFY rank <= 8""",
    "e_latest": f"WITH {ART}, {PUB} SELECT url, {EVENT} AS \"at\" FROM pub ORDER BY 2 DESC, url LIMIT 320",
    "e_recency": f"""WITH {ART}, a AS (SELECT doc_id, floor(greatest({AGE_S}, 0) / 3600)::BIGINT AS h FROM art)
SELECT doc_id, CASE WHEN h < 1 THEN 'now' WHEN h < 24 THEN h || 'h' WHEN h // 24 < 7 THEN (h // 24) || 'd' WHEN h // 24 < 31 THEN (h // 24 // 7) || 'w' ELSE (h // 24 // 30) || 'mo' END AS label FROM a""",
    "e_digest": f"""WITH {ART}, {PUB} SELECT strftime(date_trunc('week', {EVENT}), '%Y-%m-%d') AS week, count(*) AS items,
  (max({{'r': relevance_score, 'u': url}})).u AS lead_url FROM pub GROUP BY 1 ORDER BY 1 DESC LIMIT 8""",
    "e_pulses": f"""WITH {ART}, t AS (SELECT unnest({STRONG + WEAK + NEGATIVE}) AS term), h AS (SELECT term, {AGE_S} AS age FROM art JOIN t ON contains(lower(text), term))
SELECT term, count(*) FILTER (WHERE age BETWEEN 0 AND 604800) AS mentions_7d, count(*) FILTER (WHERE age BETWEEN 0 AND 2592000) AS mentions_30d FROM h GROUP BY 1 HAVING mentions_30d > 0""",
    "e_discussion": f"WITH {ART} SELECT source_language, count(DISTINCT url) AS pulses, max({EVENT}) AS newest_at FROM art WHERE publish_decision = 'watch' AND source_layer = 'community' GROUP BY 1",
    "e_concepts": f"""WITH {ART}, {CONCEPT_HEAT}, r AS (SELECT concept_slug, count(DISTINCT signal_slug) AS signals FROM art WHERE publish_decision = 'publish' GROUP BY 1)
SELECT concept_slug, heat, coalesce(signals, 0) AS signals FROM cheat LEFT JOIN r USING (concept_slug)""",
    "e_status": f"""WITH {ART} SELECT count(*) AS items, count(*) FILTER (WHERE publish_decision = 'publish') AS published, count(*) FILTER (WHERE publish_decision = 'watch') AS watched,
  max({EVENT}) AS newest_at, max({EVENT}) < {AS_OF_SQL} - INTERVAL 12 HOUR AS stale FROM art""",
    "c_relevance": f"""WITH {ART}, s AS (SELECT doc_id, source_family = 'official' AS trusted, {_has("lower(text)", STRONG)} AS s, {_has("lower(text)", WEAK)} AS w, {_has("lower(text)", NEGATIVE)} AS n,
  {_has("lower(title)", NEGATIVE)} AS nt, regexp_matches(title, '\\bv?\\d+\\.\\d+(\\.\\d+)?\\b') AS v FROM art)
SELECT doc_id, CASE WHEN nt > 0 THEN -100 WHEN NOT trusted AND s = 0 THEN 0 ELSE least(100, 6 * trusted::INT + 4 * s + w - 5 * n + 2 * (trusted AND v)::INT) END AS relevance FROM s""",
    "c_valid_age": f"""WITH {ART}, v AS (SELECT doc_id, CASE WHEN published_at <= {AS_OF_SQL} - INTERVAL 5 DAY + INTERVAL 24 HOUR THEN published_at END AS valid_at FROM art)
SELECT * FROM v WHERE valid_at IS NULL OR epoch({AS_OF_SQL}) - epoch(valid_at) <= 20 * 86400""",
    "c_explore": f"""WITH {ART} SELECT doc_id FROM art WHERE (source_family IN ('repository', 'community') OR source_layer = 'community') AND {_has("lower(title)", NEGATIVE)} = 0
  AND engagement_count >= CASE WHEN source_family = 'repository' THEN 30 ELSE 80 END AND {AGE_S} BETWEEN 0 AND 7 * 86400""",
    "c_first_url": "SELECT regexp_replace(url, '\\?.*$', '') AS url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "c_fair": f"WITH {ART} SELECT doc_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source_id) AS first_position FROM art",
    "c_guards": f"""WITH {ART}, g AS (SELECT doc_id, greatest(0, least(100, round(relevance_score)))::BIGINT AS r, novelty_score AS n,
  least(CASE source_layer WHEN 'community' THEN 55 WHEN 'practitioner' THEN 80 ELSE 100 END, evidence_score) AS e FROM art)
SELECT doc_id, e AS guarded_evidence, greatest(0, least(100, round(round(r * 0.5 + e * 0.3 + n * 0.2, 6))))::BIGINT AS guarded_editorial FROM g""",
    "c_blend": f"""WITH {ART} SELECT doc_id, round(greatest(0.0, least(100.0, greatest(round((relevance_score + (novelty_score - 50) / 12.5) * 10) / 10,
  CASE WHEN source_family = 'repository' THEN novelty_score / 10.0 ELSE 0 END))), 3)::DOUBLE AS relevance FROM art""",
    "c_publish": f"""WITH {ART} SELECT doc_id, relevance_score, editorial_score FROM art WHERE publish_decision = 'publish' AND relevance_score >= 5
  ORDER BY relevance_score DESC, editorial_score DESC, evidence_score DESC, {EVENT} DESC, url LIMIT 48""",
    "c_watch": f"WITH {ART} SELECT doc_id, relevance_score FROM art WHERE publish_decision = 'watch' AND relevance_score >= 3 AND source_family IN ('repository', 'community')",
    "c_topic": f"""WITH {ART} SELECT doc_id, CASE WHEN regexp_matches(text, 'ering|edst') THEN 'first' WHEN regexp_matches(text, 'ung') THEN 'second' WHEN regexp_matches(text, 'eaux') THEN 'third' ELSE 'other' END AS topic FROM art""",
    "c_tags": f"""WITH {ART} SELECT doc_id, array_to_string(list_filter([concept_slug, {", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in STRONG + WEAK + NEGATIVE)}], lambda x: x IS NOT NULL)[1:4], ',') AS tags FROM art""",
    "c_language_gate": f"""WITH {ART}, n AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS l, length(regexp_replace(text, '[^\\x{{00C0}}-\\x{{024F}}]', '', 'g')) AS a FROM art)
SELECT doc_id, a >= 8 AND a / greatest(l, 1) >= 0.05 AS ready FROM n""",
    "c_retry": f"""WITH {ART} SELECT art.doc_id FROM art LEFT JOIN labels l ON art.doc_id = l.doc_id WHERE publish_decision IN ('publish', 'watch') AND coalesce(l.quality, 0) <> 1
  ORDER BY l.quality IS NOT NULL, {EVENT}, url LIMIT 200""",
    "d_window": f"WITH {ART}, {PUB} SELECT doc_id, concept_slug FROM pub WHERE {AGE_S} <= 21 * 86400",
    "d_tokens": f"WITH {ART} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(title), 'https?://[^ ]+', ' ', 'g'), '[a-z][a-z0-9+#.-]+'))), ' ') AS tokens FROM art",
    "d_jaccard": f"""WITH {ART}, {PUB}, t AS (SELECT doc_id, signal_slug, list_distinct(regexp_extract_all(regexp_replace(lower(title), 'https?://[^ ]+', ' ', 'g'), '[a-z][a-z0-9+#.-]+')) AS k FROM pub),
p AS (SELECT a.doc_id, b.doc_id AS other_id, len(list_intersect(a.k, b.k)) AS c, len(a.k) AS n, len(b.k) AS m FROM t a JOIN t b ON a.signal_slug = b.signal_slug AND a.doc_id < b.doc_id)
SELECT doc_id, other_id, round(c / (n + m - c), 6) AS similarity FROM p WHERE c > 0 AND round(c / (n + m - c), 6) >= 0.375""",
    "d_upsert": f"""WITH {ART}, o AS (SELECT url, publish_decision AS old FROM art WHERE doc_id % 3 <> 0), n AS (SELECT url, 'publish' AS new FROM art WHERE doc_id % 2 = 0),
j AS (SELECT url, old, new, new IS NOT NULL AND (old IS NULL OR old = 'watch') AS changed FROM o FULL JOIN n USING (url))
SELECT url, CASE WHEN changed THEN new ELSE old END AS decision, changed FROM j""",
    "d_compare_and_set": f"WITH {ART} SELECT CASE WHEN doc_id % 10 = 0 THEN 'conflict' ELSE 'updated' END AS outcome, count(*) AS n FROM art WHERE doc_id % 2 = 0 GROUP BY 1",
    "d_alias": "SELECT regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS alias, arg_min(p_brand, p_partkey) AS owner, count(DISTINCT p_brand) AS owners FROM part GROUP BY 1",
    "a_coverage": f"""WITH {ART}, s AS (SELECT source_id, source_layer, source_family, independent_group, max(doc_id) % 10 <> 0 AS available, count(*) FILTER (WHERE publish_decision = 'publish') > 2 AS effective FROM art GROUP BY ALL)
SELECT source_layer, source_family, count(*) AS configured, count(*) FILTER (WHERE available) AS available, count(*) FILTER (WHERE effective) AS effective, count(DISTINCT independent_group) AS groups,
  count(DISTINCT independent_group) FILTER (WHERE effective) AS effective_groups FROM s GROUP BY GROUPING SETS ((), (source_layer), (source_family))""",
    "a_catalog_sync": f"""WITH {ART}, l AS (SELECT 'src' || (s_suppkey % 40) AS source_id, min(s_name) AS name FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1)
SELECT doc_id, coalesce(name, art.source_id) AS source_name, name IS NOT NULL AS active FROM art LEFT JOIN l ON art.source_id = l.source_id""",
    "f_heat": f"WITH {ART}, {CONCEPT_HEAT} SELECT * FROM cheat",
    "f_lifecycle": f"""WITH {ART}, s AS (SELECT concept_slug, CAST(substr(concept_slug, 2) AS INT) AS k, count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support') AS groups,
  count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support' AND source_layer = 'official') AS o,
  count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support' AND source_layer = 'practitioner') AS p,
  count(*) FILTER (WHERE publish_decision = 'publish' AND stance = 'conflict') AS conflicts FROM art GROUP BY 1),
b AS (SELECT *, k % 3 <> 0 AND groups >= 2 AND o + p > 0 AS base, CASE WHEN k % 11 = 0 THEN 'archived' WHEN k % 5 = 0 THEN 'validated' ELSE 'candidate' END AS cur FROM s)
SELECT concept_slug, groups, conflicts, CASE WHEN k % 3 <> 0 THEN 50 ELSE 0 END + least(25, o * 25) + least(25, p * 25) AS maturity,
  CASE WHEN cur = 'archived' THEN 'archived' WHEN base AND conflicts > 0 THEN 'contested' WHEN cur = 'validated' THEN 'cooling' WHEN NOT base THEN 'candidate' WHEN groups >= 3 AND p >= 1 THEN 'validated' ELSE 'emerging' END AS stage FROM b""",
    "f_quality": f"""WITH {ART}, c AS (SELECT concept_slug, doc_id % 6 AS claim, count(*) FILTER (WHERE publish_decision = 'publish') AS a, count(*) FILTER (WHERE publish_decision = 'publish' AND source_layer = 'practitioner') AS b FROM art GROUP BY ALL)
SELECT concept_slug, claim, 'claim_without_public_evidence' AS code FROM c WHERE a = 0 UNION ALL SELECT concept_slug, claim, 'no_practitioner_evidence' FROM c WHERE b = 0""",
    "f_projection": f"WITH {ART} SELECT concept_slug, count(DISTINCT url) AS evidence, count(DISTINCT doc_id % 6) AS claims FROM art WHERE publish_decision = 'publish' AND stance = 'support' GROUP BY 1",
    "f_status": f"WITH {ART} SELECT publish_decision, count(DISTINCT concept_slug) AS concepts, count(*) AS evidence, count(DISTINCT (concept_slug, doc_id % 6)) AS claims FROM art GROUP BY 1",
    "h_search": f"""WITH {ART} SELECT 'item' AS kind, url AS id FROM art WHERE contains(lower(concat_ws(' ', title, source_id)), 'ing') UNION ALL
SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'ing') UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE contains(lower(s_name), 'ing')""",
    "h_claims": f"WITH {ART} SELECT concept_slug, doc_id % 6 AS claim, count(DISTINCT url) AS urls, min(url) AS first_url FROM art GROUP BY ALL",
    "h_priority": f"""WITH {ART}, {_heat('art', 'concept_slug')} SELECT concept_slug, round(score + CASE WHEN CAST(substr(concept_slug, 2) AS INT) % 2 = 0 THEN 18 ELSE 0 END - 7.5, 2)::DOUBLE AS priority
  FROM heat ORDER BY priority DESC, concept_slug LIMIT 3""",
    "b_hash": "SELECT doc_id, sha256(lang || chr(10) || source || chr(10) || text) AS content_hash FROM documents",
    "b_url": rf"""WITH u AS (SELECT page_id, url, regexp_replace(url || '?utm_source=x&id=1&ref=a#top', '#.*$', '') AS bare FROM pages),
q AS (SELECT *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ({", ".join(map(repr, tx.TRACKING))})) AS k FROM u)
SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(bare, '\?.*$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END END AS url FROM q""",
    "b_failure": "SELECT CASE WHEN regexp_matches(text, '(?i)ering') THEN 'timeout' WHEN regexp_matches(text, '(?i)eaux') THEN 'network' ELSE 'unknown' END AS category, count(*) AS n FROM documents GROUP BY 1",
    "g_top_brands": """WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM b)
SELECT CASE WHEN k <= 13 THEN p_brand ELSE 'other' END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1""",
}
