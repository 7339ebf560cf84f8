"""Queries over the knowledge of concepts as child tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import knowledge as kn
from tidemark.operators import payloads as pl
from tidemark.plans.article_queries import AGE_S, CONCEPT_HEAT
from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of, table
from tidemark.plans.selection_queries import ACCENTED, _pick, _sql_pick

EVERY = (*pl.TEXT_FIELDS, *pl.ARRAY_FIELDS)
TYPES = ("extends", "uses", "enables")
L_VALUES, S_VALUES = ("official", "practitioner", "community", "press"), ("support", "conflict", "context", "odd", "support")


def _base(spark, sf_dir):
    d = F.col("doc_id")
    art = articles(spark, sf_dir)
    slugs = art.select(F.col("concept_slug").alias("slug")).distinct().withColumn("n", F.substring("slug", 2, 9).cast("int"))
    return art.withColumn("slug", F.col("concept_slug")), slugs, d


def _payloads(spark, sf_dir, shift=0):
    """Payloads of 25 concepts, with gaps and errors by number; another ``shift`` makes another edition of them."""
    art, slugs, d = _base(spark, sf_dir)
    i = F.col("i") + shift
    fields = slugs.select("slug", "n", F.posexplode(F.array(*map(F.lit, EVERY))).alias("i", "field"))
    gone = (F.col("n") * 7 + i * 3) % 5 == 0
    said = F.concat_ws("-", "field", "slug", F.when((F.col("n") + F.col("i")) % 3 == 0, F.lit(str(shift))))
    fields = fields.filter(~gone).select("slug", "field", F.when((F.col("n") + i) % 11 == 0, " ").otherwise(said).alias("value"))
    k = (d + shift) % 7
    key = F.concat(F.when(k == 5, "K").otherwise("k"), k)
    rows = art.filter((d + shift) % 9 != 0)
    claims = rows.groupBy("slug", key.alias("key")).agg(F.min("doc_id").alias("m")).select("slug", "key", F.concat(F.lit("t "), "key", F.when(F.col("m") % 4 == 0, str(shift)).otherwise("")).alias("text"), _pick(F.col("m"), "definition", "mechanism").alias("kind"), (F.col("m") % 14 / 10.0).alias("confidence"))
    evidence = rows.filter(d % 3 != 0).select(
        "slug", "url", F.concat(F.lit("old "), d).alias("title"), _pick(d, *L_VALUES).alias("source_layer"), F.col("independent_group").alias("grp"), _pick(d + shift, *S_VALUES).alias("stance"), F.when(d % 10 == 0, "publish").otherwise(F.col("publish_decision")).alias("decision"),
        F.when(d % 13 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(key, F.concat(F.lit("k"), (d * 3) % 9)))).alias("supports"),
    )
    field = F.element_at(F.array(*map(F.lit, EVERY)), ((d * 11 + shift) % len(EVERY) + 1).cast("int"))
    citations = rows.filter(d % 4 != 0).groupBy("slug", field.alias("field")).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    relations = rows.filter(d % 5 == 0).groupBy("slug", _pick(d, *TYPES).alias("type"), F.concat(F.lit("c"), (d * 3) % 31).alias("target")).agg(F.max("relevance_score").alias("confidence"), F.array_sort(F.collect_list("url")).alias("urls"))
    return pl.Payloads(fields, claims, evidence, citations, relations)


def _sql(shift=0, p=""):
    """The same as CTEs, one row for each claim that evidence supports, each cited url, each relation's url."""
    key = f"(CASE WHEN (doc_id + {shift}) % 7 = 5 THEN 'K' ELSE 'k' END || ((doc_id + {shift}) % 7))"
    return f"""{p}sl AS (SELECT DISTINCT concept_slug AS slug, CAST(substr(concept_slug, 2) AS INT) AS n FROM art),
{p}en AS (SELECT * FROM (SELECT unnest({list(EVERY)}) AS field, unnest(range({len(EVERY)})) AS i)),
{p}fi AS (SELECT slug, field, CASE WHEN (n + i + {shift}) % 11 = 0 THEN ' ' ELSE concat_ws('-', field, slug, CASE WHEN (n + i) % 3 = 0 THEN '{shift}' END) END AS value FROM {p}sl, {p}en WHERE (n * 7 + (i + {shift}) * 3) % 5 <> 0),
{p}ro AS (SELECT *, concept_slug AS slug, {key} AS key FROM art WHERE (doc_id + {shift}) % 9 <> 0),
{p}cl AS (SELECT slug, key, 't ' || key || CASE WHEN m % 4 = 0 THEN '{shift}' ELSE '' END AS text, {_sql_pick('m', 'definition', 'mechanism')} AS kind, m % 14 / 10.0::DOUBLE AS confidence FROM (SELECT slug, key, min(doc_id) AS m FROM {p}ro GROUP BY ALL)),
{p}ev AS (SELECT slug, url, doc_id, 'old ' || doc_id AS title, {_sql_pick('doc_id', *L_VALUES)} AS source_layer, independent_group AS grp, {_sql_pick(f'doc_id + {shift}', *S_VALUES)} AS stance, CASE WHEN doc_id % 10 = 0 THEN 'publish' ELSE publish_decision END AS decision,
  CASE WHEN doc_id % 13 = 0 THEN []::VARCHAR[] ELSE list_distinct([key, 'k' || ((doc_id * 3) % 9)]) END AS supports FROM {p}ro WHERE doc_id % 3 <> 0),
{p}su AS (SELECT DISTINCT slug, url, unnest(supports) AS key FROM {p}ev),
{p}ci AS (SELECT slug, ({list(EVERY)})[(doc_id * 11 + {shift}) % {len(EVERY)} + 1] AS field, url FROM {p}ro WHERE doc_id % 4 <> 0),
{p}re AS (SELECT slug, {_sql_pick('doc_id', *TYPES)} AS type, 'c' || ((doc_id * 3) % 31) AS target, relevance_score AS confidence, url FROM {p}ro WHERE doc_id % 5 = 0),
{p}st AS (SELECT slug, CASE n % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'contested' WHEN 2 THEN 'archived' ELSE 'emerging' END AS stage FROM {p}sl)"""


def _stages(spark, sf_dir):
    n = F.col("n") % 5
    return _base(spark, sf_dir)[1].select("slug", F.when(n == 0, "candidate").when(n == 1, "contested").when(n == 2, "archived").otherwise("emerging").alias("stage"))


def _counts(p: pl.Payloads) -> DataFrame:
    """What payloads hold, as rows (slug, part, item, said)."""
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(c, none)), " ")
    parts = [
        p.claims.select("slug", F.lit("claim").alias("part"), F.col("key").alias("item"), F.lit("").alias("said")), p.evidence.select("slug", F.lit("evidence").alias("part"), F.col("url").alias("item"), joined("supports").alias("said")),
        p.citations.select("slug", F.lit("citation").alias("part"), F.col("field").alias("item"), joined("urls").alias("said")), p.relations.select("slug", F.lit("relation").alias("part"), F.concat_ws(" ", "type", "target").alias("item"), joined("urls").alias("said")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _merged_into(spark, sf_dir):
    return _base(spark, sf_dir)[1].filter("n % 4 = 3").select(F.col("slug").alias("from_slug"), F.concat(F.lit("c"), F.col("n") - 1).alias("into_slug"))


def f_rules(spark, sf_dir):
    """Broken rules by code: how often, and by how many concepts."""
    known = _stages(spark, sf_dir).filter("stage <> 'candidate'").select("slug")
    return pl.violations(_payloads(spark, sf_dir), _stages(spark, sf_dir), known).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("slug").alias("concepts"), F.min(F.concat_ws(" ", "slug", "item")).alias("first"))


def f_evidence(spark, sf_dir):
    rich, lost = pl.enriched_evidence(_payloads(spark, sf_dir).evidence, articles(spark, sf_dir).filter("doc_id % 7 <> 0"))
    return rich.select("slug", "url", "source_layer", "grp", "stance", "decision", "published_at", "engagement").unionByName(lost, allowMissingColumns=True)


def f_bound_claims(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return pl.bound_claims(p.claims, p.evidence).select("slug", "key", "confidence", "n_urls", "first_url", "unbound")


def f_reviews(spark, sf_dir):
    return pl.reviews(_payloads(spark, sf_dir), _stages(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


def f_history(spark, sf_dir):
    from tidemark.plans.ledger_queries import _revisions

    return pl.history(_revisions(spark, sf_dir).withColumnRenamed("o_custkey", "slug"), 3).select("slug", "revision", "place", "o_orderkey")


def f_maintained(spark, sf_dir):
    """Lifecycles judged anew by published evidence: stages that change, concepts without evidence archived."""
    art = articles(spark, sf_dir)
    n = F.substring("concept_slug", 2, 9).cast("int")
    current = F.when(n % 11 == 0, "archived").when(n % 5 == 0, "validated").otherwise("emerging")
    return kn.maintained(art, as_of(), n % 3 != 0, current)


def f_recovered(spark, sf_dir):
    from tidemark.plans.ledger_queries import _revisions

    revisions = _revisions(spark, sf_dir).select(F.col("o_custkey").alias("slug"), "revision", (F.col("o_orderstatus") == "F").alias("valid"))
    current = revisions.groupBy("slug").agg(F.max(F.struct("revision", "valid")).alias("r")).select("slug", "r.*")
    return pl.recovered(current, revisions)


def f_projected(spark, sf_dir):
    p = _payloads(spark, sf_dir)
    return _counts(pl.projected(p, pl.allowed_evidence(p.evidence, articles(spark, sf_dir), _stages(spark, sf_dir))))


def f_publish_current(spark, sf_dir):
    return _counts(pl.publish_current(_payloads(spark, sf_dir), articles(spark, sf_dir)))


def f_last_good(spark, sf_dir):
    old = _payloads(spark, sf_dir, 3)
    new = pl.publish_current(_payloads(spark, sf_dir), articles(spark, sf_dir))
    return pl.last_good_fields(new, old).withColumn("urls", F.array_join("urls", " "))


def _increments(spark, sf_dir):
    patched = _base(spark, sf_dir)[1].select("slug", F.explode(F.array(*map(F.lit, ("definition", "aliases", "mechanism", "tradeoffs", "evolution")))).alias("field"))
    return pl.merged(_payloads(spark, sf_dir), _payloads(spark, sf_dir, 3), patched)


def f_merged(spark, sf_dir):
    p, _ = _increments(spark, sf_dir)
    return _counts(p).filter("part <> 'relation'").unionByName(p.fields.select("slug", F.lit("field").alias("part"), F.col("field").alias("item"), F.col("value").alias("said")))


def f_merge_conflicts(spark, sf_dir):
    return _increments(spark, sf_dir)[1]


def f_survivors(spark, sf_dir):
    p, _ = pl.survivors(_payloads(spark, sf_dir), _merged_into(spark, sf_dir))
    stance = p.evidence.groupBy("slug", "stance").agg(F.count("*").alias("n")).select("slug", F.lit("stance").alias("part"), F.col("stance").alias("item"), F.col("n").cast("string").alias("said"))
    return _counts(p).unionByName(stance).unionByName(p.fields.select("slug", F.lit("field").alias("part"), F.col("field").alias("item"), F.col("value").alias("said")))


def _extracted(spark, sf_dir):
    art, _, d = _base(spark, sf_dir)
    body = F.transform(F.sequence(F.lit(1), (d % 5).cast("int") + 1), lambda i: F.struct(
        F.concat(F.when((d + i) % 6 == 0, "Bad_").otherwise("con-"), (d + i) % 40).alias("slug"), F.lit("Name").alias("name"), F.create_map(F.lit("definition"), F.substring("text", 1, 200), F.lit("dailyDelta"), F.lit("é é é é é"), F.lit("odd"), F.lit("éééé")).alias("fields"),
        F.transform(F.sequence(F.lit(1), (d % 11).cast("int") + 1), lambda j: F.struct(F.concat(F.lit("Key "), j).alias("key"), F.when((d + j) % 3 == 0, "plain").otherwise(F.concat(F.lit(" àéîõü "), j)).alias("text"), F.when(j % 2 == 0, "pattern").otherwise("odd").alias("kind"), (j / F.lit(4)).alias("confidence"))).alias("claims"),
    ))
    rows = art.select("url", "title", "source_layer", F.col("independent_group").alias("grp"), F.to_json(body).alias("body"))
    return pl.compact_extractions(rows, lambda c: tx.led_by(c, ACCENTED, 4, 0.05))


def f_extracted(spark, sf_dir):
    p = _extracted(spark, sf_dir)
    claims = p.claims.select("slug", F.lit("claim").alias("part"), F.col("key").alias("item"), F.concat_ws(" ", "text", "kind", "confidence").alias("said"))
    evidence = p.evidence.select("slug", F.lit("evidence").alias("part"), F.col("url").alias("item"), F.concat_ws(" ", "stance", F.size("supports")).alias("said"))
    return claims.unionByName(evidence).unionByName(p.citations.select("slug", F.lit("citation").alias("part"), F.col("field").alias("item"), F.size("urls").cast("string").alias("said")))


def f_normalised(spark, sf_dir):
    art, slugs, _ = _base(spark, sf_dir)
    own = _payloads(spark, sf_dir).evidence.groupBy("slug").agg(F.min("url").alias("url"))
    known = _stages(spark, sf_dir).filter("stage <> 'candidate'").select("slug")
    return _counts(pl.normalised(_payloads(spark, sf_dir), articles(spark, sf_dir).filter("doc_id % 17 <> 0"), known, own))


def f_batch_rules(spark, sf_dir):
    art, _, d = _base(spark, sf_dir)
    outputs = art.select("url", "doc_id", F.explode(F.sequence(F.lit(1), (d % 10).cast("int") + 1)).alias("j")).select("url", "doc_id", "j", F.concat(F.lit("s"), F.when(d % 6 == 0, F.col("j") % 4).otherwise(F.col("j"))).alias("slug"))
    evidence = outputs.select("url", "slug", F.when((F.col("doc_id") + F.col("j")) % 7 == 0, "other").otherwise(F.col("url")).alias("evidence_url"), F.when((F.col("doc_id") + F.col("j")) % 5 == 0, "renamed").otherwise("same").alias("evidence_title"))
    return pl.batch_violations(outputs.select("url", "slug"), evidence, art.select("url", F.lit("same").alias("title")))


def f_themes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    catalog = part.select(F.lower("p_type").alias("theme"), F.concat(F.lit(" "), F.initcap("p_type"), F.lit("!")).alias("label")).distinct().filter("theme <> 'promo'")
    k = F.col("p_partkey")
    labels = part.select(F.col("p_brand").alias("slug"), k.alias("place"), F.when(k % 3 == 0, "Nothing").otherwise(F.col("p_type")).alias("label")).filter(k % 4 != 0)
    chosen, unknown = pl.themes(labels, catalog, "standard")
    return chosen.select("slug", F.array_join("themes", ",").alias("themes")).unionByName(unknown.groupBy("slug").agg(F.concat(F.lit("unknown: "), F.count("*")).alias("themes")))


def _formal(spark, sf_dir):
    return _stages(spark, sf_dir).filter("stage NOT IN ('candidate', 'archived')").select("slug")


def f_quality_issues(spark, sf_dir):
    return pl.quality_issues(_payloads(spark, sf_dir), _formal(spark, sf_dir))


def f_readiness(spark, sf_dir):
    issues = f_quality_issues(spark, sf_dir).filter("code = 'CLAIM_WITHOUT_PUBLIC_EVIDENCE'")
    return pl.readiness(issues, f_recovered(spark, sf_dir), _formal(spark, sf_dir), _formal(spark, sf_dir).filter("slug <> 'c3'"))


def f_delta(spark, sf_dir):
    """Groups of fields that changed between two editions, without one kind of concept's earlier edition."""
    before = _payloads(spark, sf_dir).fields.filter("slug NOT LIKE '%1'")
    return pl.delta(before, _payloads(spark, sf_dir, 3).fields).withColumn("categories", F.array_join("categories", ","))


QUERIES = {f.__name__: f for f in (
    f_rules, f_evidence, f_bound_claims, f_reviews, f_history, f_maintained, f_recovered, f_projected, f_publish_current, f_last_good, f_merged, f_merge_conflicts, f_survivors, f_extracted, f_normalised, f_batch_rules, f_themes,
    f_quality_issues, f_readiness, f_delta,
)}


def _in(values):
    return "(" + ", ".join(map(repr, values)) + ")"


REVISIONS = "rv AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders)"
RECOVERED = f"""{REVISIONS}, rg AS (SELECT o_custkey AS slug, max(revision) AS last, arg_max(o_orderstatus, revision) = 'F' AS valid, max(revision) FILTER (WHERE o_orderstatus = 'F') AS good FROM rv GROUP BY 1),
rr AS (SELECT slug, CASE WHEN valid THEN 'healthy' WHEN good IS NOT NULL THEN 'recovered' ELSE 'corrupt' END AS status, CASE WHEN valid THEN last ELSE good END AS revision FROM rg)"""
FULL = "fu AS (SELECT DISTINCT slug, field FROM fi WHERE trim(value) <> '')"
PARTS = """SELECT slug, 'claim' AS part, key AS item, '' AS said FROM c2 UNION ALL SELECT slug, 'evidence', url, coalesce((SELECT string_agg(k, ' ' ORDER BY k) FROM (SELECT unnest(supports) AS k)), '') FROM e2
UNION ALL SELECT slug, 'citation', field, string_agg(DISTINCT url, ' ' ORDER BY url) FROM i2 GROUP BY slug, field UNION ALL SELECT slug, 'relation', type || ' ' || target, string_agg(DISTINCT url, ' ' ORDER BY url) FROM r2 GROUP BY slug, type, target"""
PUBLISHED = """pu AS (SELECT url FROM art WHERE publish_decision = 'publish'), s2 AS (SELECT DISTINCT su.slug, su.url, su.key FROM su JOIN pu USING (url) JOIN cl ON su.slug = cl.slug AND su.key = cl.key),
c2 AS (SELECT * FROM cl WHERE (slug, key) IN (SELECT slug, key FROM s2)), e2 AS (SELECT slug, url, any_value(ev.source_layer) AS source_layer, list(DISTINCT s2.key) AS supports FROM s2 JOIN ev USING (slug, url) GROUP BY ALL),
ok AS (SELECT DISTINCT slug, url FROM s2), i2 AS (SELECT ci.* FROM ci JOIN ok USING (slug, url)), r2 AS (SELECT re.* FROM re JOIN ok USING (slug, url))"""
QUALITY = f"""fo AS (SELECT slug FROM st WHERE stage NOT IN ('candidate', 'archived')), pe AS (SELECT ev.* FROM ev JOIN fo USING (slug) WHERE decision = 'publish'), ps AS (SELECT DISTINCT slug, unnest(supports) AS key FROM pe), fc AS (SELECT DISTINCT cl.slug, key FROM cl JOIN fo USING (slug)),
ic AS (SELECT DISTINCT ci.slug, field, source_layer FROM ci JOIN pe USING (slug, url)), tf AS (SELECT slug, unnest({list(pl.TEXT_FIELDS)}) AS field FROM fo), dp AS (SELECT slug, unnest({list(pl.DEPTH)}) AS field FROM fo), cf AS (SELECT slug, unnest({list(pl.CITED)}) AS field FROM fo),
qi AS (SELECT slug, 'NO_PUBLIC_PUBLISH_EVIDENCE' AS code, '' AS item FROM fo WHERE slug NOT IN (SELECT slug FROM pe) UNION ALL SELECT slug, 'NO_PUBLIC_CLAIMS', '' FROM fo WHERE slug NOT IN (SELECT slug FROM fc)
UNION ALL SELECT slug, 'CLAIM_WITHOUT_PUBLIC_EVIDENCE', key FROM fc WHERE (slug, key) NOT IN (SELECT slug, key FROM ps) UNION ALL SELECT slug, 'MISSING_PUBLIC_FIELD', field FROM tf WHERE (slug, field) NOT IN (SELECT slug, field FROM fu)
UNION ALL SELECT slug, 'MISSING_PUBLIC_CITATION', field FROM cf WHERE (slug, field) IN (SELECT slug, field FROM fu) AND (slug, field) NOT IN (SELECT slug, field FROM ic) UNION ALL SELECT slug, 'MISSING_FORMAL_ENGINEERING_DEPTH', field FROM dp WHERE (slug, field) NOT IN (SELECT slug, field FROM fu)
UNION ALL SELECT slug, 'FORMAL_DEPTH_WITHOUT_PUBLIC_CITATION', field FROM dp WHERE (slug, field) IN (SELECT slug, field FROM fu) AND (slug, field) NOT IN (SELECT slug, field FROM ic)
UNION ALL SELECT slug, 'NO_PRACTITIONER_IMPLEMENTATION_EVIDENCE', 'implementationPatterns' FROM fo WHERE slug NOT IN (SELECT slug FROM ic WHERE field = 'implementationPatterns' AND source_layer = 'practitioner'))"""
WITH = f"WITH {ART}, {_sql()}"
LED = "(length(regexp_replace({0}, '[^\\x{{00C0}}-\\x{{024F}}]', '', 'g')) >= 4 AND length(regexp_replace({0}, '[^\\x{{00C0}}-\\x{{024F}}]', '', 'g')) >= 0.05 * greatest(1, length(regexp_replace({0}, '[^\\x{{00C0}}-\\x{{024F}}A-Za-z]', '', 'g'))))"
CASES = " ".join(f"WHEN field IN {_in(names) if len(names) > 1 else f'({names[0]!r})'} THEN '{g}'" for g, names in pl.GROUPS.items())

ORACLES = {
    "f_rules": f"""{WITH}, {FULL}, kn AS (SELECT slug FROM st WHERE stage <> 'candidate'), af AS (SELECT slug, unnest(CASE WHEN stage = 'candidate' THEN {list(pl.SPARSE)} ELSE {list(pl.TEXT_FIELDS)} END) AS field FROM st),
kc AS (SELECT DISTINCT slug, key FROM cl), cb AS (SELECT DISTINCT slug, field FROM ci), ct AS (SELECT * FROM fu WHERE field IN {_in(pl.CITED)}), rl AS (SELECT DISTINCT slug, type, target FROM re),
v AS (SELECT slug, 'missing-field' AS code, field AS item FROM af WHERE (slug, field) NOT IN (SELECT slug, field FROM fu) UNION ALL SELECT slug, 'no-claims', '' FROM st WHERE slug NOT IN (SELECT slug FROM cl) UNION ALL SELECT slug, 'no-evidence', '' FROM st WHERE slug NOT IN (SELECT slug FROM ev)
UNION ALL SELECT slug, 'claim-key', key FROM cl WHERE key = 'K5' UNION ALL SELECT slug, 'claim-confidence', key FROM cl WHERE confidence > 1 UNION ALL SELECT slug, 'evidence-layer', url FROM ev WHERE source_layer = 'press' UNION ALL SELECT slug, 'evidence-stance', url FROM ev WHERE stance = 'odd'
UNION ALL SELECT slug, 'evidence-supports-nothing', url FROM ev WHERE len(supports) = 0 UNION ALL SELECT slug, 'evidence-of-unknown-claim', url || ' ' || key FROM su WHERE (slug, key) NOT IN (SELECT slug, key FROM kc) UNION ALL SELECT slug, 'claim-without-evidence', key FROM kc WHERE (slug, key) NOT IN (SELECT slug, key FROM su)
UNION ALL SELECT slug, 'citation-of-no-field', field FROM cb WHERE (slug, field) NOT IN (SELECT slug, field FROM ct) UNION ALL SELECT DISTINCT slug, 'citation-of-unknown-evidence', field || ' ' || url FROM ci WHERE (slug, url) NOT IN (SELECT slug, url FROM ev) UNION ALL SELECT slug, 'field-not-cited', field FROM ct WHERE (slug, field) NOT IN (SELECT slug, field FROM cb)
UNION ALL SELECT slug, 'relation-type', target FROM rl WHERE type = 'uses' UNION ALL SELECT slug, 'relation-target', target FROM rl WHERE target = slug OR target NOT IN (SELECT slug FROM kn))
SELECT code, count(*) AS n, count(DISTINCT slug) AS concepts, min(slug || ' ' || item) AS first FROM v GROUP BY 1""",
    "f_evidence": f"""{WITH} SELECT ev.slug, ev.url, a.source_layer, a.independent_group AS grp, CASE WHEN a.url IS NULL THEN NULL WHEN ev.stance = 'odd' THEN 'context' ELSE ev.stance END AS stance, a.publish_decision AS decision, coalesce(a.published_at, a.discovered_at) AS published_at, a.engagement_count AS engagement
FROM ev LEFT JOIN (SELECT * FROM art WHERE doc_id % 7 <> 0 AND publish_decision <> 'reject') a ON ev.url = a.url""",
    "f_bound_claims": f"{WITH}, n AS (SELECT slug, key, count(*) AS c, min(url) AS u FROM su GROUP BY ALL) SELECT cl.slug, cl.key, least(confidence, 1.0) AS confidence, coalesce(c, 0) AS n_urls, u AS first_url, c IS NULL AS unbound FROM cl LEFT JOIN n ON cl.slug = n.slug AND cl.key = n.key",
    "f_reviews": f"""{WITH}, g AS (SELECT slug, count(DISTINCT grp) FILTER (WHERE decision = 'publish' AND stance = 'support') AS g, count(*) FILTER (WHERE decision = 'publish' AND stance = 'conflict') AS c FROM ev GROUP BY 1), m AS (SELECT slug, round(avg(confidence), 3) AS confidence FROM cl GROUP BY 1),
r AS (SELECT st.slug, coalesce(confidence, 0) AS confidence, concat_ws(',', CASE WHEN stage = 'contested' OR c > 0 THEN 'conflict' END, CASE WHEN coalesce(g, 0) < 2 THEN 'few-groups' END, CASE WHEN stage = 'candidate' THEN 'candidate' END) AS reasons FROM st LEFT JOIN g USING (slug) LEFT JOIN m USING (slug))
SELECT slug, confidence, reasons <> '' AS needs_review, reasons FROM r""",
    "f_history": f"WITH {REVISIONS} SELECT o_custkey AS slug, revision, row_number() OVER (PARTITION BY o_custkey ORDER BY revision DESC) AS place, o_orderkey FROM rv QUALIFY place <= 3",
    "f_maintained": f"""WITH {ART}, used AS (SELECT * FROM art WHERE publish_decision = 'publish'), {CONCEPT_HEAT.replace("used AS (SELECT * FROM art WHERE publish_decision IN ('publish', 'watch')),", "").strip()},
s AS (SELECT concept_slug, CAST(substr(concept_slug, 2) AS INT) AS k, count(*) FILTER (WHERE publish_decision <> 'reject') AS alive, count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support') AS g,
  count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support' AND source_layer = 'official') AS o, count(DISTINCT independent_group) FILTER (WHERE publish_decision = 'publish' AND stance = 'support' AND source_layer = 'practitioner') AS p,
  count(*) FILTER (WHERE publish_decision = 'publish' AND stance = 'conflict') AS c, max(published_at) FILTER (WHERE publish_decision = 'publish') AS newest FROM art GROUP BY 1),
b AS (SELECT *, k % 3 <> 0 AND g >= 2 AND o + p > 0 AS base, CASE WHEN k % 11 = 0 THEN 'archived' WHEN k % 5 = 0 THEN 'validated' ELSE 'emerging' END AS cur, coalesce(floor((epoch({AS_OF_SQL}) - epoch(newest)) / 86400), 99999) AS idle FROM s)
SELECT concept_slug, cur AS before, CASE WHEN cur = 'archived' OR alive = 0 THEN 'archived' WHEN base AND c > 0 THEN 'contested' WHEN cur = 'validated' AND idle > 180 THEN 'cooling' WHEN NOT base THEN 'candidate' WHEN g >= 3 AND p >= 1 THEN 'validated' ELSE 'emerging' END AS stage,
  CASE WHEN k % 3 <> 0 THEN 50 ELSE 0 END + least(25, o * 25) + least(25, p * 25) AS maturity, coalesce(heat, 0) AS heat FROM b LEFT JOIN cheat USING (concept_slug)""",
    "f_recovered": f"WITH {RECOVERED} SELECT * FROM rr",
    "f_projected": f"""{WITH}, ok AS (SELECT DISTINCT ev.slug, ev.url FROM ev JOIN art USING (url) JOIN st ON ev.slug = st.slug WHERE (decision = 'publish' OR (stage IN ('candidate', 'archived') AND decision = 'watch')) AND (publish_decision = 'publish' OR (stage IN ('candidate', 'archived') AND publish_decision = 'watch'))),
e2 AS (SELECT ev.* FROM ev JOIN ok USING (slug, url)), c2 AS (SELECT * FROM cl WHERE (slug, key) IN (SELECT su.slug, su.key FROM su JOIN ok USING (slug, url))), i2 AS (SELECT ci.* FROM ci JOIN ok USING (slug, url)), r2 AS (SELECT re.* FROM re JOIN ok USING (slug, url)) {PARTS}""",
    "f_publish_current": f"{WITH}, {PUBLISHED} {PARTS}",
    "f_last_good": f"""{WITH}, {_sql(3, 'o')}, {PUBLISHED}, pr AS (SELECT slug, url, bool_or(source_layer = 'practitioner') AS pra FROM e2 GROUP BY ALL),
nu AS (SELECT slug, field, list(DISTINCT url) AS u, list(DISTINCT url) FILTER (WHERE pra) AS w FROM ci JOIN pr USING (slug, url) GROUP BY ALL), ou AS (SELECT slug, field, list(DISTINCT url) AS u, list(DISTINCT url) FILTER (WHERE pra) AS w FROM oci JOIN pr USING (slug, url) GROUP BY ALL),
x AS (SELECT f.slug, f.field, f.value AS nv, g.value AS ov, nu.u AS nuu, nu.w AS nw, ou.u AS ouu, ou.w AS ow FROM fi f LEFT JOIN nu ON f.slug = nu.slug AND f.field = nu.field LEFT JOIN (SELECT * FROM ofi WHERE trim(value) <> '') g ON f.slug = g.slug AND f.field = g.field LEFT JOIN ou ON g.slug = ou.slug AND g.field = ou.field
  WHERE trim(f.value) <> '' AND f.field IN {_in(pl.CITED)}), y AS (SELECT *, nuu IS NULL AND ov IS NOT NULL AND ouu IS NOT NULL AS back, field = 'implementationPatterns' AND nw IS NULL AND ov IS NOT NULL AND ow IS NOT NULL AS prac FROM x)
SELECT slug, field, CASE WHEN back OR prac THEN ov ELSE nv END AS value, coalesce(array_to_string(list_sort(CASE WHEN prac THEN ow WHEN back THEN ouu ELSE nuu END), ' '), '') AS urls, CASE WHEN back OR prac THEN 'old' ELSE 'new' END AS kept FROM y""",
    "f_merge_conflicts": f"{WITH}, {_sql(3, 'o')} SELECT DISTINCT cl.slug, cl.key FROM cl JOIN ocl ON cl.slug = ocl.slug AND cl.key = ocl.key WHERE trim(cl.text) <> trim(ocl.text) OR cl.kind <> ocl.kind",
    "f_merged": f"""{WITH}, {_sql(3, 'o')}, pf AS (SELECT slug, unnest(['definition', 'aliases', 'mechanism', 'tradeoffs', 'evolution']) AS field FROM sl), chg AS (SELECT ofi.* FROM ofi JOIN pf USING (slug, field) WHERE field <> 'aliases'),
un AS (SELECT slug, field, array_to_string(list_sort(list_distinct(list(value))), chr(10)) AS value FROM (SELECT * FROM fi UNION ALL SELECT * FROM ofi) WHERE field IN ('aliases', 'themes') GROUP BY ALL),
f2 AS (SELECT * FROM fi WHERE field NOT IN ('aliases', 'themes') AND (slug, field) NOT IN (SELECT slug, field FROM chg) UNION ALL SELECT * FROM chg UNION ALL SELECT * FROM un), same AS (SELECT coalesce(a.slug, b.slug) AS slug, coalesce(a.field, b.field) AS field FROM fi a FULL JOIN f2 b ON a.slug = b.slug AND a.field = b.field WHERE a.value IS NOT DISTINCT FROM b.value),
c2 AS (SELECT slug, key FROM cl UNION SELECT slug, key FROM ocl), e2 AS (SELECT slug, url, list_distinct(flatten(list(supports))) AS supports FROM (SELECT slug, url, supports FROM ev UNION ALL SELECT slug, url, supports FROM oev) GROUP BY ALL),
i2 AS (SELECT ci.* FROM ci JOIN same USING (slug, field) UNION ALL SELECT oci.* FROM oci JOIN pf USING (slug, field))
SELECT slug, 'claim' AS part, key AS item, '' AS said FROM c2 UNION ALL SELECT slug, 'evidence', url, coalesce((SELECT string_agg(k, ' ' ORDER BY k) FROM (SELECT unnest(supports) AS k)), '') FROM e2
UNION ALL SELECT slug, 'citation', field, string_agg(DISTINCT url, ' ' ORDER BY url) FROM i2 GROUP BY slug, field UNION ALL SELECT slug, 'field', field, value FROM f2""",
    "f_survivors": f"""{WITH}, mg AS (SELECT slug AS old, 'c' || (n - 1) AS new FROM sl WHERE n % 4 = 3), mv AS (SELECT sl.slug AS origin, coalesce(new, slug) AS slug, new IS NULL AS own FROM sl LEFT JOIN mg ON sl.slug = mg.old),
f1 AS (SELECT origin, mv.slug, own, field, value FROM fi JOIN mv ON fi.slug = origin), li AS (SELECT slug, field, value FROM f1 WHERE field IN {_in(pl.ARRAY_FIELDS)} UNION ALL SELECT slug, 'aliases', unnest([value, origin]) FROM f1 WHERE NOT own AND field = 'canonicalName'),
f2 AS (SELECT slug, field, value FROM f1 WHERE own AND field NOT IN {_in(pl.ARRAY_FIELDS)} UNION ALL SELECT slug, field, coalesce(array_to_string(list_sort(list_distinct(list(value) FILTER (WHERE value <> ''))), chr(10)), '') FROM li GROUP BY ALL),
c2 AS (SELECT DISTINCT mv.slug, key FROM cl JOIN mv ON cl.slug = origin), e1 AS (SELECT mv.slug, url, supports, CASE stance WHEN 'conflict' THEN 3 WHEN 'support' THEN 2 WHEN 'context' THEN 1 ELSE 0 END AS w, stance FROM ev JOIN mv ON ev.slug = origin),
e2 AS (SELECT slug, url, arg_max(stance, w) AS stance, list_distinct(flatten(list(supports))) AS supports FROM e1 GROUP BY ALL), i2 AS (SELECT mv.slug, ci.field, ci.url FROM ci JOIN mv ON ci.slug = origin LEFT JOIN fi s ON s.slug = origin AND s.field = ci.field LEFT JOIN (SELECT * FROM f1 WHERE own AND field NOT IN {_in(pl.ARRAY_FIELDS)}) t ON t.slug = mv.slug AND t.field = ci.field
  WHERE own IS NOT DISTINCT FROM true OR ci.field IN {_in(pl.ARRAY_FIELDS)} OR s.value IS NOT DISTINCT FROM t.value), r2 AS (SELECT mv.slug, type, coalesce(new, target) AS target, url FROM re JOIN mv ON re.slug = origin LEFT JOIN mg ON target = mg.old WHERE coalesce(new, target) <> mv.slug)
{PARTS} UNION ALL SELECT slug, 'stance', stance, count(*)::VARCHAR FROM e2 GROUP BY ALL UNION ALL SELECT slug, 'field', field, value FROM f2""".replace("WHERE own IS NOT DISTINCT FROM true", "WHERE mv.own"),
    "f_extracted": f"""WITH {ART}, o AS (SELECT *, unnest(range(1, (doc_id % 5 + 2)::INT)) AS i FROM art), p AS (SELECT *, 'con-' || ((doc_id + i) % 40) AS slug, trim(substr(text, 1, 200)) AS def FROM o WHERE i <= 3 AND (doc_id + i) % 6 <> 0),
s AS (SELECT * FROM p WHERE {LED.format('def')}), m AS (SELECT *, unnest(range(1, least(8, doc_id % 11 + 1)::INT + 1)) AS j FROM s), k AS (SELECT *, 'àéîõü ' || j AS t FROM m WHERE (doc_id + j) % 3 <> 0),
c AS (SELECT slug, url, source_layer, 'key-' || j || '-' || substr(sha256(url || chr(10) || t), 1, 10) AS key, t, CASE WHEN j % 2 = 0 THEN 'pattern' ELSE 'mechanism' END AS kind, least(1.0, j / 4) AS confidence FROM k)
SELECT slug, 'claim' AS part, key AS item, t || ' ' || kind || ' ' || confidence::DOUBLE AS said FROM c UNION ALL SELECT slug, 'evidence', url, CASE WHEN source_layer = 'community' THEN 'context' ELSE 'support' END || ' ' || count(*) FROM c GROUP BY slug, url, source_layer
UNION ALL SELECT slug, unnest(['citation', 'citation']), unnest(['definition', 'dailyDelta']), count(DISTINCT url)::VARCHAR FROM c GROUP BY slug""",
    "f_normalised": f"""{WITH}, {FULL}, it AS (SELECT * FROM art WHERE doc_id % 17 <> 0), ow AS (SELECT slug, min(url) AS url FROM ev GROUP BY 1), ks AS (SELECT slug, list(DISTINCT key) AS keys FROM cl GROUP BY 1), c2 AS (SELECT * FROM cl),
x AS (SELECT ev.slug, ev.url, list_intersect(supports, keys) AS sm, keys, ow.url IS NOT NULL AS own FROM ev LEFT JOIN ks USING (slug) LEFT JOIN ow ON ev.slug = ow.slug AND ev.url = ow.url), e2 AS (SELECT slug, url, CASE WHEN len(sm) = 0 AND own THEN keys ELSE sm END AS supports FROM x),
cb AS (SELECT * FROM fu WHERE field IN {_in(pl.CITED)}), i1 AS (SELECT ci.* FROM ci JOIN cb USING (slug, field)), i2 AS (SELECT * FROM i1 UNION ALL SELECT slug, field, url FROM cb JOIN ow USING (slug) WHERE (slug, field) NOT IN (SELECT slug, field FROM i1)),
bad AS (SELECT slug, type, target FROM re WHERE url NOT IN (SELECT url FROM it)), r2 AS (SELECT * FROM re WHERE type <> 'uses' AND target <> slug AND target IN (SELECT slug FROM st WHERE stage <> 'candidate') AND (slug, type, target) NOT IN (SELECT * FROM bad)) {PARTS}""",
    "f_batch_rules": f"""WITH {ART}, o AS (SELECT url, doc_id, unnest(range(1, (doc_id % 10 + 2)::INT)) AS j FROM art), s AS (SELECT *, 's' || CASE WHEN doc_id % 6 = 0 THEN j % 4 ELSE j END AS slug FROM o), w AS (SELECT * FROM s WHERE (doc_id + j) % 7 <> 0)
SELECT url, 'too-many' AS code, count(*)::VARCHAR AS item FROM s GROUP BY url HAVING count(*) > 8 UNION ALL SELECT url, 'twice', slug FROM s GROUP BY url, slug HAVING count(*) > 1
UNION ALL SELECT DISTINCT url, 'item-not-evidence', slug FROM s WHERE (url, slug) NOT IN (SELECT url, slug FROM w) UNION ALL SELECT DISTINCT url, 'renamed', slug FROM w WHERE (doc_id + j) % 5 = 0""",
    "f_themes": """WITH l AS (SELECT p_brand AS slug, p_partkey AS place, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE nullif(lower(p_type), 'promo') END AS theme FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT slug, theme, min(place) AS place FROM l WHERE theme IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY place) AS n FROM f QUALIFY n <= 6), g AS (SELECT slug, string_agg(theme, ',' ORDER BY n) AS themes FROM r GROUP BY 1)
SELECT slug, coalesce(themes, 'standard') AS themes FROM (SELECT DISTINCT slug FROM l) LEFT JOIN g USING (slug) UNION ALL SELECT slug, 'unknown: ' || count(*) FROM l WHERE theme IS NULL GROUP BY 1""",
    "f_quality_issues": f"{WITH}, {FULL}, {QUALITY} SELECT * FROM qi",
    "f_readiness": f"""{WITH}, {FULL}, {QUALITY}, {RECOVERED}, a AS (SELECT slug FROM qi WHERE code = 'CLAIM_WITHOUT_PUBLIC_EVIDENCE' UNION ALL SELECT slug FROM fo WHERE slug = 'c3'), b AS (SELECT count(*) AS issues, count(DISTINCT slug) AS failing FROM a),
c AS (SELECT count(*) FILTER (WHERE status = 'corrupt') AS corrupt, count(*) FILTER (WHERE status = 'recovered') AS recovered FROM rr)
SELECT CASE WHEN corrupt > 0 OR failing > 0 THEN 'not-ready' WHEN recovered > 0 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN corrupt > 0 THEN 'corrupt' WHEN recovered > 0 THEN 'recovered' ELSE 'healthy' END AS recovery, issues, failing, corrupt, recovered FROM b, c""",
    "f_delta": f"""{WITH}, {_sql(3, 'o')}, be AS (SELECT * FROM fi WHERE slug NOT LIKE '%1'), ch AS (SELECT coalesce(a.slug, b.slug) AS slug, coalesce(a.field, b.field) AS field FROM be a FULL JOIN ofi b ON a.slug = b.slug AND a.field = b.field WHERE a.value IS DISTINCT FROM b.value),
g AS (SELECT slug, list_sort(list(DISTINCT CASE {CASES} END) FILTER (WHERE CASE {CASES} END IS NOT NULL)) AS f FROM ch GROUP BY 1)
SELECT x.slug, array_to_string(CASE WHEN x.slug LIKE '%1' THEN ['created', 'definition', 'mechanism'] ELSE coalesce(f, []) END, ',') AS categories, x.slug LIKE '%1' OR coalesce(len(f), 0) > 0 AS material FROM (SELECT DISTINCT slug FROM ofi) x LEFT JOIN g ON x.slug = g.slug""",
}
