"""Queries over discovery scores, rules, contracts, queues and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import scoring as sc
from tidemark.operators import selection as se
from tidemark.plans.article_queries import AGE_S, EVENT, NEGATIVE, STRONG, WEAK, _has
from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of
from tidemark.sources import catalog as ct

#: Test lexicons and rules for the invented prose.
SURFACE, CONTROL, CONTEXT = ["thth", "ing and"], ["that", "with", "this", "from"], ["the"]
RULES = [("first", ["ering", "ung"]), ("second", ["ndnt", "edst"]), ("third", ["eaux", "heed", "tion"])]
CASES = [("late", "(?i)thth"), ("early", "ung|eaux"), ("middle", "edst")]
WORDS = ["ering", "ndnts", "edst", "tions", "the", "ung", "eaux", "heed", "that", "withs", "this", "from", "ion", "and"]
GENERIC = (r"(?i)(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])", r"(?i)ing|and")
ACCENTED, ODD = r"[\x{00C0}-\x{024F}]", r"[|]"
LEAST = {"title": (2, 0.02), "text": (8, 0.05)}


def _mechanism():
    return se.mechanism_score(F.col("text"), F.col("source_layer"), F.col("source_family"), SURFACE, CONTROL, CONTEXT)


def c_mechanism(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", _mechanism().alias("score"))


def c_relevance_whole(spark, sf_dir):
    """Relevance with its fallback to mechanisms and the rule for generic titles."""
    score = sc.lexicon_relevance(F.col("text"), F.col("title"), F.col("source_family") == "official", STRONG, WEAK, NEGATIVE, _mechanism(), GENERIC)
    return articles(spark, sf_dir).select("doc_id", score.cast("long").alias("relevance"))


def c_new_urls(spark, sf_dir):
    art = articles(spark, sf_dir).select("doc_id", "url", "publish_decision")
    arriving = art.filter("doc_id % 2 = 0").select("url", F.col("doc_id").alias("position"))
    return se.new_items(arriving.unionByName(arriving.withColumn("position", F.col("position") - 3)), art.filter("doc_id % 3 = 0"), "position").select("url", "position")


def c_concept(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", se.best_rule(F.col("text"), RULES, "none").alias("concept"))


def c_cases(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", se.first_case(F.col("text"), CASES, "other").alias("topic"))


def c_tag_list(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", F.array_join(se.tags(F.col("text"), F.col("concept_slug"), WORDS), ",").alias("tags"))


def _titled(spark, sf_dir):
    """Articles of which some have a version for a title, and some no excerpt."""
    d = F.col("doc_id")
    title = F.when(d % 4 == 0, F.concat(F.lit("v1."), d.cast("string"), F.lit(" "), "title")).when(d % 4 == 1, F.concat(F.lit("Release a-b=="), "title")).otherwise(F.col("title"))
    return articles(spark, sf_dir).withColumns({"title": title, "source": F.concat("source_id", F.when(d % 3 == 0, " Releases").otherwise("")), "excerpt": F.when(d % 5 != 0, F.substring("text", 1, 700)), "body": F.when(d % 10 != 0, F.col("text"))})


def c_fallbacks(spark, sf_dir):
    title = se.fallback_title(F.col("title"), F.col("source"))
    return _titled(spark, sf_dir).select("doc_id", title.alias("title"), se.fallback_summary(F.col("excerpt"), F.col("body"), F.col("source"), F.col("title")).alias("summary"))


def c_event_key(spark, sf_dir):
    title = F.when(F.col("doc_id") % 9 == 0, "v1.2.3 — ü").otherwise(F.col("title"))
    return _titled(spark, sf_dir).select("doc_id", se.event_key(F.col("concept_slug"), title).alias("event_key"))


def _pick(key, *values):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(key, *values):
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


A_TOPIC, A_STAGE, A_ACCENT, A_DECISION = ("工程", "产品", "odd"), ("Spark", "Cooling", "odd", None), ("signal", "odd"), ("publish", "watch", "later", "reject", None)
A_SLUG, A_SCORE = ("a-b", "A_b", "ok-slug", "x"), ("55", "101", "-1", "77.5", "x", None)


def c_analysis_contract(spark, sf_dir):
    d = F.col("doc_id")
    body = F.struct(
        F.when(d % 11 != 0, F.col("title")).alias("title"), F.when(d % 13 != 0, F.substring("text", 1, 600)).alias("summary"), F.lit("means this").alias("implication"), _pick(d, *A_TOPIC).alias("topic"), _pick(d, *A_STAGE).alias("stage"),
        _pick(d, *A_ACCENT).alias("accent"), _pick(d, *A_DECISION).alias("publishDecision"), _pick(d, *A_SLUG).alias("conceptSlug"), *[_pick(d + i, *A_SCORE).alias(c) for i, c in enumerate(se.SCORES)], F.when(d % 4 != 0, F.array(F.lit("one"), F.lit(" "), F.repeat(F.lit("y"), 50))).alias("tags"),
    )
    fallback = F.struct(F.lit("概念").alias("topic"), F.lit("Emerging").alias("stage"), F.lit("conflict").alias("accent"), F.lit("reject").alias("publishDecision"), F.lit("rule-slug").alias("conceptSlug"), F.array(F.lit("rule")).alias("tags"), *[F.lit(7 + i).alias(c) for i, c in enumerate(se.SCORES)])
    rows = articles(spark, sf_dir).select(d.alias("id"), F.when(d % 17 == 0, "no json").otherwise(F.to_json(body)).alias("body"), fallback.alias("fallback"))
    done = se.checked_analyses(rows).filter("rejected IS NULL OR id % 2 = 0")
    fields = ["title", "summary", "topic", "stage", "accent", "publishDecision", "conceptSlug", *se.SCORES]
    return done.select("id", "rejected", *[F.when(F.col("rejected").isNull(), F.col(c)).alias(c) for c in fields], F.when(F.col("rejected").isNull(), F.array_join("tags", ",")).alias("tags"), F.array_join("repairs", ",").alias("repairs"))


def c_script_gate(spark, sf_dir):
    issue = tx.editorial_issue({"title": F.col("title"), "text": F.col("text")}, LEAST, ACCENTED, ODD)
    return articles(spark, sf_dir).select("doc_id", issue.alias("issue"))


def c_field_gate(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", tx.led_by(F.col("text"), ACCENTED, 4, 0.05).alias("led"))


def _backlog(spark, sf_dir):
    issue = tx.editorial_issue({"title": F.col("title")}, {"title": (1, 0.0)}, ACCENTED, None)
    items = articles(spark, sf_dir).filter("publish_decision = 'publish'").withColumn("issue", issue)
    return se.backlog(items, F.col("issue").isNull(), F.col("issue"))


def c_backlog(spark, sf_dir):
    return _backlog(spark, sf_dir)[0].select("doc_id", "reason")


def c_backlog_gate(spark, sf_dir):
    return _backlog(spark, sf_dir)[1]


def _explored(spark, sf_dir):
    return articles(spark, sf_dir).withColumns({"relevance": F.col("relevance_score"), "exploring": F.col("doc_id") % 6 == 0, "candidate_concept": F.when(F.col("doc_id") % 4 == 0, " ").when(F.col("doc_id") % 4 == 1, F.col("concept_slug"))})


def c_discovered(spark, sf_dir):
    return se.discovered(_explored(spark, sf_dir), 7).limit(40).select("doc_id", "relevance")


def c_demoted(spark, sf_dir):
    return _explored(spark, sf_dir).select("doc_id", se.demoted(F.col("publish_decision"), F.col("exploring"), F.col("relevance")).alias("decision"))


def c_watched(spark, sf_dir):
    return se.watched_candidates(_explored(spark, sf_dir)).select("doc_id")


VERSION, ANALYZER = 3, "a-2"


def _work(spark, sf_dir):
    """(items, attempts, leases): published and watched items, attempts on two of three, leases on some."""
    d = F.col("doc_id")
    roles = ct.known_roles(F.when(d % 2 == 0, F.array(F.lit("interview"), F.lit("essay"))))
    art = articles(spark, sf_dir).select("doc_id", "url", "publish_decision", F.sha2("text", 256).alias("content_hash"), "published_at", "discovered_at", roles.alias("roles"))
    items = art.withColumn("contract_hash", se.input_contract(F.col("content_hash"), F.col("roles")))
    attempts = items.filter("doc_id % 3 <> 0").select(
        "url", F.when(d % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(d % 7 == 0, "old").otherwise(F.col("contract_hash")).alias("contract_hash"), F.when(d % 11 == 0, VERSION - 1).otherwise(VERSION).alias("schema_version"), F.lit(ANALYZER).alias("analyzer"),
        _pick(d, "completed", "completed", "completed", "failed", "conflict", "running").alias("status"), F.coalesce("published_at", "discovered_at").alias("attempted_at"),
    )
    leases = items.filter("doc_id % 4 = 0").select("url", F.when(d % 8 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(d % 12 == 0, F.timestamp_add("DAY", F.lit(-1), as_of())).otherwise(F.timestamp_add("DAY", F.lit(1), as_of())).alias("expires_at"))
    return items, attempts, leases


def _retries(spark, sf_dir, limit):
    items, attempts, leases = _work(spark, sf_dir)
    return se.retry_queue(items, attempts, leases, items.filter("doc_id % 10 = 1"), as_of(), VERSION, ANALYZER, limit)


def c_retry_queue(spark, sf_dir):
    return _retries(spark, sf_dir, 200).select("doc_id", "fresh")


def c_budget(spark, sf_dir):
    items, _, _ = _work(spark, sf_dir)
    new = items.filter("doc_id % 12 = 5").select("url", F.col("doc_id").alias("place")).orderBy("place").limit(17)
    retries = _retries(spark, sf_dir, 30).select("url", F.col("doc_id").alias("place"))
    return se.within_budget(new, retries)


def c_backfill(spark, sf_dir):
    items, attempts, _ = _work(spark, sf_dir)
    return se.backfill_queue(items, attempts, VERSION, ANALYZER, 300).select("doc_id", "rank")


def c_pending(spark, sf_dir):
    items, attempts, _ = _work(spark, sf_dir)
    return se.pending(items, attempts, VERSION, ANALYZER).groupBy("publish_decision").agg(F.count("*").alias("pending"))


def c_input_contract(spark, sf_dir):
    return _work(spark, sf_dir)[0].select("doc_id", "contract_hash")


def c_listed(spark, sf_dir):
    items, _, _ = _work(spark, sf_dir)
    asked = items.filter("doc_id % 6 = 0").select("url", (1000000 - F.col("doc_id")).alias("place"))
    return se.listed_in_order(items, asked.unionByName(asked.withColumn("place", F.col("place") + 5))).select("doc_id", "place")


TOPIC_CASES, STAGE_CASES = [("迁移", "(?i)eaux"), ("产品", "ndnt"), ("概念", "(?i)^the")], [("Validated", "edst"), ("Emerging", "ering|ung")]


def c_rules_whole(spark, sf_dir):
    done = se.rule_analysis(articles(spark, sf_dir), RULES, "none", TOPIC_CASES, STAGE_CASES, WORDS, "迁移")
    return done.withColumn("tags", F.array_join("tags", ","))


MOVES = se.TopicRules(("迁移", "(?i)eaux|thth"), "status", [("工程", "ndnt|tions"), ("产品", "(?i)ering")], ("概念", ("second", "third")), "工程")
SOURCE_CLASS = "CASE WHEN doc_id % 3 = 0 THEN 'status' ELSE 'news' END"


def c_topic_rules(spark, sf_dir):
    """Topic and stage by title, class of the source, text and concept."""
    done = se.rule_analysis(articles(spark, sf_dir).withColumn("source_class", F.expr(SOURCE_CLASS)), RULES, "none", [], STAGE_CASES, WORDS, "迁移", MOVES)
    return done.select("doc_id", "concept", "topic", "stage", "editorial")


QUERIES = {f.__name__: f for f in (
    c_topic_rules, c_rules_whole, c_mechanism, c_relevance_whole, c_new_urls, c_concept, c_cases, c_tag_list, c_fallbacks, c_event_key, c_analysis_contract, c_script_gate, c_field_gate, c_backlog, c_backlog_gate, c_discovered,
    c_demoted, c_watched, c_retry_queue, c_budget, c_backfill, c_pending, c_input_contract, c_listed,
)}

LOW, LOW_TITLE = "lower(text)", "lower(title)"
MECHANISM = f"""CASE WHEN (source_layer IN ('official', 'practitioner') OR source_family IN ('official', 'practitioner')) AND {_has(LOW, SURFACE)} >= 1 AND {_has(LOW, CONTROL)} >= 2 AND {_has(LOW, CONTEXT)} > 0
  THEN least(8, 3 + least(2, {_has(LOW, SURFACE)} - 1) + least(3, {_has(LOW, CONTROL)} - 2)) ELSE 0 END"""


def _flat(text: str, most: int) -> str:
    return f"(SELECT CASE WHEN length(f) > {most} THEN rtrim(substr(f, 1, {most - 1})) || '…' ELSE f END FROM (SELECT trim(regexp_replace({text}, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')) AS f))"


HITS = [_has(LOW, terms) for _, terms in RULES]
T_TITLE = "CASE doc_id % 4 WHEN 0 THEN 'v1.' || doc_id || ' ' || title WHEN 1 THEN 'Release a-b==' || title ELSE title END"
TITLED = f"t AS (SELECT doc_id, concept_slug, {T_TITLE} AS title, source_id || CASE WHEN doc_id % 3 = 0 THEN ' Releases' ELSE '' END AS source, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 700) END AS excerpt, CASE WHEN doc_id % 10 <> 0 THEN text END AS body FROM art)"


def _letters(text: str, kind: str) -> str:
    return f"length(regexp_replace({text}, '[^{kind}]', '', 'g'))"


def _issue(field: str, least: tuple[int, float]) -> str:
    own, letters = _letters(field, r"\x{00C0}-\x{024F}"), _letters(field, r"\p{L}")
    return f"CASE WHEN contains({field}, '|') THEN '{field}:foreign' WHEN {own} < {least[0]} THEN '{field}:too-few' WHEN {own} < {least[1]} * {letters} THEN '{field}:too-thin' END"


CONTRACT = """'{"contentHash":"' || sha256(text) || '","contentRoles":[' || CASE WHEN doc_id % 2 = 0 THEN '"interview"' ELSE '' END || ']}'"""
WORK = f"""w AS (SELECT doc_id, url, publish_decision, discovered_at, doc_id % 3 <> 0 AS tried, {_sql_pick('doc_id', 'completed', 'completed', 'completed', 'failed', 'conflict', 'running')} AS status, coalesce(published_at, discovered_at) AS attempted_at FROM art),
s AS (SELECT *, tried AND status = 'completed' AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS done, NOT tried OR doc_id % 5 = 0 AS fresh, doc_id % 4 = 0 AND doc_id % 8 <> 0 AND doc_id % 12 <> 0 AS leased, CASE WHEN tried THEN attempted_at ELSE discovered_at END AS since FROM w),
q AS (SELECT * FROM s WHERE publish_decision IN ('publish', 'watch') AND NOT done AND NOT leased AND doc_id % 10 <> 1 ORDER BY fresh DESC, since, url)"""
NUMBER = r"^[+-]?\d+(\.\d+)?$"


def _score(i: int, c: str) -> str:
    x = _sql_pick(f"doc_id + {i}", *A_SCORE)
    return f"CASE WHEN rejected IS NULL THEN CASE WHEN coalesce(try_cast({x} AS DOUBLE) BETWEEN 0 AND 100, false) THEN round(try_cast({x} AS DOUBLE))::INT ELSE {7 + i} END END AS \"{c}\""


def _bad_score(i: int, c: str) -> str:
    return f"CASE WHEN NOT coalesce(try_cast({_sql_pick(f'doc_id + {i}', *A_SCORE)} AS DOUBLE) BETWEEN 0 AND 100, false) THEN '{c}' END"


def _one_of(field: str, values: tuple, allowed: tuple, fallback: str) -> tuple[str, str]:
    ok = f"coalesce({_sql_pick('doc_id', *values)} IN ({', '.join(map(repr, allowed))}), false)"
    return f"CASE WHEN rejected IS NULL THEN CASE WHEN {ok} THEN {_sql_pick('doc_id', *values)} ELSE '{fallback}' END END AS \"{field}\"", f"CASE WHEN NOT {ok} THEN '{field}' END"


ENUMS = [_one_of("topic", A_TOPIC, se.TOPICS, "概念"), _one_of("stage", A_STAGE, se.STAGES, "Emerging"), _one_of("accent", A_ACCENT, se.ACCENTS, "conflict"), _one_of("publishDecision", A_DECISION, se.DECISIONS, "reject"), _one_of("conceptSlug", A_SLUG, ("a-b", "ok-slug"), "rule-slug")]

ORACLES = {
    "c_mechanism": f"WITH {ART} SELECT doc_id, {MECHANISM} AS score FROM art",
    "c_relevance_whole": f"""WITH {ART}, s AS (SELECT *, source_family = 'official' AS trusted, {_has(LOW, STRONG)} AS s, {_has(LOW, WEAK)} AS w, {_has(LOW, NEGATIVE)} AS n, {MECHANISM} AS m, regexp_matches(title, '(?i)\\bv?\\d+\\.\\d+(\\.\\d+)?\\b') AS v FROM art)
SELECT doc_id, CASE WHEN {_has(LOW_TITLE, NEGATIVE)} > 0 OR (regexp_matches(title, '(?i)\\bthe\\b') AND NOT regexp_matches(title, '(?i)ing|and')) THEN -100 WHEN NOT trusted AND s = 0 THEN m ELSE least(100, 6 * trusted::INT + 4 * s + w - 5 * n + 2 * (trusted AND v)::INT) END AS relevance FROM s""",
    "c_new_urls": f"WITH {ART} SELECT url, doc_id - 3 AS position FROM art WHERE doc_id % 2 = 0 AND NOT (doc_id % 3 = 0 AND publish_decision IN ('publish', 'reject'))",
    "c_concept": f"WITH {ART}, h AS (SELECT doc_id, {HITS[0]} AS a, {HITS[1]} AS b, {HITS[2]} AS c FROM art) SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS concept FROM h",
    "c_cases": f"WITH {ART} SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in CASES) + " ELSE 'other' END AS topic FROM art",
    "c_tag_list": f"""WITH {ART} SELECT doc_id, array_to_string(list_filter([concept_slug, {", ".join(f"CASE WHEN contains(lower(text), '{w.removesuffix('s') if w.endswith('s') else w}') THEN '{w}' END" for w in WORDS)}], lambda x: x IS NOT NULL)[1:8], ',') AS tags FROM art""",
    "c_fallbacks": rf"""WITH {ART}, {TITLED}, f AS (SELECT *, {_flat('title', 140)} AS c FROM t)
SELECT doc_id, CASE WHEN regexp_matches(c, '(?i)^(?:v?\d+\.\d+|python-|dotnet-|release\s+[\w.-]+==)') THEN regexp_replace(source, '(?i)\s+Releases$', '') || ' · ' || c ELSE c END AS title,
  coalesce(nullif({_flat("coalesce(nullif(excerpt, ''), body, '')", 360)}, ''), source || ': ' || title) AS summary FROM f""",
    "c_event_key": rf"""WITH {ART}, {TITLED}, p AS (SELECT doc_id, concept_slug, CASE WHEN doc_id % 9 = 0 THEN 'v1.2.3 — ü' ELSE title END AS title FROM t), q AS (SELECT *, regexp_replace(lower({_flat('title', 180)}), '\bv?\d+(?:\.\d+){{1,3}}\b', ' ', 'g') AS plain FROM p),
k AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(plain, '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' '), lambda w: w <> '')[1:10], '-') AS key FROM q)
SELECT doc_id, concept_slug || ':' || CASE WHEN key <> '' THEN key ELSE substr(sha256(title), 1, 16) END AS event_key FROM k""",
    "c_analysis_contract": f"""WITH {ART}, r AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'not-json' WHEN doc_id % 11 = 0 OR trim(title) = '' THEN 'title' WHEN doc_id % 13 = 0 OR trim(substr(text, 1, 600)) = '' THEN 'summary' END AS rejected FROM art)
SELECT doc_id AS id, rejected, CASE WHEN rejected IS NULL THEN {_flat('title', 140)} END AS title, CASE WHEN rejected IS NULL THEN {_flat('substr(text, 1, 600)', 420)} END AS summary, {", ".join(a for a, _ in ENUMS)}, {", ".join(_score(i, c) for i, c in enumerate(se.SCORES))},
  CASE WHEN rejected IS NULL THEN CASE WHEN doc_id % 4 <> 0 THEN 'one,' || repeat('y', 39) || '…' ELSE 'rule' END END AS tags,
  CASE WHEN rejected IS NULL THEN concat_ws(',', {", ".join(b for _, b in ENUMS)}, CASE WHEN doc_id % 4 = 0 THEN 'tags' END, {", ".join(_bad_score(i, c) for i, c in enumerate(se.SCORES))}) END AS repairs FROM r WHERE rejected IS NULL OR doc_id % 2 = 0""",
    "c_script_gate": f"WITH {ART} SELECT doc_id, coalesce({_issue('title', LEAST['title'])}, {_issue('text', LEAST['text'])}) AS issue FROM art",
    "c_field_gate": f"""WITH {ART}, n AS (SELECT doc_id, {_letters('text', r'\x{00C0}-\x{024F}')} AS own, {_letters('text', 'A-Za-z')} AS latin FROM art) SELECT doc_id, own >= 4 AND own >= 0.05 * greatest(1, own + latin) AS led FROM n""",
    "c_backlog": f"""WITH {ART} SELECT doc_id, 'title:too-few' AS reason FROM art WHERE publish_decision = 'publish' AND {_letters('title', r'\x{00C0}-\x{024F}')} < 1 ORDER BY {EVENT} DESC, url LIMIT 5""",
    "c_backlog_gate": f"""WITH {ART} SELECT count(*) AS waiting, count(*) > 0 AS blocked FROM art WHERE publish_decision = 'publish' AND {_letters('title', r'\x{00C0}-\x{024F}')} < 1""",
    "c_discovered": f"WITH {ART} SELECT doc_id, relevance_score AS relevance FROM art WHERE relevance_score >= 7 OR doc_id % 6 = 0 ORDER BY relevance_score DESC, coalesce(published_at, TIMESTAMP '1970-01-01') DESC, url LIMIT 40",
    "c_demoted": f"WITH {ART} SELECT doc_id, CASE WHEN doc_id % 6 = 0 AND relevance_score < 3 AND publish_decision = 'publish' THEN 'watch' ELSE publish_decision END AS decision FROM art",
    "c_watched": f"WITH {ART} SELECT doc_id FROM art WHERE publish_decision = 'watch' AND relevance_score >= 3 AND (doc_id % 6 = 0 OR doc_id % 4 = 1)",
    "c_retry_queue": f"WITH {ART}, {WORK} SELECT doc_id, fresh FROM q ORDER BY fresh DESC, since, url LIMIT 200",
    "c_budget": f"""WITH {ART}, {WORK}, a AS (SELECT url, doc_id AS place FROM s WHERE doc_id % 12 = 5), n AS (SELECT * FROM a ORDER BY place LIMIT 17), f AS (SELECT url, doc_id AS place FROM q ORDER BY fresh DESC, since, q.url LIMIT 30),
g AS (SELECT * FROM f WHERE url NOT IN (SELECT url FROM n) ORDER BY place, url LIMIT 4), r AS (SELECT *, row_number() OVER (ORDER BY place, url) AS nth FROM g)
SELECT url, 'new' AS kind, place FROM n UNION ALL SELECT url, 'retry', place FROM r WHERE nth <= least(4, 20 - (SELECT count(*) FROM n))""",
    "c_backfill": f"WITH {ART}, {WORK} SELECT doc_id, CASE WHEN NOT tried THEN 0 WHEN status IN ('failed', 'conflict') THEN 1 ELSE 2 END AS rank FROM s WHERE NOT done ORDER BY rank, since, url LIMIT 300",
    "c_pending": f"WITH {ART}, {WORK} SELECT publish_decision, count(*) AS pending FROM s WHERE NOT done GROUP BY 1",
    "c_input_contract": f"WITH {ART} SELECT doc_id, sha256({CONTRACT}) AS contract_hash FROM art",
    "c_listed": "SELECT doc_id, 1000000 - doc_id AS place FROM documents WHERE doc_id % 6 = 0",
    "c_rules_whole": rf"""WITH {ART}, h AS (SELECT *, concat_ws(' ', title, substr(text, 1, 500)) AS head, {HITS[0]} AS a, {HITS[1]} AS b, {HITS[2]} AS c FROM art),
t AS (SELECT *, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS concept, CASE WHEN regexp_matches(head, '(?i)eaux') THEN '迁移' WHEN contains(head, 'ndnt') THEN '产品' WHEN regexp_matches(head, '(?i)^the') THEN '概念' ELSE '工程' END AS topic FROM h),
s AS (SELECT *, CASE WHEN topic = '迁移' THEN 'Cooling' WHEN contains(head, 'edst') THEN 'Validated' WHEN regexp_matches(head, 'ering|ung') THEN 'Emerging' ELSE 'Spark' END AS stage, least(100, round(relevance_score * 12))::INT AS relevance, CASE source_layer WHEN 'official' THEN 90 WHEN 'practitioner' THEN 70 ELSE 50 END AS evidence FROM t),
n AS (SELECT *, CASE stage WHEN 'Spark' THEN 78 WHEN 'Emerging' THEN 70 WHEN 'Cooling' THEN 35 ELSE 55 END AS novelty, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower({_flat('title', 180)}), '\bv?\d+(?:\.\d+){{1,3}}\b', ' ', 'g'), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' '), lambda w: w <> '')[1:10], '-') AS key FROM s)
SELECT doc_id, concept, topic, stage, array_to_string(list_filter([concept, {", ".join(f"CASE WHEN contains(lower(text), '{w.removesuffix('s') if w.endswith('s') else w}') THEN '{w}' END" for w in WORDS)}], lambda x: x IS NOT NULL)[1:8], ',') AS tags, relevance, evidence, novelty,
  floor((relevance * 5 + evidence * 3 + novelty * 2 + 5) / 10)::INT AS editorial, CASE WHEN relevance_score >= 5 THEN 'publish' WHEN relevance_score >= 3 THEN 'watch' ELSE 'reject' END AS decision, concept || ':' || CASE WHEN key <> '' THEN key ELSE substr(sha256(title), 1, 16) END AS event_key FROM n""",
    "c_topic_rules": rf"""WITH {ART}, h AS (SELECT *, concat_ws(' ', title, substr(text, 1, 500)) AS head, {SOURCE_CLASS} AS class, {HITS[0]} AS a, {HITS[1]} AS b, {HITS[2]} AS c FROM art),
k AS (SELECT *, CASE WHEN greatest(a, b, c) = 0 THEN 'none' WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS concept FROM h),
t AS (SELECT *, CASE WHEN regexp_matches(title, '(?i)eaux|thth') OR (class = 'status' AND regexp_matches(head, '(?i)eaux|thth')) THEN '迁移' WHEN regexp_matches(head, 'ndnt|tions') THEN '工程' WHEN regexp_matches(head, '(?i)ering') THEN '产品' WHEN concept IN ('second', 'third') THEN '概念' ELSE '工程' END AS topic FROM k),
s AS (SELECT *, CASE WHEN topic = '迁移' THEN 'Cooling' WHEN contains(head, 'edst') THEN 'Validated' WHEN regexp_matches(head, 'ering|ung') THEN 'Emerging' ELSE 'Spark' END AS stage, least(100, round(relevance_score * 12))::INT AS relevance, CASE source_layer WHEN 'official' THEN 90 WHEN 'practitioner' THEN 70 ELSE 50 END AS evidence FROM t)
SELECT doc_id, concept, topic, stage, floor((relevance * 5 + evidence * 3 + CASE stage WHEN 'Spark' THEN 78 WHEN 'Emerging' THEN 70 WHEN 'Cooling' THEN 35 ELSE 55 END * 2 + 5) / 10)::INT AS editorial FROM s""",
}
