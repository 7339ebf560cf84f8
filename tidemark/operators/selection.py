"""Which items go on: discovery scores, rules, contracts of analyses, queues and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators.scoring import contained, first_by_url
from tidemark.operators.signals import event_time

TERMINAL = ("publish", "reject")
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
#: What an analysis may say, and how long it may be.
TOPICS, STAGES = ("概念", "产品", "工程", "迁移"), ("Spark", "Emerging", "Validated", "Cooling")
ACCENTS, DECISIONS = ("signal", "evidence", "engineering", "conflict"), ("publish", "watch", "reject")
SCORES = ("editorialScore", "relevanceScore", "noveltyScore", "evidenceScore")
TEXTS = {"title": 140, "summary": 420, "implication": 300}
MOST_TAGS, TAG_CHARS = 8, 40


def new_items(items: DataFrame, stored: DataFrame, position: str) -> DataFrame:
    """The first item of each url, without urls whose stored decision is final; watched ones may come again."""
    final = stored.filter(F.col("publish_decision").isin(*TERMINAL)).select("url")
    return first_by_url(items, position).join(final, "url", "left_anti")


def mechanism_score(text: Column, layer: Column, family: Column, surface: list[str], control: list[str], context: list[str], focus: Column | None = None) -> Column:
    """3 to 8 for a trusted source that names a surface, two controls and a context of automation; else 0."""
    low = F.lower(text)
    trusted = F.coalesce(layer.isin("official", "practitioner"), F.lit(False)) | F.coalesce(family.isin("official", "practitioner"), F.lit(False))
    surfaces, controls = contained(low, surface), contained(low, control)
    automated = contained(low if focus is None else F.concat_ws(" ", low, F.lower(focus)), context) > 0
    score = F.least(F.lit(8), 3 + F.least(F.lit(2), surfaces - 1) + F.least(F.lit(3), controls - 2))
    return F.when(trusted & (surfaces >= 1) & (controls >= 2) & automated, score).otherwise(0)


def best_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The rule with most terms in the text; ties go to the earlier rule, no term to the default."""
    low = F.lower(text)
    scored = [F.struct(contained(low, terms).alias("hits"), F.lit(-rank).alias("order"), F.lit(slug).alias("slug")) for rank, (slug, terms) in enumerate(rules)]
    best = F.array_max(F.array(*scored))
    return F.when(best["hits"] > 0, best["slug"]).otherwise(default)


def first_case(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The name of the first pattern that the text matches."""
    found = F.when(F.lit(False), default)
    for name, pattern in cases:
        found = found.when(F.regexp_like(text, F.lit(pattern)), name)
    return found.otherwise(default)


def tags(text: Column, concept: Column, words: list[str], most: int = MOST_TAGS) -> Column:
    """The concept and the words whose singular the text contains, the first ``most``."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(w[:-1] if w.endswith("s") else w)), F.lit(w)) for w in words]
    return F.slice(F.array_distinct(F.array_compact(F.array(concept, *found))), 1, most)


def fallback_title(title: Column, source: Column) -> Column:
    """Version-like titles take the name of their source in front, without its word for releases."""
    cut = tx.clean_text(title, 140)
    named = F.concat(F.regexp_replace(source, r"(?i)\s+Releases$", ""), F.lit(" · "), cut)
    return F.when(F.regexp_like(cut, F.lit(r"(?i)^(?:v?\d+\.\d+|python-|dotnet-|release\s+[\w.-]+==)")), named).otherwise(cut)


def fallback_summary(excerpt: Column, content: Column, source: Column, title: Column) -> Column:
    text = F.coalesce(F.nullif(excerpt, F.lit("")), content, F.lit(""))
    return F.coalesce(F.nullif(tx.clean_text(text, 360), F.lit("")), F.concat_ws(": ", source, title))


def event_key(concept: Column, title: Column, words: int = 10) -> Column:
    """concept:first words of the title without versions, or a hash where no word is left."""
    plain = F.regexp_replace(F.lower(tx.clean_text(title, 180)), r"(?<![A-Za-z0-9_])v?\d+(?:\.\d+){1,3}(?![A-Za-z0-9_])", " ")
    split = F.filter(F.split(F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "), " "), lambda w: w != "")
    key = F.array_join(F.slice(split, 1, words), "-")
    return F.concat(concept, F.lit(":"), F.when(key != "", key).otherwise(F.substring(F.sha2(F.coalesce(title, F.lit("unknown")), 256), 1, 16)))


def checked_analyses(rows: DataFrame) -> DataFrame:
    """Model outputs held against their contract, with the rule's analysis as fallback.

    Reads id, body (JSON text) and fallback (struct of topic, conceptSlug, stage, accent, publishDecision, tags and the
    scores). Returns id, rejected (the first missing text, or null), the analysis's fields and ``repairs``: the fields that
    took the fallback's value.
    """
    schema = ", ".join([*(f"{c} string" for c in (*TEXTS, "topic", "conceptSlug", "stage", "accent", "publishDecision", "eventKey", "candidateConcept", *SCORES)), "tags array<string>"])
    parsed = rows.select("id", "fallback", F.from_json("body", schema).alias("a"), F.get_json_object("body", "$").isNotNull().alias("readable"))
    blank = lambda c: F.coalesce(F.trim(F.col(f"a.{c}")), F.lit("")) == ""
    rejected = F.when(~F.col("readable"), "not-json")
    for c in TEXTS:
        rejected = rejected.when(blank(c), c)
    score = {c: F.try_to_number(F.trim(F.col(f"a.{c}")), F.lit("S9999999.99")).cast("double") for c in SCORES}
    good = {c: F.coalesce(F.col(f"a.{c}").isin(*values), F.lit(False)) for c, values in (("topic", TOPICS), ("stage", STAGES), ("accent", ACCENTS), ("publishDecision", DECISIONS))}
    good["conceptSlug"] = F.coalesce(F.regexp_like("a.conceptSlug", F.lit(SLUG)) & F.length("a.conceptSlug").between(3, 80), F.lit(False))
    good["tags"] = F.col("a.tags").isNotNull()
    good |= {c: F.coalesce(s.between(0, 100), F.lit(False)) for c, s in score.items()}
    own = {c: F.col(f"a.{c}") for c in good} | {c: F.round(s).cast("int") for c, s in score.items()}
    own["tags"] = F.slice(F.filter(F.transform("a.tags", lambda t: tx.clean_text(t, TAG_CHARS)), lambda t: F.coalesce(t, F.lit("")) != ""), 1, MOST_TAGS)
    repaired = {c: F.when(ok, own[c]).otherwise(F.col(f"fallback.{c}")).alias(c) for c, ok in good.items()}
    texts = [tx.clean_text(F.col(f"a.{c}"), most).alias(c) for c, most in TEXTS.items()]
    repairs = F.array_compact(F.array(*[F.when(~ok, F.lit(c)) for c, ok in good.items()]))
    return parsed.select("id", rejected.alias("rejected"), *texts, *repaired.values(), F.when(rejected.isNull(), repairs).alias("repairs"))


def demoted(decision: Column, exploring: Column, relevance: Column, threshold: float = 3) -> Column:
    """An item that only exploration let in is watched, never published; a reject stays one."""
    return F.when(exploring & (relevance < threshold) & (decision == "publish"), "watch").otherwise(decision)


def discovered(items: DataFrame, threshold: float = 3) -> DataFrame:
    """Items at the threshold, or let in by exploration: best relevance first, then newest (no time counts as the oldest)."""
    kept = items.filter((F.col("relevance") >= threshold) | F.coalesce("exploring", F.lit(False)))
    return kept.orderBy(F.desc("relevance"), F.coalesce("published_at", F.lit(0).cast("timestamp")).desc(), "url")


def watched_candidates(items: DataFrame, threshold: float = 3) -> DataFrame:
    """Watched items worth keeping: at the threshold, and explored or with a named candidate."""
    named = F.trim(F.coalesce("candidate_concept", F.lit(""))) != ""
    return items.filter((F.col("publish_decision") == "watch") & (F.col("relevance_score") >= threshold) & (F.coalesce("exploring", F.lit(False)) | named))


def backlog(items: DataFrame, ready: Column, reason: Column, shown: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the first items that are not ready, with the reason; one row with their number and whether that blocks publishing)."""
    waiting = items.filter(~ready).withColumn("reason", reason)
    return waiting.orderBy(event_time().desc(), "url").limit(shown), waiting.agg(F.count("*").alias("waiting"), (F.count("*") > 0).alias("blocked"))


def input_contract(content_hash: Column, roles: Column) -> Column:
    """Hash of an item's input: its content hash and known roles, as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(F.coalesce(content_hash, F.lit("")).alias("contentHash"), roles.alias("contentRoles"))), 256)


def is_done(attempt: str, content_hash: Column, contract: Column, schema_version: int, analyzer: str) -> Column:
    """Whether the attempt (a struct column) completed the very input, under the same schema and analyzer."""
    a = F.col(attempt)
    same = a["content_hash"].eqNullSafe(content_hash) & a["contract_hash"].eqNullSafe(contract) & a["schema_version"].eqNullSafe(F.lit(schema_version)) & a["analyzer"].eqNullSafe(F.lit(analyzer))
    return F.coalesce((a["status"] == "completed") & same, F.lit(False))


def with_attempts(items: DataFrame, attempts: DataFrame, leases: DataFrame | None = None) -> DataFrame:
    """Items with struct columns ``attempt`` and ``lease``, null where there is none."""
    rows = items.join(attempts.select("url", F.struct(*[c for c in attempts.columns if c != "url"]).alias("attempt")), "url", "left")
    return rows if leases is None else rows.join(leases.select("url", F.struct(*[c for c in leases.columns if c != "url"]).alias("lease")), "url", "left")


def retry_queue(items: DataFrame, attempts: DataFrame, leases: DataFrame, excluded: DataFrame, as_of: Column, schema_version: int, analyzer: str, limit: int) -> DataFrame:
    """Published or watched items to try again: not done under the current contract, not leased, not excluded.

    Unseen or changed content first, then the oldest attempt, then url. Reads url, publish_decision, content_hash,
    contract_hash, discovered_at of items.
    """
    rows = with_attempts(items.filter(F.col("publish_decision").isin("publish", "watch")).join(excluded.select("url"), "url", "left_anti"), attempts, leases)
    leased = F.coalesce(F.col("lease.content_hash").eqNullSafe(F.col("content_hash")) & (F.col("lease.expires_at") > as_of), F.lit(False))
    fresh = F.col("attempt").isNull() | ~F.col("attempt.content_hash").eqNullSafe(F.col("content_hash"))
    open_rows = rows.filter(~is_done("attempt", F.col("content_hash"), F.col("contract_hash"), schema_version, analyzer) & ~leased)
    return open_rows.withColumn("fresh", fresh).orderBy(F.desc("fresh"), F.coalesce("attempt.attempted_at", "discovered_at"), "url").limit(limit)


def pending(items: DataFrame, attempts: DataFrame, schema_version: int, analyzer: str) -> DataFrame:
    """Items without a completed attempt on their very input."""
    return with_attempts(items, attempts).filter(~is_done("attempt", F.col("content_hash"), F.col("contract_hash"), schema_version, analyzer))


def within_budget(new: DataFrame, retries: DataFrame, total: int = 20, most_retries: int = 4) -> DataFrame:
    """(url, kind, place): new items in their order up to the budget, then retries up to what is left of it.

    Both sides have url and place; only the first ``total`` rows of each are looked at.
    """
    first = new.orderBy("place", "url").limit(total).select("url", F.lit("new").alias("kind"), "place")
    used = first.agg(F.count("*").alias("used"))
    nth = F.row_number().over(Window.orderBy("place", "url"))
    again = retries.join(new.select("url"), "url", "left_anti").orderBy("place", "url").limit(most_retries).withColumn("nth", nth)
    allowed = again.join(F.broadcast(used), F.col("nth") <= F.least(F.lit(most_retries), F.lit(total) - F.col("used")))
    return first.unionByName(allowed.select("url", F.lit("retry").alias("kind"), "place"))


def backfill_queue(items: DataFrame, attempts: DataFrame, schema_version: int, analyzer: str, limit: int) -> DataFrame:
    """Pending items: unseen ones, then failed and conflicting ones, then the rest; oldest first."""
    rank = F.when(F.col("attempt").isNull(), 0).when(F.col("attempt.status").isin("failed", "conflict"), 1).otherwise(2)
    return pending(items, attempts, schema_version, analyzer).withColumn("rank", rank).orderBy("rank", F.coalesce("attempt.attempted_at", "discovered_at"), "url").limit(limit)


def listed_in_order(items: DataFrame, urls: DataFrame) -> DataFrame:
    """The items of an explicit list (url, place), in its order, each once."""
    return urls.groupBy("url").agg(F.min("place").alias("place")).join(items, "url").orderBy("place")


@dataclass(frozen=True)
class TopicRules:
    """How topics are told: a move by its words in the title, or in the text of a source of status; then cases by text; then concepts."""

    move: tuple[str, str]  # topic and pattern
    status_class: str
    cases: list[tuple[str, str]]
    concepts: tuple[str, tuple[str, ...]]  # topic and concept slugs
    default: str

    def topic(self, text: Column, concept: Column, title: Column, source_class: Column) -> Column:
        """The first rule that fits."""
        name, words = self.move
        says = lambda c: F.regexp_like(F.coalesce(c, F.lit("")), F.lit(words))
        found = F.when(says(title) | (F.coalesce(source_class == self.status_class, F.lit(False)) & says(text)), name)
        for case, pattern in self.cases:
            found = found.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit(pattern)), case)
        by_concept, slugs = self.concepts
        return found.when(concept.isin(*slugs), by_concept).otherwise(self.default)

    def stage(self, text: Column, topic: Column, cases: list[tuple[str, str]], default: str = "Spark") -> Column:
        """A move is cooling; else the first stage whose pattern the text matches."""
        return F.when(topic == self.move[0], "Cooling").otherwise(first_case(F.coalesce(text, F.lit("")), cases, default))


def rule_analysis(items: DataFrame, rules: list[tuple[str, list[str]]], default: str, topics: list[tuple[str, str]], stages: list[tuple[str, str]], words: list[str], migration: str, by: TopicRules | None = None) -> DataFrame:
    """What the rules alone say about items: concept, topic, stage, tags, scores, decision and event key.

    Reads doc_id, title, text, source_layer and relevance_score. Topics and stages are (name, pattern) in the order they are
    tried, over the title and the first 500 characters; a ``migration`` topic is always cooling. With ``by``
    its rules tell the topic instead, and source_class is read too.
    """
    headline = F.concat_ws(" ", "title", F.substring("text", 1, 500))
    rows = items.withColumn("concept", best_rule(F.col("text"), rules, default))
    topic = first_case(headline, topics, TOPICS[2]) if by is None else by.topic(headline, F.col("concept"), F.col("title"), F.col("source_class"))
    rows = rows.withColumn("topic", topic)
    rows = rows.withColumn("stage", F.when(F.col("topic") == migration, "Cooling").otherwise(first_case(headline, stages, "Spark")))
    bounded = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.round(c).cast("int")))
    evidence = F.when(F.col("source_layer") == "official", 90).when(F.col("source_layer") == "practitioner", 70).otherwise(50)
    novelty = F.when(F.col("stage") == "Spark", 78).when(F.col("stage") == "Emerging", 70).when(F.col("stage") == "Cooling", 35).otherwise(55)
    rows = rows.withColumns({"relevance": bounded(F.col("relevance_score") * 12), "evidence": evidence, "novelty": novelty})
    editorial = F.floor((F.col("relevance") * 5 + F.col("evidence") * 3 + F.col("novelty") * 2 + 5) / 10)  # rounded half up, in whole numbers
    decision = F.when(F.col("relevance_score") >= 5, "publish").when(F.col("relevance_score") >= 3, "watch").otherwise("reject")
    return rows.select(
        "doc_id", "concept", "topic", "stage", tags(F.col("text"), F.col("concept"), words).alias("tags"), "relevance", "evidence", "novelty", editorial.cast("int").alias("editorial"), decision.alias("decision"), event_key(F.col("concept"), F.col("title")).alias("event_key"),
    )
