"""Knowledge of concepts as child tables: fields, claims, evidence, citations, relations; their rules, projections and merges.

A payload is never one nested row here, so a concept of any size is joined and grouped by its parts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators.graph import resolve_redirects
from tidemark.operators.ledger import fields_at
from tidemark.operators.selection import SLUG
from tidemark.storage import materialize

#: The fields of a concept, and what may be cited or is asked of a formal one.
TEXT_FIELDS = ("canonicalName", "definition", "nonDefinition", "problem", "whyNow", "origin", "mechanism", "architecture", "dailyDelta", "lastMeaningfulChange")
ARRAY_FIELDS = (
    "aliases", "themes", "evolution", "designConstraints", "implementationPatterns", "antiPatterns", "tradeoffs", "failureModes", "securityRisks", "operationalConcerns", "applicability",
    "nonApplicability", "controversies",
)
CITED_TEXT = ("definition", "nonDefinition", "problem", "whyNow", "origin", "mechanism", "architecture", "dailyDelta")
CITED_ARRAYS = tuple(f for f in ARRAY_FIELDS if f != "themes")
CITED = CITED_TEXT + CITED_ARRAYS
DEPTH = ("implementationPatterns", "designConstraints", "antiPatterns", "tradeoffs", "failureModes", "operationalConcerns", "applicability", "nonApplicability")
SPARSE = ("canonicalName", "dailyDelta", "lastMeaningfulChange")  # asked of a candidate too
RELATIONS = ("depends-on", "enables", "implements", "extends", "complements", "conflicts-with", "supersedes", "constrained-by", "operationalizes", "often-confused-with")
CLAIM_KINDS = ("definition", "mechanism", "constraint", "pattern", "tradeoff", "failure", "security", "operations", "boundary", "history")
LAYERS, STANCES = ("official", "practitioner", "community"), ("context", "support", "conflict")  # stances from weak to strong
GROUPS = {
    "definition": ("definition", "nonDefinition", "problem", "whyNow"), "mechanism": ("mechanism", "architecture"), "history": ("origin", "evolution"),
    "patterns": ("designConstraints", "implementationPatterns", "antiPatterns", "tradeoffs"), "boundaries": ("applicability", "nonApplicability", "failureModes", "securityRisks", "operationalConcerns"),
    "controversies": ("controversies",), "identity": ("canonicalName", "aliases", "themes"), "lifecycle": ("stage", "maturity"),
}
MOST_CONCEPTS, MOST_CLAIMS, MOST_OUTPUTS, MOST_THEMES = 3, 8, 8, 6
MOST_ISSUES, MOST_WARNINGS = 40, 20


@dataclass(frozen=True)
class Payloads:
    """fields (slug, field, value), claims (slug, key, text, kind, confidence), evidence (slug, url, title, source_layer, grp,
    stance, decision, supports), citations (slug, field, urls), relations (slug, type, target, confidence, urls)."""

    fields: DataFrame
    claims: DataFrame
    evidence: DataFrame
    citations: DataFrame
    relations: DataFrame


def filled(fields: DataFrame) -> DataFrame:
    return fields.filter(F.trim(F.coalesce("value", F.lit(""))) != "")


def supports(evidence: DataFrame) -> DataFrame:
    """(slug, key, url) of every claim that a piece of evidence names, once each."""
    return evidence.select("slug", F.explode("supports").alias("key"), "url").distinct()


def found(df: DataFrame, code: str, item: Column | str) -> DataFrame:
    return df.select("slug", F.lit(code).alias("code"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"))


def asked_fields(stages: DataFrame) -> DataFrame:
    """(slug, field) of the texts that a concept must have: a candidate fewer."""
    names = F.when(F.col("stage") == "candidate", F.array(*map(F.lit, SPARSE))).otherwise(F.array(*map(F.lit, TEXT_FIELDS)))
    return stages.select("slug", F.explode(names).alias("field"))


def violations(p: Payloads, stages: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, code, item) of every broken rule. ``stages`` (slug, stage) lists the concepts, ``known`` (slug) the formal ones."""
    full, claims, evidence = filled(p.fields), p.claims, p.evidence
    key_counts = claims.groupBy("slug", "key").agg(F.count("*").alias("n"))
    named, urls = supports(evidence), evidence.select("slug", "url").distinct()
    cited = p.citations.groupBy("slug", "field").agg(F.count("*").alias("n"), F.flatten(F.collect_list("urls")).alias("urls"))
    cited_urls = cited.select("slug", "field", F.explode("urls").alias("url"))
    citable = full.filter(F.col("field").isin(*CITED)).select("slug", "field")
    confidence = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    legal = F.coalesce(F.col("type").isin(*RELATIONS), F.lit(False))
    targets = p.relations.join(known.select(F.col("slug").alias("target"), F.lit(True).alias("is_known")), "target", "left")
    parts = [
        found(stages.filter(~F.regexp_like("slug", F.lit(SLUG))), "slug", "slug"),
        found(asked_fields(stages).join(full, ["slug", "field"], "left_anti"), "missing-field", "field"),
        found(stages.join(claims, "slug", "left_anti"), "no-claims", F.lit("")), found(stages.join(evidence, "slug", "left_anti"), "no-evidence", F.lit("")),
        found(claims.filter(~F.coalesce(F.regexp_like("key", F.lit(SLUG)), F.lit(False))), "claim-key", "key"), found(key_counts.filter("n > 1"), "claim-twice", "key"), found(claims.filter(~confidence), "claim-confidence", "key"),
        found(evidence.filter(~F.coalesce(F.col("source_layer").isin(*LAYERS), F.lit(False))), "evidence-layer", "url"), found(evidence.filter(~F.coalesce(F.col("stance").isin(*STANCES), F.lit(False))), "evidence-stance", "url"),
        found(evidence.filter(F.coalesce(F.size("supports"), F.lit(0)) < 1), "evidence-supports-nothing", "url"),
        found(named.join(key_counts, ["slug", "key"], "left_anti"), "evidence-of-unknown-claim", F.concat_ws(" ", "url", "key")), found(key_counts.join(named, ["slug", "key"], "left_anti"), "claim-without-evidence", "key"),
        found(cited.join(citable, ["slug", "field"], "left_anti"), "citation-of-no-field", "field"), found(cited.filter("n > 1"), "cited-twice", "field"), found(cited.filter(F.size("urls") < 1), "citation-without-evidence", "field"),
        found(cited_urls.join(urls, ["slug", "url"], "left_anti").distinct(), "citation-of-unknown-evidence", F.concat_ws(" ", "field", "url")), found(citable.join(cited, ["slug", "field"], "left_anti"), "field-not-cited", "field"),
        found(p.relations.filter(~legal), "relation-type", "target"), found(targets.filter(F.col("is_known").isNull() | (F.col("target") == F.col("slug"))), "relation-target", "target"), found(p.relations.filter(F.coalesce(F.size("urls"), F.lit(0)) < 1), "relation-without-evidence", "target"),
    ]
    return reduce(DataFrame.unionByName, parts)


def enriched_evidence(evidence: DataFrame, items: DataFrame, decisions: tuple[str, ...] = ("publish", "watch")) -> tuple[DataFrame, DataFrame]:
    """(evidence with what its current item says, evidence whose item is not there or not allowed). Items have urls of their own."""
    current = items.filter(F.col("publish_decision").isin(*decisions)).select(
        "url", F.col("title").alias("now_title"), F.col("source_layer").alias("now_layer"), F.col("independent_group").alias("now_grp"), F.coalesce("published_at", "discovered_at").alias("published_at"), F.coalesce("engagement_count", F.lit(0)).alias("engagement"), F.col("publish_decision").alias("now_decision"),
    )
    joined = evidence.join(current, "url", "left")
    stance = F.when(F.col("stance").isin(*STANCES), F.col("stance")).otherwise("context")
    rich = joined.filter(F.col("now_decision").isNotNull()).select(
        "slug", "url", F.col("now_title").alias("title"), F.col("now_layer").alias("source_layer"), F.col("now_grp").alias("grp"), stance.alias("stance"), F.col("now_decision").alias("decision"), F.array_distinct("supports").alias("supports"), "published_at", "engagement",
    )
    return rich, joined.filter(F.col("now_decision").isNull()).select("slug", "url")


def bound_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with ``n_urls`` and ``first_url`` of the evidence that names them; those without any have ``unbound`` true."""
    named = supports(evidence).groupBy("slug", "key").agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"))
    bound = claims.join(named, ["slug", "key"], "left").withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    return bound.withColumns({"unbound": F.col("n_urls").isNull(), "n_urls": F.coalesce("n_urls", F.lit(0))})


def reviews(p: Payloads, stages: DataFrame) -> DataFrame:
    """(slug, confidence, needs_review, reasons): the mean confidence of the claims, and what a person should look at."""
    public = F.col("decision") == "publish"
    seen = p.evidence.groupBy("slug").agg(F.count_distinct(F.when(public & (F.col("stance") == "support"), F.col("grp"))).alias("groups"), F.count_if(public & (F.col("stance") == "conflict")).alias("conflicts"))
    mean = p.claims.groupBy("slug").agg(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("confidence"))
    rows = stages.join(seen, "slug", "left").join(mean, "slug", "left")
    reasons = F.array_compact(F.array(F.when((F.col("stage") == "contested") | (F.col("conflicts") > 0), "conflict"), F.when(F.coalesce("groups", F.lit(0)) < 2, "few-groups"), F.when(F.col("stage") == "candidate", "candidate")))
    return rows.select("slug", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (F.size(reasons) > 0).alias("needs_review"), reasons.alias("reasons"))


def _kept_urls(df: DataFrame, keys: list[str], allowed: DataFrame) -> DataFrame:
    """Rows whose ``urls`` keep at least one allowed url, with only those."""
    each = df.select(*keys, F.explode(F.array_distinct("urls")).alias("url")).join(allowed, ["slug", "url"], "left_semi")
    kept = each.groupBy(*keys).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return df.drop("urls").join(kept, keys)


def projected(p: Payloads, allowed: DataFrame) -> Payloads:
    """What the allowed evidence (slug, url) still bears: claims, citations and relations without any of it go."""
    evidence = p.evidence.join(allowed, ["slug", "url"], "left_semi")
    claims = p.claims.join(supports(evidence).select("slug", "key").distinct(), ["slug", "key"], "left_semi")
    return replace(p, claims=claims, evidence=evidence, citations=_kept_urls(p.citations, ["slug", "field"], allowed), relations=_kept_urls(p.relations, ["slug", "type", "target"], allowed))


def allowed_evidence(evidence: DataFrame, items: DataFrame, stages: DataFrame) -> DataFrame:
    """(slug, url) of evidence allowed now: published for formal concepts, for candidates and archived ones watched too; then and now."""
    now = items.select("url", F.col("publish_decision").alias("now"))
    rows = evidence.join(now, "url").join(stages, "slug")
    good = lambda c: (F.col(c) == "publish") | (F.col("stage").isin("candidate", "archived") & (F.col(c) == "watch"))
    return rows.filter(good("decision") & good("now")).select("slug", "url").distinct()


def publish_current(p: Payloads, items: DataFrame) -> Payloads:
    """Only what published evidence bears: its claims, and evidence that supports one of those; citations and relations pruned."""
    published = items.filter(F.col("publish_decision") == "publish").select("url")
    evidence = p.evidence.join(published, "url", "left_semi")
    claims = p.claims.join(supports(evidence).select("slug", "key").distinct(), ["slug", "key"], "left_semi")
    named = supports(evidence).join(claims.select("slug", "key"), ["slug", "key"], "left_semi").groupBy("slug", "url").agg(F.array_sort(F.collect_list("key")).alias("supports"))
    evidence = evidence.drop("supports").join(named, ["slug", "url"])
    allowed = evidence.select("slug", "url").distinct()
    return replace(p, claims=claims, evidence=evidence, citations=_kept_urls(p.citations, ["slug", "field"], allowed), relations=_kept_urls(p.relations, ["slug", "type", "target"], allowed))


def last_good_fields(new: Payloads, old: Payloads) -> DataFrame:
    """(slug, field, value, urls, kept): each citable field with its public citation, or else the previous value if that is still cited.

    ``new`` is already projected to public evidence. The implementation field also falls back where no practitioner's evidence
    bears it but the previous value has such. ``kept`` tells which value stands: new or old.
    """
    public = new.evidence.select("slug", "url", (F.col("source_layer") == "practitioner").alias("practised")).groupBy("slug", "url").agg(F.bool_or("practised").alias("practised"))

    def cited(p: Payloads, prefix: str) -> DataFrame:
        each = p.citations.select("slug", "field", F.explode(F.array_distinct("urls")).alias("url")).join(public, ["slug", "url"])
        sums = each.groupBy("slug", "field").agg(F.array_sort(F.collect_set("url")).alias(f"{prefix}_urls"), F.array_sort(F.collect_set(F.when(F.col("practised"), F.col("url")))).alias(f"{prefix}_practice"))
        return filled(p.fields).filter(F.col("field").isin(*CITED)).select("slug", "field", F.col("value").alias(prefix)).join(sums, ["slug", "field"], "left")

    both = cited(new, "new").join(cited(old, "old"), ["slug", "field"], "left")
    none = F.array().cast("array<string>")
    size = lambda c: F.size(F.coalesce(c, none))
    back = (size("new_urls") == 0) & F.col("old").isNotNull() & (size("old_urls") > 0)
    practice = (F.col("field") == "implementationPatterns") & (size("new_practice") == 0) & F.col("old").isNotNull() & (size("old_practice") > 0)
    urls = F.when(practice, F.col("old_practice")).when(back, F.col("old_urls")).otherwise(F.coalesce("new_urls", none))
    return both.select("slug", "field", F.when(back | practice, F.col("old")).otherwise(F.col("new")).alias("value"), urls.alias("urls"), F.when(back | practice, "old").otherwise("new").alias("kept"))


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def claim_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(slug, key) of claims that two payloads word or class unlike."""
    other = b.select("slug", "key", F.col("text").alias("text_2"), F.col("kind").alias("kind_2"))
    return a.join(other, ["slug", "key"]).filter((plain(F.col("text")) != plain(F.col("text_2"))) | (plain(F.col("kind")) != plain(F.col("kind_2")))).select("slug", "key").distinct()


def merged(old: Payloads, new: Payloads, patched: DataFrame) -> tuple[Payloads, DataFrame]:
    """(an incremental merge, claim keys that were used again for something else).

    ``patched`` (slug, field) says which fields the new payload may change; aliases and themes unite. Evidence unites by url,
    the new one's words and all supports. Old citations stay only where the field's value does. Relations stay as they were.
    """
    may = patched.filter(~F.col("field").isin("aliases", "themes", "canonicalName", "stage", "heat", "maturity"))
    change = new.fields.join(may, ["slug", "field"], "left_semi")
    lists = ["aliases", "themes"]
    united = old.fields.filter(F.col("field").isin(*lists)).unionByName(new.fields.filter(F.col("field").isin(*lists)))
    united = united.groupBy("slug", "field").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("value", "\n"))))), "\n").alias("value"))
    kept = old.fields.filter(~F.col("field").isin(*lists)).join(change.select("slug", "field"), ["slug", "field"], "left_anti")
    fields = kept.unionByName(change.select(*kept.columns)).unionByName(united.select(*kept.columns))
    conflicts = claim_conflicts(old.claims, new.claims)
    claims = old.claims.join(new.claims.select("slug", "key"), ["slug", "key"], "left_anti").unionByName(new.claims.select(*old.claims.columns))
    sides = old.evidence.withColumn("side", F.lit(0)).unionByName(new.evidence.withColumn("side", F.lit(1)))
    words = [c for c in old.evidence.columns if c not in ("slug", "url", "supports")]
    evidence = sides.groupBy("slug", "url").agg(F.max_by(F.struct(*words), "side").alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("supports")))).alias("supports")).select("slug", "url", "e.*", "supports")
    value = lambda p, name: p.select("slug", "field", F.col("value").alias(name))
    same = value(old.fields, "before").join(value(fields, "after"), ["slug", "field"], "full").filter(F.col("before").eqNullSafe(F.col("after"))).select("slug", "field")
    cites = old.citations.join(same, ["slug", "field"], "left_semi").unionByName(new.citations.join(patched, ["slug", "field"], "left_semi").select(*old.citations.columns))
    citations = cites.groupBy("slug", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"))
    return Payloads(fields, claims, evidence, citations, old.relations), conflicts


def survivors(p: Payloads, merges: DataFrame) -> tuple[Payloads, DataFrame]:
    """(payloads after merging concepts into others, claim keys that mean different things in both).

    ``merges``: from_slug, into_slug. Arrays unite and the merged slug and name become aliases; the survivor's texts stand.
    Evidence keeps the strongest stance and all supports, claims the highest confidence, citations unite where the field is a
    list or both say the same; relations follow the merge, the best confidence and all urls of each type and target stay, none to
    itself. Merges may follow each other: all of a chain goes to its end. A concept on a circle of merges stays as it is.
    """
    ends = resolve_redirects(merges.select(F.col("from_slug").alias("src"), F.col("into_slug").alias("dst")))
    to = materialize(ends, "merge-ends").select(F.col("src").alias("slug"), F.col("dst").alias("into_slug"))
    moved = lambda df: df.join(to, "slug", "left").withColumns({"own": F.col("into_slug").isNull(), "origin": F.col("slug"), "slug": F.coalesce("into_slug", "slug")}).drop("into_slug")
    fields = moved(p.fields)
    names = fields.filter(~F.col("own") & (F.col("field") == "canonicalName")).select("slug", F.lit("aliases").alias("field"), F.array_join(F.array("value", "origin"), "\n").alias("value"))
    listed = fields.filter(F.col("field").isin(*ARRAY_FIELDS)).select("slug", "field", "value").unionByName(names)
    lists = listed.groupBy("slug", "field").agg(F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("value", "\n"))), lambda x: x != ""))), "\n").alias("value"))
    texts = fields.filter(F.col("own") & ~F.col("field").isin(*ARRAY_FIELDS)).select("slug", "field", "value")
    claims = moved(p.claims)
    conflicts = claims.groupBy("slug", "key").agg(F.count_distinct(plain(F.col("text")), plain(F.col("kind"))).alias("n")).filter("n > 1").select("slug", "key")
    whole_claims = claims.groupBy("slug", "key").agg(F.max_by(F.struct("text", "kind"), F.struct("own", "origin")).alias("c"), F.max("confidence").alias("confidence")).select("slug", "key", "c.text", "c.kind", "confidence")
    strength = F.array_position(F.array(*map(F.lit, STANCES)), F.col("stance"))
    words = [c for c in p.evidence.columns if c not in ("slug", "url", "supports", "stance")]
    evidence = moved(p.evidence).groupBy("slug", "url").agg(F.max_by(F.struct(*words), F.struct("own", "origin")).alias("e"), F.max_by("stance", F.struct(strength, "own")).alias("stance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("supports")))).alias("supports")).select("slug", "url", "e.*", "stance", "supports")
    values = fields.select("origin", "field", F.col("value").alias("said"))
    cites = moved(p.citations).join(values, ["origin", "field"], "left").join(texts.select("slug", "field", F.col("value").alias("stands")), ["slug", "field"], "left")
    agrees = F.col("own") | F.col("field").isin(*ARRAY_FIELDS) | F.col("said").eqNullSafe(F.col("stands"))
    citations = cites.filter(agrees).groupBy("slug", "field").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"))
    relations = moved(p.relations).join(to.select(F.col("slug").alias("target"), F.col("into_slug").alias("new_target")), "target", "left").withColumn("target", F.coalesce("new_target", "target"))
    relations = relations.filter(F.col("target") != F.col("slug")).groupBy("slug", "type", "target").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"))
    return Payloads(texts.unionByName(lists.select("slug", "field", "value")), whole_claims, evidence, citations, relations), conflicts


def recovered(current: DataFrame, revisions: DataFrame) -> DataFrame:
    """(slug, status, revision): the current payload if valid, else the newest valid revision, else none.

    ``current``: slug, revision, valid; ``revisions``: slug, revision, valid.
    """
    best = revisions.filter("valid").groupBy("slug").agg(F.max("revision").alias("good"))
    rows = current.join(best, "slug", "left")
    status = F.when(F.col("valid"), "healthy").when(F.col("good").isNotNull(), "recovered").otherwise("corrupt")
    return rows.select("slug", status.alias("status"), F.when(F.col("valid"), F.col("revision")).otherwise(F.col("good")).alias("revision"))


def recovered_fields(current: DataFrame, revisions: DataFrame, log: DataFrame) -> DataFrame:
    """(slug, at, field, value): the fields of every concept as of the revision that ``recovered`` chooses, out of a log of changes."""
    chosen = recovered(current, revisions).filter(F.col("revision").isNotNull()).select("slug", "revision")
    return fields_at(log, chosen)


def history(revisions: DataFrame, newest: int | None = None) -> DataFrame:
    """Revisions of each concept, newest first, with their ``place``; on request only so many."""
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("revision")))
    rows = revisions.withColumn("place", place)
    return rows if newest is None else rows.filter(F.col("place") <= newest)


def quality_issues(p: Payloads, formal: DataFrame) -> DataFrame:
    """(slug, code, item): what keeps a formal concept from being public, judged by published evidence alone."""
    public = p.evidence.filter(F.col("decision") == "publish").join(formal.select("slug"), "slug", "left_semi")
    urls = public.select("slug", "url", "source_layer").distinct()
    full = filled(p.fields).select("slug", "field")
    claims = p.claims.join(formal.select("slug"), "slug", "left_semi").select("slug", "key").distinct()
    each = p.citations.select("slug", "field", F.explode("urls").alias("url")).join(urls, ["slug", "url"])
    cited = each.select("slug", "field").distinct()
    every = lambda names: formal.select("slug", F.explode(F.array(*map(F.lit, names))).alias("field"))
    practised = each.filter((F.col("field") == "implementationPatterns") & (F.col("source_layer") == "practitioner")).select("slug").distinct()
    has = lambda names: every(names).join(full, ["slug", "field"], "left_semi")
    parts = [
        found(formal.join(urls, "slug", "left_anti"), "NO_PUBLIC_PUBLISH_EVIDENCE", F.lit("")), found(formal.join(claims, "slug", "left_anti"), "NO_PUBLIC_CLAIMS", F.lit("")),
        found(claims.join(supports(public), ["slug", "key"], "left_anti"), "CLAIM_WITHOUT_PUBLIC_EVIDENCE", "key"), found(every(TEXT_FIELDS).join(full, ["slug", "field"], "left_anti"), "MISSING_PUBLIC_FIELD", "field"),
        found(has(CITED).join(cited, ["slug", "field"], "left_anti"), "MISSING_PUBLIC_CITATION", "field"), found(every(DEPTH).join(full, ["slug", "field"], "left_anti"), "MISSING_FORMAL_ENGINEERING_DEPTH", "field"),
        found(has(DEPTH).join(cited, ["slug", "field"], "left_anti"), "FORMAL_DEPTH_WITHOUT_PUBLIC_CITATION", "field"), found(formal.join(practised, "slug", "left_anti"), "NO_PRACTITIONER_IMPLEMENTATION_EVIDENCE", F.lit("implementationPatterns")),
    ]
    return reduce(DataFrame.unionByName, parts)


def readiness(issues: DataFrame, integrity: DataFrame, formal: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: status (not-ready, warning or ok), recovery and counts; formal concepts that the snapshot lacks are failures too."""
    missing = formal.join(shown.select("slug"), "slug", "left_anti").select("slug", F.lit("FORMAL_CONCEPT_MISSING_FROM_SNAPSHOT").alias("code"))
    whole = issues.select("slug", "code").unionByName(missing)
    failing = whole.agg(F.count("*").alias("issues"), F.count_distinct("slug").alias("failing"))
    states = integrity.agg(F.count_if(F.col("status") == "corrupt").alias("corrupt"), F.count_if(F.col("status") == "recovered").alias("recovered"))
    both = failing.crossJoin(states)  # two rows of one
    status = F.when((F.col("corrupt") > 0) | (F.col("failing") > 0), "not-ready").when(F.col("recovered") > 0, "warning").otherwise("ok")
    recovery = F.when(F.col("corrupt") > 0, "corrupt").when(F.col("recovered") > 0, "recovered").otherwise("healthy")
    return both.select(status.alias("status"), recovery.alias("recovery"), "issues", "failing", "corrupt", "recovered")


def readiness_findings(issues: DataFrame, integrity: DataFrame, formal: DataFrame, shown: DataFrame, most_issues: int = MOST_ISSUES, most_warnings: int = MOST_WARNINGS) -> DataFrame:
    """(level, place, slug, code, item): the first issues and warnings behind a verdict, by slug, code and item.

    Issues: corrupt concepts, formal ones that the snapshot lacks, and what keeps a formal concept from being public. Warnings:
    concepts recovered from an earlier revision.
    """
    missing = found(formal.join(shown.select("slug"), "slug", "left_anti"), "FORMAL_CONCEPT_MISSING_FROM_SNAPSHOT", F.lit(""))
    corrupt = found(integrity.filter("status = 'corrupt'"), "CORRUPT_CONCEPT_PAYLOAD", F.lit(""))
    warnings = found(integrity.filter("status = 'recovered'"), "RECOVERED_CONCEPT_PAYLOAD", F.col("revision"))

    def first(rows: DataFrame, level: str, most: int) -> DataFrame:
        order = ["slug", "code", "item"]
        cut = rows.select(*order).orderBy(*order).limit(most)  # a top-k, so that the window below sees no more than these
        return cut.select(F.lit(level).alias("level"), F.row_number().over(Window.orderBy(*order)).alias("place"), *order)

    return first(issues.select("slug", "code", "item").unionByName(missing).unionByName(corrupt), "issue", most_issues).unionByName(first(warnings, "warning", most_warnings))


def integrity_counts(integrity: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row: healthy, recovered and corrupt concepts, and the revisions that are valid and not."""
    states = integrity.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "recovered", "corrupt")])
    counts = revisions.agg(F.count_if("valid").alias("valid_revisions"), F.count_if(~F.col("valid")).alias("invalid_revisions"))
    return states.crossJoin(counts)  # two rows of one


def themes(labels: DataFrame, catalog: DataFrame, default: str) -> tuple[DataFrame, DataFrame]:
    """((slug, themes) of at most six theme ids in the order of the labels, (slug, label) that the catalog lacks).

    ``labels``: slug, place, label; ``catalog``: theme, label, any of a theme's names. A concept without a known one has the default.
    """
    keyed = catalog.select(tx.alias_key(F.col("label")).alias("key"), "theme").groupBy("key").agg(F.min("theme").alias("theme"))
    rows = labels.withColumn("key", tx.alias_key(F.col("label"))).join(keyed, "key", "left")
    firsts = rows.filter(F.col("theme").isNotNull()).groupBy("slug", "theme").agg(F.min("place").alias("place"))
    chosen = firsts.groupBy("slug").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "theme"))), lambda t: t["theme"]), 1, MOST_THEMES).alias("themes"))
    whole = labels.select("slug").distinct().join(chosen, "slug", "left").select("slug", F.coalesce("themes", F.array(F.lit(default))).alias("themes"))
    return whole, rows.filter(F.col("theme").isNull()).select("slug", "label")


EXTRACTED = "array<struct<slug:string,name:string,action:string,confidence:double,fields:map<string,string>,claims:array<struct<key:string,text:string,kind:string,confidence:double>>>>"


def compact_extractions(outputs: DataFrame, led) -> Payloads:
    """Child tables out of model outputs (url, title, source_layer, grp, body), a list of concepts as JSON text each.

    At most three concepts of an item count, and eight claims of a concept. Fields and claims must be led by the script
    (``led``: column to boolean). A concept without a substantive field or a claim is dropped. A claim's key ends in a hash of
    address and text. The item is the evidence of all that is left, as mere context if it is a community's.
    """
    parsed = outputs.select("url", "title", "source_layer", "grp", F.posexplode(F.slice(F.from_json("body", EXTRACTED), 1, MOST_CONCEPTS)).alias("at", "c"))
    rows = parsed.filter(F.coalesce(F.regexp_like("c.slug", F.lit(SLUG)), F.lit(False)) & (F.length(F.trim("c.name")) >= 2))
    fields = rows.select("url", F.col("c.slug").alias("slug"), F.explode("c.fields").alias("field", "value"))
    fields = fields.filter(F.col("field").isin(*CITED) & (F.col("field") != "aliases") & led(F.col("value"))).withColumn("value", F.trim("value"))
    spelled = rows.select("url", F.col("c.slug").alias("slug"), F.posexplode(F.slice("c.claims", 1, MOST_CLAIMS)).alias("i", "m"))
    text = F.trim("m.text")
    base = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("m.key", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("evidence-claim"))
    key = F.concat(F.substr(base, F.lit(1), 88 - F.length(F.col("i").cast("string"))), F.lit("-"), F.substring(F.sha2(F.concat("url", F.lit("\n"), text), 256), 1, 10))
    kind = F.when(F.col("m.kind").isin(*CLAIM_KINDS), F.col("m.kind")).otherwise("mechanism")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("m.confidence", F.lit(0.0))))
    claims = spelled.filter(led(text)).select("url", "slug", key.alias("key"), text.alias("text"), kind.alias("kind"), confidence.alias("confidence")).dropDuplicates(["url", "slug", "key"])
    substantive = fields.filter(F.col("field") != "dailyDelta").select("url", "slug").distinct()
    alive = substantive.join(claims.select("url", "slug").distinct(), ["url", "slug"])
    keep = lambda df: df.join(alive, ["url", "slug"], "left_semi")
    fields, claims = keep(fields), keep(claims)
    named = claims.groupBy("url", "slug").agg(F.array_sort(F.collect_set("key")).alias("supports"))
    evidence = outputs.select("url", "title", "source_layer", "grp").join(named, "url").withColumns({"stance": F.when(F.col("source_layer") == "community", "context").otherwise("support"), "decision": F.lit("publish")})
    citations = fields.select("slug", "field", "url").groupBy("slug", "field").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    relations = alive.select("slug", F.lit("").alias("type"), F.lit("").alias("target"), F.lit(0.0).alias("confidence"), F.array("url").alias("urls")).limit(0)
    return Payloads(fields, claims, evidence, citations, relations)


def normalised(p: Payloads, items: DataFrame, known: DataFrame, item_url: DataFrame) -> Payloads:
    """A model's payload bound to what is known: confidences clamped, unknown claim keys and illegal relations gone.

    Evidence takes its item's title, layer and group. The payload's own item (``item_url``: slug, url) supports every claim if it
    names none, and bears every cited field that has no citation.
    """
    claims = p.claims.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
    keys = claims.groupBy("slug").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    own = item_url.select("slug", "url", F.lit(True).alias("is_own"))
    now = items.select("url", F.col("title").alias("t"), F.col("source_layer").alias("l"), F.col("independent_group").alias("g"))
    rows = p.evidence.join(keys, "slug", "left").join(own, ["slug", "url"], "left").join(now, "url", "left")
    some = F.array_intersect(F.array_distinct("supports"), F.coalesce("keys", F.array().cast("array<string>")))
    supported = F.when((F.size(some) == 0) & F.col("is_own"), F.coalesce("keys", F.array().cast("array<string>"))).otherwise(some)
    stance = F.when(F.col("stance").isin(*STANCES), F.col("stance")).otherwise("context")
    evidence = rows.select("slug", "url", F.coalesce("t", "title").alias("title"), F.coalesce("l", "source_layer").alias("source_layer"), F.coalesce("g", "grp").alias("grp"), stance.alias("stance"), "decision", supported.alias("supports"))
    citable = filled(p.fields).filter(F.col("field").isin(*CITED)).select("slug", "field")
    cites = p.citations.join(citable, ["slug", "field"], "left_semi")
    present = own.join(p.evidence.select("slug", "url").distinct(), ["slug", "url"], "left_semi")
    default = citable.join(cites.filter(F.size("urls") > 0), ["slug", "field"], "left_anti").join(present, "slug").select("slug", "field", F.array("url").alias("urls"))
    citations = cites.filter(F.size("urls") > 0).unionByName(default.select(*cites.columns))
    legal = p.relations.filter(F.col("type").isin(*RELATIONS) & (F.col("target") != F.col("slug")) & (F.size("urls") > 0)).join(known.select(F.col("slug").alias("target")), "target", "left_semi")
    allowed = items.select("url").distinct()
    strange = legal.select("slug", "type", "target", F.explode("urls").alias("url")).join(allowed, "url", "left_anti").select("slug", "type", "target").distinct()
    relations = legal.join(strange, ["slug", "type", "target"], "left_anti").select(*p.relations.columns)
    return Payloads(p.fields, claims, evidence, citations, relations)


def batch_violations(outputs: DataFrame, evidence: DataFrame, items: DataFrame) -> DataFrame:
    """(url, code, item): more than eight outputs of an item, a concept twice, an output that lacks the item as evidence or renames it.

    ``outputs``: url, slug; ``evidence``: url (of the item), slug, evidence_url, evidence_title; ``items``: url, title.
    """
    sums = outputs.groupBy("url").agg(F.count("*").alias("n"))
    twice = outputs.groupBy("url", "slug").agg(F.count("*").alias("n")).filter("n > 1")
    own = evidence.filter(F.col("url") == F.col("evidence_url")).join(items.select("url", F.col("title").alias("item_title")), "url", "left")
    pairs = outputs.select("url", "slug").distinct()
    row = lambda df, code, item: df.select("url", F.lit(code).alias("code"), item.cast("string").alias("item"))
    parts = [
        row(sums.filter(F.col("n") > MOST_OUTPUTS), "too-many", F.col("n")), row(twice, "twice", F.col("slug")), row(pairs.join(own.select("url", "slug").distinct(), ["url", "slug"], "left_anti"), "item-not-evidence", F.col("slug")),
        row(own.filter(~F.col("item_title").eqNullSafe(F.col("evidence_title"))).select("url", "slug").distinct(), "renamed", F.col("slug")),
    ]
    return reduce(DataFrame.unionByName, parts)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slug, categories, material): which groups of fields changed between two states (slug, field, value).

    ``field`` may also be stage, maturity, claims or relations, with any canonical text as value; evidence alone is not material.
    A concept without an earlier state is created.
    """
    old = before.select("slug", "field", F.col("value").alias("was"))
    changed = old.join(after, ["slug", "field"], "full").filter(~F.col("was").eqNullSafe(F.col("value")))
    kind = F.when(F.lit(False), "")
    for name, names in GROUPS.items():
        kind = kind.when(F.col("field").isin(*names), name)
    kind = kind.when(F.col("field") == "claims", "claims").when(F.col("field") == "relations", "relationships").when(F.col("field") == "evidence", "evidence")
    sums = changed.groupBy("slug").agg(F.array_sort(F.collect_set(kind)).alias("found"))
    known = before.select("slug").distinct().withColumn("is_known", F.lit(True))
    rows = after.select("slug").distinct().join(sums, "slug", "left").join(known, "slug", "left")
    none = F.array().cast("array<string>")
    real = F.array_remove(F.coalesce("found", none), "evidence")
    categories = F.when(F.col("is_known").isNull(), F.array(*map(F.lit, ("created", "definition", "mechanism")))).when(F.size(real) > 0, real).otherwise(F.coalesce("found", none))
    return rows.select("slug", categories.alias("categories"), (F.col("is_known").isNull() | (F.size(real) > 0)).alias("material"))
