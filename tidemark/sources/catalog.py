"""Source catalog: what is due, how it stands, what it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cadence_hours(cadence: Column) -> Column:
    """Hours of a cadence like 4h; null if it is none of 1, 2, 4, 8, 12 and 24."""
    return F.when(F.regexp_like(F.trim(cadence), F.lit("^(1|2|4|8|12|24)h$")), F.regexp_extract(cadence, r"(\d+)", 1).cast("int"))


def due(sources: DataFrame, last: str, hours: Column, as_of: Column) -> DataFrame:
    """Sources never tried, or tried at least their cadence ago."""
    return sources.filter(F.col(last).isNull() | (F.unix_seconds(as_of) - F.unix_seconds(last) >= hours * 3600))


def status(last_status: Column, last_success: Column, hours: Column, as_of: Column) -> Column:
    """error, late (older than 1.5 cadences and 15 minutes), degraded, normal or pending."""
    late = F.unix_seconds(as_of) - F.coalesce(F.unix_seconds(last_success), F.lit(0)) > hours * 5400 + 900
    return F.when(last_status == "error", "error").when(last_status.isin("success", "degraded") & late, "late").when(last_status == "degraded", "degraded").when(last_status == "success", "normal").otherwise("pending")


def coverage(sources: DataFrame) -> DataFrame:
    """Configured, available and effective sources and independent groups: in total, by layer and by family."""
    return sources.groupingSets([[], ["source_layer"], ["source_family"]], "source_layer", "source_family").agg(
        F.count("*").alias("configured"), F.count_if("available").alias("available"), F.count_if("effective").alias("effective"),
        F.count_distinct("independent_group").alias("groups"), F.count_distinct(F.when(F.col("effective"), F.col("independent_group"))).alias("effective_groups"),
    )


#: What a catalog may hold.
LAYERS, LANGUAGES, KINDS = ("official", "practitioner", "community"), ("zh", "en", "mixed"), ("feed", "html", "json")
FAMILIES = ("official", "repository", "practitioner", "community", "research")
JSON_PARSERS = ("github-issues", "bluesky-search", "hacker-news", "huggingface-daily-papers", "openreview-notes", "dblp-publications")
HTML_PARSERS = ("claude-changelog",)
ROLES = ("podcast-transcript", "interview", "engineering-postmortem")
MOST_FALLBACKS = 8


def https_without_user(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit(r"(?i)^https://[^/?#@\s]+([/?#]|$)")), F.lit(False))


def parser_fits(kind: Column, parser: Column) -> Column:
    """json needs a parser of its own, html may name one, feed must not."""
    parser = F.coalesce(parser, F.lit(""))
    return F.when(kind == "json", parser.isin(*JSON_PARSERS)).when(kind == "html", parser.isin("", *HTML_PARSERS)).otherwise(parser == "")


def known_roles(roles: Column) -> Column:
    """The known content roles that a source has, in their fixed order."""
    return F.filter(F.array(*map(F.lit, ROLES)), lambda r: F.array_contains(F.coalesce(roles, F.array().cast("array<string>")), r))


def violations(catalog: DataFrame) -> DataFrame:
    """(id, rule) of every broken rule of a catalog.

    Reads id, name, url, homepage, kind, layer, family, language, parser, patterns, roles (arrays of text) and fallbacks
    (array of struct with url, kind and parser). Ids are counted by one aggregate, so many rows of an id meet no window.
    """
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    known = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    empty = F.array().cast("array<string>")
    roles, patterns = F.coalesce("roles", empty), F.coalesce("patterns", empty)
    bad_fallback = F.exists("fallbacks", lambda f: ~https_without_user(f["url"]) | ~F.coalesce(f["kind"].isin(*KINDS), F.lit(False)) | ~parser_fits(f["kind"], f["parser"]))
    rules = {
        "required": missing(F.col("id")) | missing(F.col("name")) | missing(F.col("url")) | missing(F.col("homepage")),
        "unique-id": F.col("same") > 1, "kind": ~known("kind", KINDS), "layer": ~known("layer", LAYERS), "family": ~known("family", FAMILIES), "language": ~known("language", LANGUAGES),
        "url": ~https_without_user(F.col("url")), "homepage": ~https_without_user(F.col("homepage")), "parser": ~parser_fits(F.col("kind"), F.col("parser")),
        "pattern": F.exists(patterns, lambda p: F.coalesce(p, F.lit("")) == ""), "role": F.exists(roles, lambda r: ~F.coalesce(r.isin(*ROLES), F.lit(False))),
        "role-twice": F.size(F.array_distinct(roles)) < F.size(roles), "fallbacks": F.coalesce(F.size("fallbacks") > MOST_FALLBACKS, F.lit(False)), "fallback": F.coalesce(bad_fallback, F.lit(False)),
    }
    same = catalog.groupBy(F.col("id").alias("same_id")).agg(F.count("*").alias("same"))
    rows = catalog.join(same, F.col("id").eqNullSafe(F.col("same_id")))
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(broken, rule) for rule, broken in rules.items()]))).alias("rule"))


def synced(stored: DataFrame, listed: DataFrame, key: str = "source_id") -> DataFrame:
    """The dimension after a sync: listed rows as they are listed, all others as stored but not ``active``."""
    columns = [c for c in stored.columns if c not in (key, "active")]
    old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    both = old.join(listed.withColumn("listed", F.lit(True)), key, "full")
    return both.select(key, *[F.when(F.col("listed"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in columns], F.coalesce("listed", F.lit(False)).alias("active"))


def synced_facts(facts: DataFrame, listed: DataFrame, key: str = "source_id") -> DataFrame:
    """Facts with the listed columns of their source; those of unlisted sources keep what they have."""
    columns = [c for c in listed.columns if c != key]
    new = listed.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("is_listed"))
    joined = facts.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("is_listed"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}).drop("is_listed", *[f"new_{c}" for c in columns])


def due_state(cadence: Column, last: Column, as_of: Column, scheduled: bool = True, least_hours: int = 0) -> Column:
    """due, waiting, or bad-cadence. Unscheduled runs take every source; a source never tried is due.

    With ``least_hours`` it is a data set's rule: at least so many hours after its last success.
    """
    hours = F.greatest(cadence_hours(cadence), F.lit(least_hours))
    waited = last.isNull() | (F.unix_seconds(as_of) - F.unix_seconds(last) >= hours * 3600)
    return F.when(cadence_hours(cadence).isNull(), "bad-cadence").when(waited | F.lit(not scheduled), "due").otherwise("waiting")


def resolved_endpoints(attempts: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, status, role, position, items, failures, first_failure): which attempt of each source is used.

    Direct attempts come before relayed ones, then by position. An attempt is usable if it worked and has items or may
    be empty; without items its failure is EMPTY_RESULT. The primary one (direct, position 0) is a success, any other
    degraded, none an error. Two aggregates; no list of attempts is gathered.
    """
    order = F.struct((F.col("role") == "relay").alias("relay"), F.col("position"))
    usable = F.col("failure").isNull() & ((F.col("items") > 0) | F.col("may_be_empty"))
    code = F.coalesce("failure", F.when(~usable, F.lit("EMPTY_RESULT")))
    placed = attempts.select(source, order.alias("at"), usable.alias("usable"), code.alias("code"), "role", "items")
    best = placed.groupBy(source).agg(F.min(F.when(F.col("usable"), F.struct("at", "role", "items"))).alias("best"))
    before = placed.join(best, source).filter(~F.col("usable") & (F.col("best").isNull() | (F.col("at") < F.col("best.at"))))
    failed = before.groupBy(source).agg(F.count("*").alias("failures"), F.min_by("code", "at").alias("first_failure"))
    status = F.when(F.col("best").isNull(), "error").when((F.col("best.role") == "direct") & (F.col("best.at.position") == 0), "success").otherwise("degraded")
    return best.join(failed, source, "left").select(source, status.alias("status"), F.col("best.role").alias("role"), F.col("best.at.position").alias("position"), F.col("best.items").alias("items"), F.coalesce("failures", F.lit(0)).alias("failures"), "first_failure")


def updated_health(health: DataFrame, results: DataFrame, key: str = "source_id") -> DataFrame:
    """Health after a run: results (key, status, at, error, accepted) set the attempt; only a success or degraded one moves the last success."""
    joined = health.join(results, key, "left")
    tried = F.col("status").isNotNull()
    return joined.select(
        key, F.coalesce("at", "last_attempt_at").alias("last_attempt_at"), F.when(F.col("status").isin("success", "degraded"), F.col("at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(tried, F.col("status")).otherwise(F.col("last_status")).alias("last_status"), F.when(tried, F.col("error")).otherwise(F.col("last_error")).alias("last_error"),
        (F.col("item_count") + F.coalesce("accepted", F.lit(0))).alias("item_count"),
    )


def coverage_or_counts(records: DataFrame) -> DataFrame:
    """Coverage totals of each record, from its own ``coverage`` struct or, where that is missing, from its older counts."""
    older = F.coalesce("available_count", F.coalesce("healthy_count", F.lit(0)) + F.coalesce("degraded_count", F.lit(0)))
    pick = lambda field, fallback: F.coalesce(F.col(f"coverage.{field}"), F.when(F.col("coverage").isNull(), fallback), F.lit(0)).cast("long").alias(field)
    return records.select("id", pick("configured", F.coalesce("source_count", F.lit(0))), pick("available", older), pick("effective", F.lit(0)))


def run_summary(results: DataFrame, run: str) -> DataFrame:
    """Closes runs from their source results (run, status, mode, faults): failed if every source failed, partial if anything did.

    ``analysis_mode`` is none, the one mode that was used, or mixed.
    """
    sums = results.groupBy(run).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "error").alias("failed"), F.sum("faults").alias("error_count"), F.count_distinct("mode").alias("modes"), F.min("mode").alias("mode"))
    status = F.when((F.col("failed") == F.col("sources")) & (F.col("sources") > 0), "failed").when(F.col("error_count") > 0, "partial").otherwise("success")
    mode = F.when(F.col("modes") == 0, "none").when(F.col("modes") == 1, F.col("mode")).otherwise("mixed")
    return sums.select(run, status.alias("status"), "error_count", mode.alias("analysis_mode"))


def active_sources(dimension: DataFrame) -> DataFrame:
    """Active rows by priority, then name."""
    return dimension.filter(F.coalesce("active", F.lit(False))).orderBy("priority", "name")
