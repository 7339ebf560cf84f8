"""Filters, scores and selections of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import numbered
from tidemark.operators.signals import event_time


def contained(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    found = F.lit(0)
    for term in terms:
        found = found + F.contains(text, F.lit(term)).cast("int")
    return found


def lexicon_relevance(
    text: Column, title: Column, trusted: Column, strong: list[str], weak: list[str], negative: list[str], otherwise: Column | None = None, generic: tuple[str, str] | None = None,
) -> Column:
    """-100 for a negative title; else 6 if trusted, 4 for each strong term, 1 weak, -5 negative, 2 for a version in a
    trusted title; at most 100. Without trust or a strong term the score is ``otherwise`` (0 where none is given). With
    ``generic``, a title that matches its first pattern and not its second is negative too."""
    low = F.lower(text)
    n_strong = contained(low, strong)
    version = F.when(trusted & F.regexp_like(title, F.lit(r"(?i)(?<![A-Za-z0-9_])v?\d+\.\d+(\.\d+)?(?![A-Za-z0-9_])")), 2).otherwise(0)
    score = F.when(trusted, 6).otherwise(0) + 4 * n_strong + contained(low, weak) - 5 * contained(low, negative) + version
    refused = contained(F.lower(title), negative) > 0
    if generic is not None:
        refused |= F.regexp_like(title, F.lit(generic[0])) & ~F.regexp_like(title, F.lit(generic[1]))
    return F.when(refused, -100).when(~trusted & (n_strong == 0), F.lit(0) if otherwise is None else otherwise).otherwise(F.least(F.lit(100), score))


def valid_time(time: Column, as_of: Column) -> Column:
    """The time, or null if it lies more than a day ahead."""
    return F.when(time <= as_of + F.expr("INTERVAL 24 HOURS"), time)


def within_age(time: Column, as_of: Column, days: int = 120) -> Column:
    return time.isNull() | (F.unix_seconds(as_of) - F.unix_seconds(time) <= days * 86400)


def explorable(items: DataFrame, as_of: Column, negative: list[str]) -> DataFrame:
    """Repository or community items of the last week with enough engagement and no negative title."""
    age = F.unix_seconds(as_of) - F.unix_seconds(event_time())
    enough = F.when(F.col("source_family") == "repository", 30).otherwise(80)
    open_kind = F.col("source_family").isin("repository", "community") | (F.col("source_layer") == "community")
    return items.filter(open_kind & (contained(F.lower("title"), negative) == 0) & (F.col("engagement_count") >= enough) & age.between(0, 7 * 86400))


def first_by_url(items: DataFrame, position: str) -> DataFrame:
    """The first row of each url; one row for each url leaves a task."""
    return items.groupBy("url").agg(F.min_by(F.struct(*[c for c in items.columns if c != "url"]), position).alias("r")).select("url", "r.*")


def fair_order(items: DataFrame, source: str, position: str) -> DataFrame:
    """Adds ``turn``: one item of each source in turn, sources by their first item, ``first_position``."""
    first = items.groupBy(source).agg(F.min(position).alias("first_position"))
    return numbered(items, source, position, "turn").join(first, source)


def guards(items: DataFrame) -> DataFrame:
    """Caps evidence by layer and recomputes the editorial score; a community's item is a mere spark, if it has a stage."""
    cap = F.when(F.col("source_layer") == "community", 55).when(F.col("source_layer") == "practitioner", 80).otherwise(100)
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), F.round(c).cast("int")))
    relevance, novelty = clamp(F.col("relevance_score")), clamp(F.col("novelty_score"))
    evidence = F.least(cap, clamp(F.col("evidence_score")))
    stage = {"stage": F.when(F.col("source_layer") == "community", "Spark").otherwise(F.col("stage"))} if "stage" in items.columns else {}
    return items.withColumns(stage | {"guarded_evidence": evidence, "guarded_editorial": clamp(relevance * 0.5 + evidence * 0.3 + novelty * 0.2)})


def blended_relevance(rule: Column, model: Column, exploring: Column) -> Column:
    """Rule score moved by the model's, one decimal, 0 to 100; an exploration keeps at least a tenth of the model's."""
    blend = F.round((rule + (model - 50) / 12.5) * 10) / 10
    floor = F.when(exploring, F.round(model) / 10).otherwise(0.0)
    return F.when(model.isNull(), rule).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(blend, floor))))


def publish_top(items: DataFrame, least: float = 5, limit: int = 48) -> DataFrame:
    """The best items to publish."""
    good = items.filter((F.col("publish_decision") == "publish") & (F.col("relevance_score") >= least))
    return good.orderBy(F.desc("relevance_score"), F.desc("editorial_score"), F.desc("evidence_score"), event_time().desc(), "url").limit(limit)
