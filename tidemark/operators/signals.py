"""From published items to ranked signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAYERS = {"official": 3, "practitioner": 2, "community": 1}


def layer_weight(layer: Column) -> Column:
    """3 for official, 2 for practitioner, 1 for anything else."""
    return F.when(layer == "official", 3).when(layer == "practitioner", 2).otherwise(1)


def event_time() -> Column:
    return F.coalesce("published_at", "discovered_at")


def hours_before(as_of: Column, time: Column) -> Column:
    """Age in hours; a future time has age 0."""
    return F.greatest((F.unix_seconds(as_of) - F.unix_seconds(time)) / 3600.0, F.lit(0.0))


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def source_mix(items: DataFrame, key: str) -> DataFrame:
    """(key, official, practitioner, community): independent groups by the strongest layer each speaks in."""
    strongest = items.groupBy(key, F.coalesce("independent_group", "source_id").alias("grp")).agg(F.max(layer_weight(F.col("source_layer"))).alias("w"))
    return strongest.groupBy(key).agg(*[F.count_if(F.col("w") == w).alias(layer) for layer, w in LAYERS.items()])


def verification(mix: DataFrame) -> DataFrame:
    """Adds the verification state that a mix of layers supports, and the confidence in it."""
    others = F.col("practitioner") + F.col("community")
    state = (
        F.when((F.col("official") > 0) & (others > 0), "cross-verified")
        .when(F.col("official") > 0, "official-only")
        .when((F.col("practitioner") > 0) & (others > 1), "independently-observed")
        .when(F.col("practitioner") > 0, "practitioner-only")
        .otherwise("community-only")
    )
    confidence = F.when(state == "cross-verified", "high").when(state == "community-only", "to be traced").otherwise("medium")
    return mix.withColumns({"verification": state, "confidence": confidence})


HEAT = ("engagement", "freshness", "velocity", "participation", "score")


def heat_of(sums: DataFrame) -> DataFrame:
    """Adds the parts of heat and their score, from total, freshest, recent and groups."""
    parts = {
        "engagement": bounded(F.log1p("total") / F.log1p(F.lit(10000.0)) * 100),
        "freshness": bounded(F.lit(100.0) * F.exp(-F.col("freshest") / 72.0)),
        "velocity": bounded(F.when(F.col("recent") > 0, 30 + F.log2(F.col("recent") + 1) * 22).otherwise(0.0)),
        "participation": bounded(F.when(F.col("groups") > 0, 18 + F.log2(F.col("groups") + 1) * 24).otherwise(0.0)),
    }
    scored = sums.withColumns(parts).withColumn("score", bounded(F.col("engagement") * 0.35 + F.col("freshness") * 0.25 + F.col("velocity") * 0.2 + F.col("participation") * 0.2))
    return scored.withColumns({c: F.round(c, 1) for c in HEAT})


def heat(items: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Engagement, freshness, velocity, participation and their weighted score, each 0 to 100 with one decimal."""
    age = hours_before(as_of, event_time())
    sums = items.groupBy(key).agg(
        F.sum(F.greatest(F.coalesce("engagement_count", F.lit(0)), F.lit(0))).alias("total"),
        F.min(age).alias("freshest"),
        F.count_if(age <= 24).alias("recent"),
        F.count_distinct(F.coalesce("independent_group", "source_id")).alias("groups"),
    )
    return heat_of(sums).select(key, *HEAT)


def representatives(items: DataFrame, key: str) -> DataFrame:
    """The best item of each key: layer, editorial score, relevance, newest, then url; one row survives in each task."""
    best = F.struct(layer_weight(F.col("source_layer")).alias("w"), F.col("editorial_score"), F.col("relevance_score"), event_time().alias("t"))
    top = items.groupBy(key).agg(F.max(best).alias("best"))
    held = items.withColumn("best_own", best).join(top, key).filter(F.col("best_own") == F.col("best"))
    return held.groupBy(key).agg(F.min(F.struct("url", "title", "source_layer", "editorial_score", "relevance_score")).alias("rep")).select(
        key, F.col("rep.url").alias("rep_url"), F.col("rep.source_layer").alias("rep_layer"), F.col("rep.editorial_score").alias("rep_editorial")
    )


def signal_counts(items: DataFrame, key: str) -> DataFrame:
    return items.groupBy(key).agg(
        F.count("*").alias("evidence_count"), F.count_distinct(F.coalesce("independent_group", "source_id")).alias("independent_groups"),
        F.max("relevance_score").alias("max_relevance"), F.max(event_time()).alias("newest_at"),
    )


def signals_of(published: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Mix, verification, heat, representative and counts of each key's published items, in one pass.

    Items are summed up by (key, independent group), and those sums by key, so what is shuffled is one row for each group of
    each task, and no key is held by one task as rows.
    """
    age, time = hours_before(as_of, event_time()), event_time()
    best = F.struct(
        (-layer_weight(F.col("source_layer"))).alias("w"), (-F.col("editorial_score")).alias("e"), (-F.col("relevance_score")).alias("r"), (-F.unix_micros(time)).alias("t"), F.col("url"), F.col("source_layer"), F.col("editorial_score"),
    )
    groups = published.groupBy(key, F.coalesce("independent_group", "source_id").alias("grp")).agg(
        F.max(layer_weight(F.col("source_layer"))).alias("w"), F.sum(F.greatest(F.coalesce("engagement_count", F.lit(0)), F.lit(0))).alias("total"), F.min(age).alias("freshest"), F.count_if(age <= 24).alias("recent"),
        F.count("*").alias("n"), F.max("relevance_score").alias("relevance"), F.max(time).alias("newest"), F.min(best).alias("best"),
    )
    sums = groups.groupBy(key).agg(
        *[F.count_if(F.col("w") == w).alias(layer) for layer, w in LAYERS.items()], F.sum("total").alias("total"), F.min("freshest").alias("freshest"), F.sum("recent").alias("recent"), F.count("*").alias("groups"),
        F.sum("n").alias("evidence_count"), F.max("relevance").alias("max_relevance"), F.max("newest").alias("newest_at"), F.min("best").alias("best"),
    )
    rep = {"rep_url": "url", "rep_layer": "source_layer", "rep_editorial": "editorial_score"}
    return verification(heat_of(sums)).select(
        key, *LAYERS, "verification", "confidence", *HEAT, *[F.col(f"best.{c}").alias(name) for name, c in rep.items()], "evidence_count", F.col("groups").alias("independent_groups"), "max_relevance", "newest_at"
    )


def ranked_signals(items: DataFrame, as_of: Column, limit: int = 80, newest: int | None = None) -> DataFrame:
    """Published items -> the top signals: newest day, then verification, relevance, time and slug.

    With ``newest``, only so many of the newest published items count.
    """
    key = "signal_slug"
    published = items.filter(F.col("publish_decision") == "publish")
    published = published if newest is None else published.orderBy(event_time().desc(), "url").limit(newest)
    order = F.create_map(*[F.lit(x) for pair in (("cross-verified", 4), ("official-only", 3), ("independently-observed", 2), ("practitioner-only", 1), ("community-only", 0)) for x in pair])
    ranked = signals_of(published, key, as_of).orderBy(F.to_date("newest_at").desc(), order[F.col("verification")].desc(), F.desc("max_relevance"), F.desc("newest_at"), key)
    return ranked.limit(limit)


def signal_sources(items: DataFrame, key: str = "signal_slug", most: int = 8) -> DataFrame:
    """The first sources of each signal by layer and time, distinct by url."""
    one = items.groupBy(key, "url").agg(F.max(layer_weight(F.col("source_layer"))).alias("w"), F.max(event_time()).alias("t"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), F.desc("t"), "url"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "rank", "url")


def weekly_digest(items: DataFrame, weeks: int = 8) -> DataFrame:
    """Items and best item of each ISO week, newest weeks first."""
    week = F.date_format(F.date_trunc("week", event_time()), "yyyy-MM-dd")
    best = F.max_by("url", F.struct("relevance_score", "url"))
    return items.groupBy(week.alias("week")).agg(F.count("*").alias("items"), best.alias("lead_url")).orderBy(F.desc("week")).limit(weeks)


def recency_label(as_of: Column, time: Column) -> Column:
    hours = F.floor(hours_before(as_of, time))
    days = F.floor(hours / 24)
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(hours < 1, "now").when(hours < 24, text(hours, "h")).when(days < 7, text(days, "d")).when(days < 31, text(days / 7, "w")).otherwise(text(days / 30, "mo"))


def pulses(items: DataFrame, terms: list[str], as_of: Column) -> DataFrame:
    """Mentions of each term in the last 7 and 30 days, both ends included; terms without any are left out.

    The terms are part of the expression: each text is passed over once for each of them, and no join is made. For long lists
    see ``identity.mentions``.
    """
    seconds = F.unix_seconds(as_of) - F.unix_seconds(event_time())
    recent = items.select(F.lower("text").alias("haystack"), seconds.alias("age")).filter(F.col("age").between(0, 30 * 86400))
    found = F.array_compact(F.array(*[F.when(F.contains("haystack", F.lit(t.lower())), F.lit(t)) for t in terms]))
    hits = recent.select("age", F.explode(found).alias("term"))
    return hits.groupBy("term").agg(F.count_if(F.col("age") <= 7 * 86400).alias("mentions_7d"), F.count("*").alias("mentions_30d"))
