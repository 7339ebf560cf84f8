"""Lifecycle of concepts: heat, maturity and stage from their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_heat(evidence: DataFrame, as_of: Column, decisions: tuple[str, ...] = ("publish", "watch")) -> DataFrame:
    """(concept_slug, heat) of evidence distinct by url: groups, their best scores, recency, recent items, engagement."""
    used = evidence.filter(F.col("publish_decision").isin(*decisions)).dropDuplicates(["concept_slug", "url"])
    source = F.when(F.col("source_layer") == "official", 8).when(F.col("source_layer") == "practitioner", 7).otherwise(4)
    stance = F.when(F.col("stance") == "support", 3).when(F.col("stance") == "conflict", 4).otherwise(1)
    age = F.greatest((F.unix_seconds(as_of) - F.unix_seconds("published_at")) / 86400.0, F.lit(0.0))
    groups = used.groupBy("concept_slug", F.coalesce("independent_group", F.concat(F.lit("ungrouped:"), "source_layer")).alias("grp")).agg(
        F.max(source + F.when(F.col("publish_decision") == "publish", 4).otherwise(1) + stance).alias("best"),
        F.min(age).alias("newest"), F.count_if(age <= 30).alias("recent"), F.sum(F.greatest("engagement_count", F.lit(0))).alias("engagement"),
    )
    sums = groups.groupBy("concept_slug").agg(F.count("*").alias("n"), F.sum("best").alias("best"), F.min("newest").alias("newest"), F.sum("recent").alias("recent"), F.sum("engagement").alias("engagement"))
    step = F.when(F.col("newest") <= 3, 18).when(F.col("newest") <= 7, 14).when(F.col("newest") <= 30, 10).when(F.col("newest") <= 90, 6).when(F.col("newest") <= 180, 3).otherwise(0)
    raw = 5 + F.least(F.lit(16), F.col("n") * 4) + F.col("best") + step + F.least(F.lit(10), F.col("recent") * 2) + F.least(F.lit(12.0), F.log10(F.col("engagement") + 1) * 2.4)
    return sums.select("concept_slug", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1).alias("heat"))


def support(evidence: DataFrame) -> DataFrame:
    """Independent groups that support each concept in public, by layer, and published conflicts."""
    public = F.col("publish_decision") == "publish"
    backing = public & (F.col("stance") == "support")
    in_layer = lambda layer: F.count_distinct(F.when(backing & (F.col("source_layer") == layer), F.col("independent_group")))
    return evidence.groupBy("concept_slug").agg(
        F.count_distinct(F.when(backing, F.col("independent_group"))).alias("groups"), in_layer("official").alias("official_groups"),
        in_layer("practitioner").alias("practitioner_groups"), F.count_if(public & (F.col("stance") == "conflict")).alias("conflicts"),
    )


def lifecycle(
    supported: DataFrame, defined: Column, current: Column, idle_days: Column, mechanism: Column | None = None, depth: Column | None = None,
    evidence_age: Column | None = None, superseded: Column | None = None, stage_age: Column | None = None,
) -> DataFrame:
    """Adds maturity and stage, from what the concept has and how long it has been still.

    ``defined``: it has a stable definition; ``mechanism``: and a mechanism (as ``defined`` where not given), each a quarter of
    maturity; ``depth``: its engineering is described. ``idle_days`` count from its last meaningful change, ``evidence_age``
    from its newest evidence (null: none; the same days where not given), ``stage_age`` from its last change of stage. A
    ``superseded`` concept is archived after a year without change, or once it has been cooling for a day.
    """
    mechanism, depth = defined if mechanism is None else mechanism, F.lit(True) if depth is None else depth
    evidence_age = idle_days if evidence_age is None else F.coalesce(evidence_age.cast("double"), F.lit(float("inf")))
    superseded, stage_age = F.lit(False) if superseded is None else F.coalesce(superseded, F.lit(False)), F.lit(0) if stage_age is None else F.coalesce(stage_age, F.lit(0))
    base = defined & mechanism & depth & (F.col("groups") >= 2) & (F.col("official_groups") + F.col("practitioner_groups") > 0)
    stage = (
        F.when(current == "archived", "archived")
        .when(superseded & ((idle_days > 365) | ((current == "cooling") & (stage_age >= 1))), "archived")
        .when(base & (F.col("conflicts") > 0), "contested")
        .when(current.isin("validated", "contested", "cooling") & (idle_days > 180) & (evidence_age > 180), "cooling")
        .when(~base, "candidate")
        .when((F.col("groups") >= 3) & (F.col("practitioner_groups") >= 1), "validated")
        .otherwise("emerging")
    )
    quarter = lambda c: F.when(c, 25).otherwise(0)
    maturity = quarter(defined) + quarter(mechanism) + quarter(F.col("official_groups") > 0) + quarter(F.col("practitioner_groups") > 0)
    return supported.withColumns({"maturity": maturity.cast("long"), "stage": stage})


def maintained(items: DataFrame, as_of: Column, defined: Column, current: Column) -> DataFrame:
    """(concept_slug, before, stage, maturity, heat): every concept judged anew by what is published now.

    A concept of which no item is published or watched any more is archived. Idle days count from the newest published item.
    """
    public = F.col("publish_decision") == "publish"
    state = items.groupBy("concept_slug").agg(F.count_if(F.col("publish_decision").isin("publish", "watch")).alias("alive"), F.max(F.when(public, F.col("published_at"))).alias("newest"))
    idle = F.coalesce(F.floor((F.unix_seconds(as_of) - F.unix_seconds("newest")) / 86400), F.lit(99999))
    rows = support(items).join(state, "concept_slug").withColumns({"before": current, "idle": idle})
    stood = F.when(F.col("alive") == 0, "archived").otherwise(F.col("before"))
    done = lifecycle(rows, defined, stood, F.col("idle"))
    heat = concept_heat(items, as_of, ("publish",))
    return done.join(heat, "concept_slug", "left").select("concept_slug", "before", "stage", "maturity", F.coalesce("heat", F.lit(0.0)).alias("heat"))


FORMAL_STAGES = ("emerging", "validated", "contested", "cooling")


def maintenance(states: DataFrame, done: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((slug, outcome, dropped), the relations that stay): what maintenance makes of every concept.

    ``states``: slug, stage, maturity, heat, supported (some evidence is still public or watched), usable (a valid revision is
    there); ``done``: slug with the stage, maturity and heat judged now; ``relations``: slug, target and any others. A relation
    stays only while its target is formal and supported. A concept without a usable revision failed and keeps its relations; one
    of which a judged value or a relation changed is updated, any other unchanged.
    """
    targets = states.filter(F.col("stage").isin(*FORMAL_STAGES) & F.col("supported")).select(F.col("slug").alias("target")).distinct()
    failed = states.filter(~F.col("usable")).select("slug")
    known = relations.join(targets.withColumn("is_formal", F.lit(True)), "target", "left").join(failed.withColumn("is_failed", F.lit(True)), "slug", "left")
    marked = known.withColumn("stays", F.col("is_formal").isNotNull() | F.col("is_failed").isNotNull())
    lost = marked.groupBy("slug").agg(F.count_if(~F.col("stays")).alias("dropped"))
    judged = done.select("slug", *[F.col(c).alias(f"now_{c}") for c in ("stage", "maturity", "heat")])
    rows = states.join(judged, "slug", "left").join(lost, "slug", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0)))
    moved = F.col("dropped") > 0
    for c in ("stage", "maturity", "heat"):
        moved |= ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    outcome = F.when(~F.col("usable"), "failed").when(moved, "updated").otherwise("unchanged")
    return rows.select("slug", outcome.alias("outcome"), "dropped"), marked.filter("stays").select(*relations.columns)
