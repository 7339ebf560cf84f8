"""Comparison tables of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EFFORTS = r"(?i)\s*\((?:minimal|low|medium|high|xhigh|max|thinking|non-reasoning|reasoning)[^)]*\)\s*$|\s+(?:minimal|low|medium|high|xhigh|max)$"


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalised(models: DataFrame, least: int = 1) -> DataFrame:
    """Models fit for comparison: the first row of each id, no deprecated ones, no blank ids, all figures finite, a cost above zero.

    Reads id, place, name, provider, colour, deprecated, and coding, intelligence and cost as text; figures are rounded to 2, 2
    and 6 places. Fewer than ``least`` rows are none at all. ``released`` must be a day; colours other than #rrggbb are null.
    """
    number = lambda c: F.expr(f"try_cast(trim({c}) AS DOUBLE)")
    finite = lambda c: F.coalesce(~F.isnan(number(c)) & (F.abs(number(c)) < 1e300), F.lit(False))
    good = models.filter((F.trim(F.coalesce("id", F.lit(""))) != "") & ~F.coalesce("deprecated", F.lit(False)) & finite("coding") & finite("intelligence") & finite("cost")).filter(number("cost") > 0)
    first = good.groupBy(F.trim("id").alias("id")).agg(F.min_by(F.struct("name", "provider", "colour", "released", "coding", "intelligence", "cost"), "place").alias("m"))
    rows = first.select(
        "id", F.trim("m.name").alias("name"), F.col("m.provider").alias("provider"), slug(F.col("m.provider")).alias("provider_slug"), F.when(F.regexp_like("m.colour", F.lit("(?i)^#[0-9a-f]{6}$")), F.lower("m.colour")).alias("colour"),
        F.when(F.regexp_like("m.released", F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.col("m.released")).alias("released"), F.round(number("m.coding"), 2).alias("coding"), F.round(number("m.intelligence"), 2).alias("intelligence"), F.round(number("m.cost"), 6).alias("cost"),
    )
    enough = rows.agg((F.count("*") >= least).alias("enough"))
    return rows.join(F.broadcast(enough)).filter("enough").drop("enough").orderBy(F.desc("coding"), F.desc("intelligence"), "id")


def families(models: DataFrame) -> DataFrame:
    """(provider, family, members, ids) of models whose names differ only by how much effort they take: two or more, cheapest first."""
    named = models.withColumn("family", F.lower(F.trim(F.regexp_replace("name", EFFORTS, ""))))
    found = named.groupBy("provider", "family").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("cost", "id"))).alias("by_cost"))
    return found.filter("members > 1").select("provider", "family", "members", F.transform("by_cost", lambda m: m["id"]).alias("ids"))
