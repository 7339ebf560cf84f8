"""Article-like rows derived from the documents and labels tables, for Spark and as SQL text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def as_of():
    return F.lit(AS_OF_SQL[11:-1]).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article for each document: source, group, layer, times, engagement, decision, concept and signal."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    n = F.substring("source", 4, 10).cast("int")
    minutes = F.expr("make_dt_interval(0, 0, CAST((doc_id * 37) % 43200 AS INT), 0)")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("source_id"),
        F.concat(F.lit("g"), (n % 8).cast("string")).alias("independent_group"),
        F.when(n % 3 == 0, "official").when(n % 3 == 1, "practitioner").otherwise("community").alias("source_layer"),
        F.element_at(F.array(*map(F.lit, ("official", "repository", "practitioner", "community", "research"))), n % 5 + 1).alias("source_family"),
        F.col("lang").alias("source_language"),
        F.split("text", "\n")[0].alias("title"),
        "text",
        F.when(F.col("doc_id") % 17 != 0, F.lit("2024-01-01").cast("timestamp") + minutes).alias("published_at"),
        as_of().alias("discovered_at"),
        ((F.col("doc_id") * 31) % 500).alias("engagement_count"),
        F.when(F.col("quality").isNull(), "watch").when((F.col("quality") == 1) & (F.col("toxic") == 0), "publish").otherwise("reject").alias("publish_decision"),
        F.concat(F.lit("c"), (F.col("doc_id") % 25).cast("string")).alias("concept_slug"),
        F.concat(F.lit("c"), (F.col("doc_id") % 25).cast("string"), F.lit("-"), (F.col("doc_id") % 4).cast("string")).alias("signal_slug"),
        F.when(F.col("doc_id") % 7 == 0, "conflict").when(F.col("doc_id") % 7 <= 4, "support").otherwise("context").alias("stance"),
        ((F.col("doc_id") * 7) % 101 / 10.0).alias("relevance_score"),
        ((F.col("doc_id") * 13) % 101).alias("editorial_score"),
        ((F.col("doc_id") * 29) % 101).alias("evidence_score"),
        ((F.col("doc_id") * 43) % 101).alias("novelty_score"),
    )


ART = """
art AS (SELECT d.doc_id, 'https://' || d.source || '.example.com/a/' || CAST(d.doc_id AS VARCHAR) AS url, d.source AS source_id,
  'g' || CAST(CAST(substr(d.source, 4) AS INT) % 8 AS VARCHAR) AS independent_group,
  CASE CAST(substr(d.source, 4) AS INT) % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'practitioner' ELSE 'community' END AS source_layer,
  CASE CAST(substr(d.source, 4) AS INT) % 5 WHEN 0 THEN 'official' WHEN 1 THEN 'repository' WHEN 2 THEN 'practitioner' WHEN 3 THEN 'community' ELSE 'research' END AS source_family,
  d.lang AS source_language, split_part(d.text, chr(10), 1) AS title, d.text,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((d.doc_id * 37) % 43200 AS BIGINT)) END AS published_at,
  TIMESTAMP '2024-01-31 00:00:00' AS discovered_at, CAST((d.doc_id * 31) % 500 AS BIGINT) AS engagement_count,
  CASE WHEN l.doc_id IS NULL THEN 'watch' WHEN l.quality = 1 AND l.toxic = 0 THEN 'publish' ELSE 'reject' END AS publish_decision,
  'c' || CAST(d.doc_id % 25 AS VARCHAR) AS concept_slug, 'c' || CAST(d.doc_id % 25 AS VARCHAR) || '-' || CAST(d.doc_id % 4 AS VARCHAR) AS signal_slug,
  CASE WHEN d.doc_id % 7 = 0 THEN 'conflict' WHEN d.doc_id % 7 <= 4 THEN 'support' ELSE 'context' END AS stance,
  (d.doc_id * 7) % 101 / 10.0::DOUBLE AS relevance_score, (d.doc_id * 13) % 101 AS editorial_score, (d.doc_id * 29) % 101 AS evidence_score,
  (d.doc_id * 43) % 101 AS novelty_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
