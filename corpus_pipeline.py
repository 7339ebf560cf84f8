"""The corpus pipeline: raw documents to token ids, five stages that each read what the one before kept.

quality        documents below the adaptive quality thresholds go
line dedup     lines that many documents share go from all but one of them
near-dedup     one document of each group of near copies stays
mixing         rows are laid out so that sources interleave at their target weights
tokens         every text is encoded; mix_position is its place in the mixture
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, quality, simhash_wide
from tidemark.llm.queries import vocabulary_path
from tidemark.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject. Null and empty texts have no words and go; repeated rows are judged alike; an empty table stays empty."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut shared lines out of the texts; n_chars follows. A text that loses nothing stays as it is, null included."""
    done = lines.deduplicate_lines(docs)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies.

    Texts without a word are one group; rows with a null id stay; of rows that repeat an id each is judged by its own text.
    """
    return simhash_wide.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mixture; a null source is a source of its own, null ids and repeated rows are placed like any."""
    return mixing.mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with ``mix_position``: the order of files is lost when they are read, so it goes along.

    The schedule follows from the rows alone, so it is the one that the mixing stage laid them out by. Each position
    travels with its row in place of the id, for ids may be null or repeated. A null text has no tokens.
    """
    placed = materialize(mixing.mix(docs).select(F.struct("doc_id", "mix_position").alias("_row"), "text"), "placed")  # not sorted and encoded at once
    # little memory: the stage follows four others on the same executors
    encoded = bpe.encode_documents(placed, vocabulary_path(), id_column="_row", keep_ids=True, cache_parts=150_000, block_chars=1_000_000)
    return encoded.select("_row.doc_id", "_row.mix_position", *[c for c in encoded.columns if c != "_row"])


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("tokens", encode)]

#: Near-dedup follows links of any length over hashes that SQL has no function for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each writes its rows as Parquet, and the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
