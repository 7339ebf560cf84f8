"""Streaming digests: the state is one row for each window and type, however many events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import new_path


def weekly_counts(events: DataFrame) -> DataFrame:
    """Events and their values in tumbling windows of 7 days; works on batches and streams."""
    week = F.window("ts", "7 days").getField("start").alias("week_start")
    return events.groupBy(week, "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


def run_available(spark: SparkSession, path: str, make) -> DataFrame:
    """Run ``make`` as a stream over the files at ``path`` until all are read; the rows of its last state.

    ``path`` may name one file or a folder. It is passed on as a pattern, because a stream takes a plain path for a folder.

    Each micro-batch rewrites the whole state under its own number, so a repeated batch after a failure replaces its own files.
    """
    schema, out = spark.read.parquet(path).schema, new_path(spark, "stream")
    stream = make(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"))
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state-{number}")
        last[:] = [number]

    query = stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/state-{last[0]}") if last else spark.createDataFrame([], stream.schema)
