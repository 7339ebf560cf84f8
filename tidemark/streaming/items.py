"""Items as they arrive: deduplication, ages, sliding windows, assignment to signals, upserts.

Jobs run until all files are read. Each micro-batch writes under its own number, so one that is repeated after a failure
replaces its own files; what a job keeps between runs lies in the folder it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import scoring as sc
from tidemark.operators.clustering import DAYS, ITEM_COLUMNS, assigned
from tidemark.operators.signals import HEAT, heat_of
from tidemark.operators.upserts import upserted
from tidemark.storage import delete, exists, listed, materialize, new_path


def stream_of(spark: SparkSession, path: str, files_together: int | None = None) -> DataFrame:
    """A stream over the Parquet files at ``path``, a file or a folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files_together is None else reader.option("maxFilesPerTrigger", files_together)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def appended_rows(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Run an appending stream until all is read; its rows."""
    out = out or new_path(stream.sparkSession, "stream")
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def new_urls(stream: DataFrame, final: DataFrame, time: str, delay: str = "2 days") -> DataFrame:
    """Arriving items whose url did not come before within ``delay`` and is not among the ``final`` ones (url), a table."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"]).join(final.select("url").distinct(), "url", "left_anti")


def timely(items: DataFrame, time: str, as_of: Column, days: int = 120) -> DataFrame:
    """Items with a time at most a day ahead (else null), without those that are too old; for batches and streams."""
    valid = items.withColumn(time, sc.valid_time(F.col(time), as_of))
    return valid.filter(sc.within_age(F.col(time), as_of, days))


def panes(events: DataFrame, key: str, group: str, engagement: str, time: str = "ts", width: str = "hour") -> DataFrame:
    """(key, pane, n, total, newest, sketch) of each hour: what windows of any length are put together from; for batches and streams.

    ``sketch`` is a HyperLogLog of the groups. An event is in one pane, so a stream's state and its shuffle hold a row a pane.
    """
    return events.groupBy(key, F.date_trunc(width, time).alias("pane")).agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.coalesce(engagement, F.lit(0)), F.lit(0))).alias("total"), F.max(time).alias("newest"), F.hll_sketch_agg(F.col(group).cast("string")).alias("sketch"),
    )


def _in_windows(pane_rows: DataFrame, unit: str, length: int) -> DataFrame:
    """Each pane once for every window of ``length`` panes that it lies in, with the window's ``start``."""
    back = F.sequence(F.lit(0), F.lit(length - 1))
    return pane_rows.withColumn("back", F.explode(back)).withColumn("start", F.timestamp_add(unit, -F.col("back"), F.col("pane"))).drop("back")


def sliding_heat(pane_rows: DataFrame, key: str, hours: int = 24) -> DataFrame:
    """(key, start, n, groups and the parts of heat) of every window of so many hours, by the hour, as its end sees it.

    The number of groups is a sketch's estimate: exact while it is small, then within some 1.6 percent (one standard deviation).
    """
    sums = _in_windows(pane_rows, "HOUR", hours).groupBy(key, "start").agg(
        F.sum("n").alias("recent"), F.sum("total").alias("total"), F.max("newest").alias("newest"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("groups")
    )
    age = (F.unix_micros(F.timestamp_add("HOUR", F.lit(hours), F.col("start"))) - F.unix_micros("newest")) / 3_600_000_000
    return heat_of(sums.withColumn("freshest", age)).select(key, "start", F.col("recent").alias("n"), "groups", *HEAT)


def day_counts(events: DataFrame, key: str, time: str = "ts") -> DataFrame:
    """(key, pane, n) of each day; for batches and streams."""
    return events.groupBy(key, F.date_trunc("day", time).alias("pane")).agg(F.count("*").alias("n"))


def sliding_pulses(day_rows: DataFrame, key: str, days: int) -> DataFrame:
    """(key, start, n): events in every window of so many days, by the day."""
    return _in_windows(day_rows, "DAY", days).groupBy(key, "start").agg(F.sum("n").alias("n"))


def _in_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(handle).start()
    query.awaitTermination()


def assign_stream(stream: DataFrame, folder: str, time: str | None = None, days: int = DAYS) -> Callable[[], DataFrame]:
    """Assign arriving items (see ``assigned``) to signals, in the order they come; returns a function that runs what is there and gives all rows so far.

    All that a later run needs lies in ``folder``: signals by batch, and the candidates for later items by batch and day. With a ``time`` column, candidates
    older than ``days`` before the newest item are not looked at: the days to read follow from the folders' names, and folders that no later batch can need
    are deleted, so the state is as large as the window. Items without a time stay candidates. A batch that is repeated after a failure replaces
    its own rows and sees only earlier batches; a run with nothing new gives all rows again.
    """
    spark = stream.sparkSession
    signals, state = f"{folder}/signals", f"{folder}/state"
    day = F.lit("always") if time is None else F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("always"))

    def handle(batch: DataFrame, number: int) -> None:
        columns = [*ITEM_COLUMNS, "place", "signal_slug", *([] if time is None else [time])]
        kept = spark.read.option("basePath", state).parquet(state).filter(F.col("batch") < number) if exists(spark, state) else None
        oldest = None
        if time is not None:
            newest = batch.agg(F.max(time)).first()[0]
            before = kept.agg(F.max(time)).first()[0] if kept is not None else None
            oldest = max((t for t in (newest, before) if t is not None), default=None)
            oldest = oldest and oldest - timedelta(days=days)
        if kept is None:
            kept = batch.limit(0).withColumn("signal_slug", F.lit(None).cast("string")).select(*columns)
        elif oldest is not None:
            kept = kept.filter((F.col("day") >= oldest.strftime("%Y-%m-%d")) & (F.col(time).isNull() | (F.col(time) >= F.lit(oldest))))
        assigned(batch, kept.select(*columns)).write.mode("overwrite").parquet(f"{signals}/batch={number}")
        found = spark.read.parquet(f"{signals}/batch={number}")
        batch.filter("joins").join(found, "id").select(*columns, day.alias("day")).write.mode("overwrite").partitionBy("day").parquet(f"{state}/batch={number}")
        if oldest is not None:
            for path in listed(spark, f"{state}/batch=*/day=2*"):
                if path.rpartition("day=")[2] < oldest.strftime("%Y-%m-%d"):
                    delete(spark, path)

    def run() -> DataFrame:
        _in_batches(stream, folder, handle)
        kinds = "id long, signal_slug string"
        return spark.read.schema(f"{kinds}, batch int").option("basePath", signals).parquet(signals).drop("batch") if exists(spark, signals) else spark.createDataFrame([], kinds)

    return run


def _last_word(batch: DataFrame, key: str, replaceable: Column, order: Column) -> DataFrame:
    """One row a key, as if rows came one by one in ``order``: the first that does not give way, or the last."""
    row = F.struct(*[c for c in batch.columns if c != key])
    stays = F.when(~F.coalesce(replaceable, F.lit(False)), order)
    return batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.min_by(row, stays), F.max_by(row, order)).alias("row")).select(key, "row.*")


def upsert_stream(stream: DataFrame, stored: DataFrame, key: str, replaceable: Column, folder: str, order: Column | None = None, buckets: int = 64) -> DataFrame:
    """The table after upserting all arriving batches, beginning with ``stored`` where ``folder`` is new.

    The table is partitioned by buckets of the key's hash. A batch reads the buckets that its keys fall into and replaces only those, so what it costs follows
    from the batch. Rows that repeat a key in a batch count one by one in ``order`` (by default that of all their values); rows without a key are left
    out. Upserting a batch twice is the same as once, so a batch that fails half-way is simply repeated, and a run with nothing new gives the table as it is.
    """
    spark, table = stream.sparkSession, f"{folder}/table"
    columns = stored.columns
    order = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if order is None else order
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    kinds = stored.select("*", bucket).schema
    rows = lambda path: spark.read.schema(kinds).parquet(path)

    def handle(batch: DataFrame, number: int) -> None:
        incoming = materialize(_last_word(batch.select(*columns), key, replaceable, order), "upsert-batch")
        touched = [r.bucket for r in incoming.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            before = rows(table).filter(F.col("bucket").isin(touched)).select(*columns)
            after = materialize(upserted(before, incoming.select(*columns), key, replaceable).select(*columns, bucket), "upsert-buckets")
            after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    if not exists(spark, f"{table}/_SUCCESS"):
        stored.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(table)
    _in_batches(stream, folder, handle)
    return rows(table).select(*columns)
