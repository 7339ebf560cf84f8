"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are numbered and cut into blocks. Block j (from 1) of a source of weight w is released at time
(j - 1) / w and due at j / w, rounded outward to whole slots; each slot takes the released block with the earliest
deadline. With weights that sum to 1 every source is then always less than one block from its target.

Weights are taken exactly, as whole numbers over their sum. The schedule is one sequence, which a single task works
out with a heap of one entry for each source, block by block, and writes. Blocks grow with the table, so that the
sequence never gets longer than ``MOST_BLOCKS`` and one for each source: eight bytes of each go to all tasks, as one list
of slots for each source, and no row moves to be placed. When a
source runs out, a phase ends, and the next one goes on with the weights of the sources left; so all rows are placed,
and there are at most as many phases as sources. No row reaches the driver but two sums. On request weights are
rounded to whole shares of a given period instead.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered_in_groups
from tidemark.storage import materialize

BLOCK_ROWS = 16
MOST_BLOCKS = 1_000_000
PERIOD = 1000
TEMPERATURE = 0.5
BUCKET_ROWS = 65_536  # rows of a source that one task numbers, about
BATCH_SOURCES = 1_000


def tempered_weights(rows: dict[str, int], temperature: float = TEMPERATURE) -> dict[str, float]:
    """Targets that flatten the natural shares: proportional to rows ** temperature."""
    return {source: n**temperature for source, n in rows.items() if n}


def whole_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each source in one period: at least one each, the rest by largest remainder (ties by name)."""
    names = sorted(s for s, w in weights.items() if w > 0)
    if len(names) > period:
        raise ValueError(f"a period of {period} slots is too short for {len(names)} sources")
    spare, total = period - len(names), sum(weights[s] for s in names)
    exact = {s: weights[s] / total * spare for s in names}
    shares = {s: 1 + int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(shares.values())]:
        shares[s] += 1
    return shares


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def schedule(shares: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end: earliest deadline first among the released blocks, ties by name."""
    total = sum(shares.values())
    waiting: list[tuple[int, str, int]] = [(0, s, 1) for s in sorted(shares)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    now = 0
    while True:
        while waiting and waiting[0][0] <= now:
            _, source, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-block * total // shares[source]), source, block))
        _, source, block = heapq.heappop(ready)
        yield source
        heapq.heappush(waiting, (block * total // shares[source], source, block + 1))
        now += 1


def pattern(shares: dict[str, int], period: int = PERIOD) -> list[str]:
    """The slots of a first period of whole shares."""
    return list(islice(schedule(shares), period))


def placed_blocks(blocks: dict[str, int], weights: dict[str, float], period: int | None = None) -> Iterator[str]:
    """The source of each slot until all blocks are placed; a phase lasts until the first of its sources runs out."""
    left = {s: n for s, n in blocks.items() if n}
    if any(weights[s] <= 0 for s in left):
        raise ValueError("every source needs a weight above 0")
    while left:
        own = {s: weights[s] for s in left}
        for source in schedule(exact_shares(own) if period is None else whole_shares(own, period)):
            yield source
            left[source] -= 1
            if not left[source]:
                del left[source]
                break


def slots(sources: DataFrame, block_rows: int, period: int | None = None) -> DataFrame:
    """(source, slots): the slot of each block of (source, n, weight), in one task that holds a heap entry for each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: (r[0] is not None, r[0]))
        blocks, weights = {i: -(-n // block_rows) for i, (_, n, _) in enumerate(rows)}, {i: w for i, (_, _, w) in enumerate(rows)}
        places = [array("q") for _ in rows]
        for slot, source in enumerate(placed_blocks(blocks, weights, period)):
            places[source].append(slot)
        for first in range(0, len(rows), BATCH_SOURCES):
            some = range(first, min(len(rows), first + BATCH_SOURCES))
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.string()), pa.array([places[i] for i in some], pa.list_(pa.int64()))], ["source", "slots"])

    return sources.select("source", "n", "weight").coalesce(1).mapInArrow(run, "source string, slots array<long>")


def weighted(sources: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """(source, n, weight): the given weights, or the square roots of the rows. Each source needs a weight above 0."""
    if weights is None:
        return sources.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    given = sources.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "name string, weight double")
    joined = sources.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
    if (lacking := joined.filter("weight IS NULL OR weight <= 0").select("source").first()) is not None:
        raise ValueError(f"source {lacking[0]!r} needs a weight above 0")
    return joined


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_column: str = "doc_id", source_column: str = "source", block_rows: int | None = None, period: int | None = None) -> DataFrame:
    """``docs`` with ``mix_block`` (block inside the source), ``mix_slot`` (its place in the schedule) and ``mix_position``.

    All rows are kept, once each; sorting by ``mix_position`` (0, 1, ..., increasing, with gaps only where a source's last
    block is short) gives the mixture. Default weights are the square roots of the sources' rows; a source without a
    given weight above 0 is an error, and so is a ``period`` of fewer slots than sources. Weights are exact unless a
    ``period`` to round them to is given. Blocks have ``block_rows`` rows: by default 16, or as many as keep the schedule
    within ``MOST_BLOCKS``. Inside a source rows follow a hash of their id, so blocks are mixed themselves; ties and null
    ids follow the id, repeated rows any order among themselves. A null source is a source of its own. Columns of
    ``docs`` with those three names are replaced, others may have any names. An empty table gives an empty result.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_column).cast("string").alias("source"), F.col(id_column).alias("id"), F.xxhash64(F.lit(11), F.col(id_column)).alias("hash"))
    sources = materialize(rows.groupBy("source").agg(F.count("*").alias("n")), "mix-sources")
    total, most = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    block_rows = block_rows or max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    table = F.broadcast(materialize(slots(weighted(sources, weights), block_rows, period), "mix-slots").toDF("of", "slots"))
    buckets = 256 * -(-most // (256 * BUCKET_ROWS)) if most else 256
    spread = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    numbered = numbered_in_groups(spread, "source", "bucket", [F.col("hash"), F.col("id")], "nth").withColumn("block", F.floor(F.col("nth") / block_rows).cast("long"))
    placed = numbered.join(table, F.col("source").eqNullSafe(F.col("of"))).withColumn("place", F.get("slots", F.col("block").cast("int")))
    position = F.col("place") * block_rows + F.col("nth") % block_rows
    return placed.select("row.*", F.col("block").alias("mix_block"), F.col("place").alias("mix_slot"), position.cast("long").alias("mix_position"))


def mixed_order(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, laid out in the order of the mixture over the result's partitions."""
    own = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("of"), F.struct(*docs.columns).alias("row"))
    placed = mix(own, id_column="id", source_column="of", **options).select("row", "mix_position")
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("row.*")
