"""Sharding by fixed virtual slots.

Records hash into thousands of slots that never change. The bytes of each slot are summed, and a versioned map
says which shard holds which slot. Rebalancing edits the map, not the hash, so only the slots it names move.
The map has one row for each slot, a number fixed by parameter, whatever the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import numbered_in_groups
from tidemark.storage import materialize, new_path

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, slot_bytes long, shard int"

SlotMap = list[tuple[int, int, int]]  # (virtual slot, bytes, shard)


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def virtual_slot(doc_id: Column, text_crc: Column, slots: int) -> Column:
    """The fixed slot of a record: a hash of its id, or of its text where the id is null."""
    return F.pmod(F.xxhash64(doc_id, F.when(doc_id.isNull(), text_crc)), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int) -> list[tuple[int, int]]:
    """(slot, bytes) of every slot, empty ones included: at most ``slots`` rows."""
    found = {r[0]: r[1] for r in records.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    return [(slot, found.get(slot, 0)) for slot in range(slots)]


def place_slots(sizes: list[tuple[int, int]], shards: int) -> SlotMap:
    """A first map: the largest slot left goes to the shard with the fewest bytes (ties: the lowest number)."""
    loads = [(0, shard) for shard in range(shards)]
    placed = []
    for slot, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, shard))
        placed.append((slot, size, shard))
    return sorted(placed)


def rebalance(current: SlotMap, sizes: list[tuple[int, int]], shards: int) -> SlotMap:
    """An edited map for new slot sizes or a new number of shards; slots move only from over-full to under-full shards.

    Slots of shards that no longer exist move first. Then, while a slot fits into the gap between the fullest and
    the emptiest shard, the largest such slot moves.
    """
    size = dict(sizes)
    home = {slot: shard for slot, _, shard in current}
    loads = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = []
    for slot in size:
        shard = home.get(slot, shards)
        if shard < shards:
            loads[shard] += size[slot]
            held[shard].add(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-size[s], s)):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        loads[shard] += size[slot]
        held[shard].add(slot)
    while True:
        full, empty = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        gap = loads[full] - loads[empty]
        fits = [s for s in held[full] if 0 < size[s] <= gap // 2]
        if not fits:
            break
        slot = max(fits, key=lambda s: (size[s], -s))
        held[full].remove(slot)
        held[empty].add(slot)
        loads[full] -= size[slot]
        loads[empty] += size[slot]
    return sorted((slot, size[slot], shard) for shard in range(shards) for slot in held[shard])


def store_map(spark: SparkSession, slot_map: SlotMap, path: str, version: int) -> None:
    """Write one version of the map beside the earlier ones, which stay readable."""
    rows = [(version, *x) for x in slot_map]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version:06d}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version:06d}")


def store_rebalanced(records: DataFrame, path: str, version: int, shards: int, slots: int = SLOTS) -> int:
    """Read one version of the map, edit it for the bytes that (virtual_slot, size) records now hold, and store the next one.

    Returns the new version's number. The version read stays as it was.
    """
    spark = records.sparkSession
    held = [(r["virtual_slot"], r["slot_bytes"], r["shard"]) for r in read_map(spark, path, version).collect()]
    store_map(spark, rebalance(held, slot_bytes(records, slots), shards), path, version + 1)
    return version + 1


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, map_path: str | None = None, version: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Put all rows into ``shards`` shards of nearly equal bytes.

    Returns for each row the id column, ``size``, ``text_crc32`` (null text: empty), ``law`` ('bytes'), ``shard``, ``slot``
    (its place inside the shard, gapless from 0), ``grown_shard`` (null under this law), ``virtual_slot`` and
    ``map_version``. Null ids spread by their text; rows with the same id share a virtual slot and are numbered in
    order of id and text checksum; an empty table gives an empty result; other columns are not read. Equal texts with
    unlike ids are records of their own and may lie in several shards. The map is written under ``map_path`` (default:
    the shared folder): version 0 of a new map, or, where an earlier ``version`` is named, its successor, in which slots
    have moved only as far as the bytes or the number of shards ask. Rows cross the network once, without text.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    sized = docs.select(F.col(id_column), record_size(F.col(text_column)).alias("size"), crc.alias("text_crc32"))
    records = materialize(sized.withColumn("virtual_slot", virtual_slot(F.col(id_column), F.col("text_crc32"), slots)), "shard-records")
    path = map_path or new_path(spark, "slot-map")
    if version is None:
        store_map(spark, place_slots(slot_bytes(records, slots), shards), path, 0)
    version = 0 if version is None else store_rebalanced(records, path, version, shards, slots)
    slot_map = read_map(spark, path, version).select(F.col("version").alias("map_version"), F.col("virtual_slot").alias("_slot"), "shard")
    mapped = records.join(F.broadcast(slot_map), records["virtual_slot"] == F.col("_slot")).drop("_slot")
    numbered = numbered_in_groups(mapped, "shard", "virtual_slot", [F.col(id_column), F.col("text_crc32"), F.col("size")], "slot")
    return numbered.select(id_column, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
