"""SimHash near-duplicates through a table of pivot distances.

A fingerprint is placed by its Hamming distances to many fixed reference fingerprints. By the triangle inequality
two fingerprints within d bits differ by at most d in every coordinate, so a pair with a larger difference in any
coordinate is discarded unseen; survivors are verified bit by bit.

Which pairs are compared at all comes from the same table. The difference of the distances to the zero reference
and to a reference of one bit tells that bit, so equal coordinates over the one-bit references of a mask mean equal
bits under it (``fingerprint & mask``, which is how a cell is computed). The 64 bits fall into three blocks, and what
lies outside a block into three parts. Of any two fingerprints within two bits, some block is equal, and outside
it some part is: they share one of nine cells of about 36 bits.

A cell with more members than a limit is not paired up. Its members go through an exact form without pairs: each is
listed under itself and its 64 one-bit neighbours; whoever shares such a point is within two bits of the others
there, and whoever is within two bits shares one. A point has at most 65 members, which are linked to the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8_list
from tidemark.storage import materialize

SEED = 42
MAX_BITS = 2
CELL_LIMIT = 48
PIVOTS = 16
BLOCKS = ((0, 22), (22, 43), (43, 64))
BLOCK_SHINGLES = 200_000

_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)


def bits_between(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks() -> list[int]:
    """The nine masks: a block and one of three parts of what lies outside it."""
    found = []
    for low, high in BLOCKS:
        outside = [i for i in range(64) if not low <= i < high]
        cuts = [0, len(outside) // 3, 2 * len(outside) // 3, len(outside)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found.append(signed(bits_between(low, high) | sum(1 << i for i in outside[a:b])))
    return found


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints: hashes of their own numbers."""
    return [signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7)) for i in range(n)]


def set_bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    places = hashes.view(np.uint8).reshape(-1, 8).astype(np.intp) + 256 * np.arange(8)
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def fingerprint(text: bytes | None, words_together: int) -> int:
    """Majority of the bits of all shingle hashes, repeats included; 0 without words. Long texts go by blocks."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    n = max(1, len(words) - words_together + 1)
    ends = (starts + sizes - 1)[min(words_together, len(words)) - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, n, BLOCK_SHINGLES):
        last = min(n, first + BLOCK_SHINGLES)
        pairs = zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)
        counts += set_bit_counts(np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, last - first))
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Majority of the bits of hashes at hand, as a signed number; 0 of none."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), BLOCK_SHINGLES):
        counts += set_bit_counts(hashes[first : first + BLOCK_SHINGLES])
    return signed(int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())))


def fingerprints(docs: DataFrame, words_together: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(text, words_together)) for text in utf8_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [id_column, "fp"])

    id_type = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {id_type}, fp long")


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, coords): the distances of each distinct fingerprint to the pivots."""
    return distinct.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()]).alias("coords"))


def max_coordinate_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b) with a > b: links enough to connect all distinct fingerprints within two bits of each other."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the cells are built for at most two differing bits")
    kinds = [F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks())]
    cells = distinct.select("fp", F.explode(F.array(*kinds)).alias("k")).select("fp", "k.*")
    sizes = cells.groupBy("kind", "cell").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    shared = materialize(cells.join(sizes, ["kind", "cell"]), "simhash-cells")
    small = shared.filter(F.col("members") <= cell_limit).select("kind", "cell", "fp")
    table = pivot_table(small.select("fp").distinct())
    placed = small.join(table, "fp")
    left = placed.select("kind", "cell", F.col("fp").alias("a"), F.col("coords").alias("coords_a"))
    right = placed.select("kind", "cell", F.col("fp").alias("b"), F.col("coords").alias("coords_b"))
    pairs = left.join(right, ["kind", "cell"]).filter(F.col("a") > F.col("b"))
    near = pairs.filter(max_coordinate_difference(F.col("coords_a"), F.col("coords_b")) <= max_bits)
    verified = near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    crowded = shared.filter(F.col("members") > cell_limit).select("fp").distinct()
    return verified.unionByName(crowded_links(crowded, max_bits)).distinct()


def crowded_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links among fingerprints of crowded cells, through shared points; no pairs are made."""
    flips = [F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)]]
    points = distinct.select("fp", F.explode(F.array(*flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    if max_bits < 2:  # a shared point then says too much: members of one bit are linked to the point itself, if it exists
        own = distinct.select(F.col("fp").alias("point"))
        return points.join(own, "point").filter(F.col("fp") > F.col("point")).select(F.col("fp").alias("a"), F.col("point").alias("b")).filter(F.lit(max_bits == 1))
    least = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    linked = least.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
    return linked.filter(F.col("a") > F.col("b")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, by rounds of star contraction.

    A round links all larger neighbours of a node to the least one near it, then all smaller ones; each round keeps
    every component connected. Rounds, about the logarithm of the longest chain, end when nothing changes; each is
    written to the shared folder. Only a count and a checksum come to the driver.
    """
    edges = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        edges = materialize(small_star(large_star(edges)), "star-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, words_together: int = 3, max_bits: int = MAX_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links of at most ``max_bits`` differing bits.

    Null and empty texts have fingerprint zero, which links like any other. Equal fingerprints are one node of the
    graph, so copies of any number never make pairs. Rows with a null id link others but are nobody's component;
    where no id is left, ``component_id`` is null. Repeated rows each give a row; an empty table gives an empty
    result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, words_together, id_column, text_column), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_column).alias("first_id")), "distinct-fingerprints")
    roots = materialize(components(links(nodes.select("fp"), max_bits)), "components")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(first, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(id_column, "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
