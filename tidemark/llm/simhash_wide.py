"""Near-duplicates at a similarity of 0.8 on sets of five-word shingles: an exact prefix-filter join with pivots.

Each distinct set is put in one order for all documents, rare shingles first, and listed under the shingles of its
prefix: two sets of n shingles each that are similar enough share k among the first n - ceil(0.8 n) + k. Every order
that is the same for all keeps this true, so a sketch of a fixed size may tell how frequent a shingle is; it only
decides how long the lists get. k grows with the set, and a set in fewer lists with other groups than its least k is linked
to none of them and goes: a passage that long texts share by chance crowds no list.

First come the pairs that op5's method names: sets whose SimHash fingerprints lie within two bits, through cells and the
table of pivot distances. Near copies at a similarity of 0.8 differ in about ten bits, so this finds only the closest, and
the lists find the rest. No estimate by bits decides: whole sets do, for every pair.

What is wanted are groups, not all pairs, so the members of each list are first held against a few of them. Each such
round is linear in the lists. After that only pairs in different groups are left to compare. The pivot of the lists with one largest
group is the set of the shingles that most of their members have, and each member is known by its difference from the pivot. Two sets differ by
just what their two differences do not share. So near ones either lie so close to the pivot that they are linked for certain, which
the nearest of all says for each of them, or their differences share a rare shingle: a prefix filter once more. A passage that all have
brings nobody together then, and neither does membership of a large group of near copies; only changes that two sets share do.
Such pairs are compared.

Texts are hashed where they lie, a pass for each need: sets are neither stored nor shuffled, but for those that a pair
names. A set is known by 64 bits of hash of all its shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import simhash
from tidemark.llm.common import unused, utf8_list
from tidemark.llm.simhash import SEED, components, fingerprint_of
from tidemark.storage import materialize, scratch

SHARE = (4, 5)  # the least similarity, exactly
SHINGLE_WORDS = 5
SHARED_SIZE = 80  # for every so many shingles of a set, one more that its prefix must share
ROUNDS = 2
LEADERS = 4  # of a member in a round; what this leaves out is compared after the rounds
BROADCAST_IDS = 400_000
FEW_NODES = 32  # around one pivot, all of which meet in their lists at once; more go by differences, which is exact too
SALT_MEMBERS = 256
PART_NODES = 32  # or up to twice as many whole sets are counted together
SKETCH_BITS = 20
SKETCH_ROW = 1024
SKETCH_FANS = 256
SEEN_NODES = 1_000_000


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct five-word shingles of the whole text (fewer words: of the whole sequence; none: none)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = (np.cumsum(sizes) - sizes).tolist()
    ends = (np.cumsum(sizes) - 1)[min(SHINGLE_WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter({digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=False)}, np.uint64)


def node_of(hashes: np.ndarray) -> int:
    """64 bits that tell a sorted set of shingle hashes from others."""
    h = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def sets_in(batches: Iterator[pa.RecordBatch], at: int, each_once: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row in its batch, node, sorted hashes) of the texts in column ``at``; with ``each_once`` most copies in a task are skipped."""
    seen: set[int] = set()
    for batch in batches:
        for row, text in enumerate(utf8_list(batch.column(at))):
            hashes = np.sort(shingle_hashes(text))
            node = node_of(hashes)
            if each_once and node in seen:
                continue
            if each_once:
                seen.add(node)
                if len(seen) > SEEN_NODES:
                    seen.clear()
            yield row, node, hashes


def places(hashes: np.ndarray) -> np.ndarray:
    """The sketch's bucket of each hash."""
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(f"<u{next(n for n in (1, 2, 4, 8) if counts.max() < 1 << 8 * n)}").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.frombuffer(held, f"<u{len(held) // SKETCH_ROW}").astype(np.int64)


def described(texts: DataFrame) -> DataFrame:
    """(id, text_hash, node, n, fp) of every row of (id, text_hash, text), and rows (part, fan, counts) of the sketch.

    The sketch counts how many shingles of a task's sets fall into each bucket, ``SKETCH_ROW`` buckets a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        seen: set[int] = set()
        fan = 0
        for batch in batches:
            nodes, sizes, prints = [], [], []
            for _, node, hashes in sets_in(iter([batch]), 2, False):
                nodes.append(node)
                sizes.append(len(hashes))
                prints.append(fingerprint_of(hashes))
                if node not in seen:
                    seen.add(node)
                    at, n = np.unique(places(hashes), return_counts=True)
                    counts[at] += n.astype(np.int32)
            if len(seen) > SEEN_NODES:
                seen.clear()
            fan ^= sum(nodes) % SKETCH_FANS
            none = [None] * len(nodes)
            yield named([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary())])
        parts = counts.reshape(-1, SKETCH_ROW)
        used = np.flatnonzero(parts.any(axis=1))
        for first in range(0, len(used), 256):
            some = used[first : first + 256]
            none = pa.array([None] * len(some), pa.int64())
            yield named([none, none, none, none, none, pa.array(some, pa.int32()), pa.array([fan] * len(some), pa.int32()), pa.array([packed(parts[p]) for p in some], pa.binary())])

    def named(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "node", "n", "fp", "part", "fan", "counts"])

    return texts.mapInArrow(run, "id long, text_hash long, node long, n long, fp long, part int, fan int, counts binary")


def frequencies(sketch: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bucket: rows add up by fan first, so no group grows with the tasks."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_ROW, np.int64)
        for counts in table.column("counts"):
            total += unpacked(counts.as_py())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([packed(total)], pa.binary())})

    schema = "part int, counts binary"
    found = np.zeros(((1 << SKETCH_BITS) // SKETCH_ROW, SKETCH_ROW), np.int64)
    by_fan = sketch.groupBy("part", "fan").applyInArrow(lambda table: add(table), schema)
    for row in by_fan.groupBy("part").applyInArrow(add, schema).toLocalIterator():
        found[row["part"]] = unpacked(bytes(row["counts"]))
    return found.ravel()


def shared_at_least(n: int | Column) -> int | Column:
    """How many shingles the prefix of a set of ``n`` must share with that of any set similar enough and not smaller."""
    return F.floor(n / SHARED_SIZE) + 1 if isinstance(n, Column) else n // SHARED_SIZE + 1


def prefix_size(n: int) -> int:
    """Of two sets with ``o`` common shingles, the k-th of them is among the first n - o + k of either, and o is at least ceil(0.8 n)."""
    return n - -(-SHARE[0] * n // SHARE[1]) + shared_at_least(n)


def prefixes(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(shingle, node, n, at): the shingles of each set's prefix and their places in it; copies in several tasks repeat."""
    shared = texts.sparkSession.sparkContext.broadcast(counts.astype(np.float32))  # of about equal counts any order will do

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        nodes, sizes, heads, held = [], [], [], 0
        for _, node, hashes in sets_in(batches, 0, True):
            if not len(hashes):
                continue
            order = np.lexsort((hashes, counts[places(hashes)]))
            head = hashes[order[: prefix_size(len(hashes))]]
            nodes.append(node)
            sizes.append(len(hashes))
            heads.append(head)
            held += len(head)
            if held > 200_000:
                yield listed(nodes, sizes, heads)
                nodes, sizes, heads, held = [], [], [], 0
        if nodes:
            yield listed(nodes, sizes, heads)

    def listed(nodes: list[int], sizes: list[int], heads: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        columns = [np.concatenate(heads).view(np.int64), np.repeat(np.array(nodes, np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths), at.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "n", "at"])

    return texts.select("text").mapInArrow(run, "shingle long, node long, n int, at int")


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the sets of ``wanted`` (id, text_hash), whose rows are the only ones that move or are hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(node, hashes.view(np.int64)) for _, node, hashes in sets_in(iter([batch]), 0, True)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.list_(pa.int64()))], ["node", "hashes"])

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    return texts.join(few, ["id", "text_hash"], "left_semi").select("text").mapInArrow(run, "node long, hashes array<long>")


def enough(common: Column, n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes with so many common shingles are similar enough."""
    return common * (SHARE[0] + SHARE[1]) >= SHARE[0] * (n_a + n_b)


def open_pair(a: str, b: str) -> Column:
    """Whether two members of a list, if its shingle is the first they share, can be similar enough: by sizes and places."""
    n_a, n_b, at_a, at_b = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
    return enough(F.least(n_a - at_a, n_b - at_b), n_a, n_b)


def measured(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, distance, linked) of the pairs (a, b): the Jaccard distance of their sets and whether they are similar enough.

    ``fetch`` gives the sets of nodes. A pair may come more than once, with the same values.
    """
    pairs = materialize(pairs, "wide-pairs")
    own = materialize(fetch(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "wide-sets")
    joined = pairs.join(own.toDF("a", "of_a"), "a").join(own.toDF("b", "of_b"), "b")
    counted = joined.select("a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    return counted.select("a", "b", (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("distance"), enough(F.col("common"), F.col("n_a"), F.col("n_b")).alias("linked"))


def grouped(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists with each member's group so far; lists inside one group go, for they have no pair left to compare.

    So do members in too few lists: a set that is linked to one of another group shares as many lists with it as the smaller
    of the two must, and that one has 0.8 of its shingles at least.
    """
    named = lists.drop("group").join(roots.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    several = named.groupBy("shingle").agg(F.min("group").alias("_least"), F.max("group").alias("_most")).filter("_least < _most").select("shingle")
    between = materialize(named.join(several, "shingle", "left_semi"), "wide-between")
    smallest = F.ceil(F.max("n") * SHARE[0] / SHARE[1])
    enough_lists = between.groupBy("node").agg(F.count("*").alias("_lists"), shared_at_least(smallest).alias("_least")).filter("_lists >= _least").select("node")
    return materialize(between.join(enough_lists, "node", "left_semi"), "wide-lists")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def nearest_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each member ``m`` with those ``l`` of what it met that it shares most lists with."""
    shared = met.select(F.col("m.node").alias("x"), F.col("l.node").alias("y")).groupBy("x", "y").agg(F.count("*").alias("lists"))
    nearest = shared.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("lists"), "y"))).filter(F.col("nth") <= LEADERS)
    return nearest.select(*ordered(F.col("x"), F.col("y"))).distinct()


def with_main(lists: DataFrame) -> DataFrame:
    """The lists with their largest group, which is named by its first set, and their number of members."""
    sizes = lists.groupBy("shingle", "group").agg(F.count("*").alias("c"))
    return lists.join(sizes.groupBy("shingle").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.sum("c").alias("members")), "shingle")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of (node, fp): pairs enough to connect all sets whose fingerprints chains of at most two differing bits connect."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "wide-fingerprints")
    same = nodes.join(firsts, "fp").filter(F.col("node") != F.col("first")).select(*ordered(F.col("node"), F.col("first")))
    near = simhash.links(firsts.select("fp")).join(firsts.toDF("a", "of_a"), "a").join(firsts.toDF("b", "of_b"), "b")
    return same.unionByName(near.select(*ordered(F.col("of_a"), F.col("of_b")))).distinct()


def links(posted: DataFrame, named: DataFrame, fetch: Callable[[DataFrame], DataFrame], counts: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) with a > b: links enough to connect all sets that chains of similar enough pairs connect. Pairs ``named`` are measured first."""
    shared = posted.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("shingle")
    tested = materialize(measured(named, fetch), "wide-tested")
    roots = materialize(components(tested.filter("linked").select("a", "b")), "wide-components")
    lists = grouped(materialize(posted.join(shared, "shingle", "left_semi").dropDuplicates(["shingle", "node"]), "wide-shared"), roots)
    for i in range(rounds):
        member = F.struct("node", "n", "at", "group")
        first = F.col("node") if i == 0 else F.xxhash64("node", F.lit(i))
        leaders = materialize(lists.groupBy("shingle").agg(F.min_by(member, first).alias("l")).select("shingle", "l.*"), "wide-leaders")
        held = lists.alias("m").join(leaders.alias("l"), (F.col("m.shingle") == F.col("l.shingle")) & (F.col("m.group") != F.col("l.group")) & open_pair("m", "l"))
        pairs = nearest_pairs(held).join(tested, ["a", "b"], "left_anti")
        tested = tested.unionByName(materialize(measured(pairs, fetch), "wide-tested"))
        roots = materialize(components(tested.filter("linked").select("a", "b")), "wide-components")
        lists = grouped(lists, roots)
    # what is left differs from what most sets around its lists' largest groups hold by parts that others share, or is linked through the set nearest to that
    marked = materialize(with_main(lists), "wide-marked")
    sizes = marked.select("node", "main").distinct().groupBy("main").agg(F.count("*").alias("nodes"))
    few, many = marked.join(sizes.filter(F.col("nodes") <= FEW_NODES), "main", "left_semi"), marked.join(sizes.filter(F.col("nodes") > FEW_NODES), "main")
    once = (F.col("o.shingle") == F.col("e.shingle")) & (F.col("o.group") != F.col("e.group")) & (F.col("o.node") > F.col("e.node"))
    close = few.alias("o").join(few.alias("e"), once & open_pair("o", "e")).select(*ordered(F.col("o.node"), F.col("e.node")))
    rows = materialize(differences(many.select("node", "group", "main", "nodes").distinct(), fetch, counts), "wide-differences")
    one = rows.filter("at < 0")
    nearest = one.groupBy("main").agg(F.min(F.struct("excess", "node")).alias("_m")).select("main", F.col("_m.excess").alias("least"), F.col("_m.node").alias("nearest"))
    certain = one.join(nearest, "main").filter((F.col("excess") + F.col("least") <= 0) & (F.col("node") != F.col("nearest"))).select(*ordered(F.col("node"), F.col("nearest")))
    pairs = differing_pairs(rows.filter("at >= 0")).unionByName(close).distinct().join(tested, ["a", "b"], "left_anti")
    rest = materialize(measured(pairs, fetch), "wide-tested")
    return tested.unionByName(rest).filter("linked").select("a", "b").unionByName(certain)


def held_by_most(part: pa.Table) -> pa.Table:
    """(main, shingle, votes, nodes) of one part (main, nodes, part, of_node): the shingles that more than half of its sets hold, with all its sets as votes."""
    shingles, held = np.unique(np.concatenate([chunk.flatten().to_numpy() for chunk in part.column("of_node").chunks]), return_counts=True)
    most = shingles[2 * held > len(part)]
    main, nodes = part.column("main")[0].as_py(), part.column("nodes")[0].as_py()
    return pa.table([pa.array(most), *[pa.array(np.full(len(most), value, np.int64)) for value in (main, len(part), nodes)]], names=["shingle", "main", "votes", "nodes"]).select(["main", "shingle", "votes", "nodes"])


def centers_of(sets: DataFrame) -> DataFrame:
    """(main, of_main) of (node, main, nodes, of_node): the shingles that most sets hold in parts with most of the main's sets.

    Sets are dealt into parts of bounded size and counted there, so that a part gives at most twice the shingles of its mean
    set, not a row for each shingle of each set. In one part that is the majority itself; of many it need not be, and any
    center is exact. A center has at most four times the shingles of the mean set.
    """
    part = F.pmod(F.xxhash64("node"), F.greatest(F.floor(F.col("nodes") / PART_NODES), F.lit(1))).alias("part")
    votes = sets.select("main", "nodes", part, "of_node").groupBy("main", "part").applyInArrow(held_by_most, "main long, shingle long, votes long, nodes long")
    most = votes.groupBy("main", "shingle").agg(F.sum("votes").alias("votes"), F.max("nodes").alias("nodes")).filter("votes * 2 > nodes")
    return most.groupBy("main").agg(F.collect_list("shingle").alias("of_main"))


def differences(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], counts: np.ndarray) -> DataFrame:
    """Of each (node, group, main, nodes): what its set does not share with the center of ``main``, the shingles of most of its nodes.

    ``nodes`` is how many nodes the main has. In the row with ``at`` = -1, ``d`` is the size of the symmetric difference, and ``excess`` makes two nodes of one main certain
    to be linked where theirs add up to 0 or less. The other rows hold the first shingles of the difference: those that the
    center lacks before those that only it has, rare ones first, one more than a link may leave unshared.
    """
    shared = members.sparkSession.sparkContext.broadcast(counts.astype(np.float32))
    members = materialize(members, "wide-members")
    own = materialize(fetch(members.select("node").distinct()), "wide-sets").toDF("node", "of_node")
    centers = materialize(centers_of(members.join(own, "node")), "wide-centers")
    joined = members.join(own, "node").join(centers, "main", "left").select("node", "main", "group", "of_node", F.coalesce("of_main", F.array().cast("array<bigint>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value

        def rare_first(hashes: np.ndarray) -> np.ndarray:
            return hashes[np.lexsort((hashes, counts[places(hashes)]))]

        for batch in batches:
            held, out = 0, []
            for row in range(len(batch)):
                node, main, group = (batch.column(i)[row].as_py() for i in range(3))
                x, y = (np.sort(batch.column(i)[row].values.to_numpy().view(np.uint64)) for i in (3, 4))
                more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                head = np.concatenate([rare_first(more), rare_first(less)])[: len(x) * (SHARE[1] - SHARE[0]) // SHARE[0] + 1]
                d = len(more) + len(less)
                out.append(((node, main, group, len(x), d, (SHARE[0] + SHARE[1]) * d - (SHARE[1] - SHARE[0]) * len(x)), head))
                held += len(head)
                if held > 200_000:
                    yield listed(out)
                    held, out = 0, []
            if out:
                yield listed(out)

    def listed(out: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(head) + 1 for _, head in out], np.int64)
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) - 1
        elements = np.concatenate([part for _, head in out for part in (np.zeros(1, np.int64), head.view(np.int64))])
        columns = [np.repeat(np.array(values), lengths) for values in zip(*(known for known, _ in out), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, elements, at]], names)

    names = ["node", "main", "group", "n", "d", "excess", "shingle", "at"]
    return joined.mapInArrow(run, ", ".join(f"`{name}` long" for name in names))


def differing_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) in two groups, one outside the largest, whose differences from one main share enough to be linked, by what is known.

    Sets x and y differ by the symmetric difference of D(x) and D(y), their differences from any third set. A link leaves at most
    n / 4 shingles in it (at a similarity of 0.8), so unless ``excess`` adds up to 0 or less the two D share some shingle: among the first n / 4 + 1
    of the larger and the first n / 8 + 1 of the smaller. What all have in common, such as a passage, brings no one together.
    """
    keys = rows.groupBy("main", "shingle").agg(F.min("group").alias("_least"), F.max("group").alias("_most"), F.count_if(F.col("group") != F.col("main")).alias("_outside"))
    several = keys.filter("_least < _most").select("main", "shingle", (F.col("_outside") / SALT_MEMBERS).cast("int").alias("salts"))
    near = rows.withColumn("early", F.col("at") * 2 * SHARE[0] <= F.col("n") * (SHARE[1] - SHARE[0]))
    near = materialize(near.join(several, ["main", "shingle"]), "wide-several")
    outside = near.filter(F.col("group") != F.col("main")).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts") + 1).cast("int"))
    everyone = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts"))))
    o, e = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"e.{c}"))
    met = (o("main") == e("main")) & (o("shingle") == e("shingle")) & (o("salt") == e("salt")) & (o("group") != e("group"))
    once = (e("group") == e("main")) | (o("node") > e("node"))
    early = ((o("d") >= e("d")) & e("early")) | ((o("d") <= e("d")) & o("early"))
    sizes = F.least(o("n"), e("n")) * SHARE[1] >= F.greatest(o("n"), e("n")) * SHARE[0]
    excess = o("excess") + e("excess")
    shared = 2 * (SHARE[0] + SHARE[1]) * F.least(o("d") - o("at"), e("d") - e("at")) >= excess
    pairs = outside.alias("o").join(everyone.alias("e"), met & once & early & sizes & (excess > 0) & shared)
    return pairs.select(*ordered(o("node"), e("node"))).distinct()


def near_duplicate_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, text_hash, component_id) of every row that has an id: the smallest id of its group.

    Texts that differ only in white space or the case of A-Z are equal, and one node of the graph; texts without a
    word, null ones included, are one group. ``text_hash`` (xxhash64) tells rows apart that repeat an id with another text.
    """
    text = F.col(text_column).cast("string")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).filter(F.col("id").isNotNull())
    found = materialize(described(texts), "wide-rows")
    rows = found.filter(F.col("id").isNotNull()).select("id", "text_hash", "node", "n", "fp")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.max("n").alias("n"), F.max("fp").alias("fp")).select("node", "first.*", "n", "fp"), "wide-nodes")
    counts = frequencies(found.filter(F.col("part").isNotNull()).select("part", "fan", "counts"))
    posted = materialize(prefixes(texts, counts), "wide-prefixes")

    def fetch(wanted: DataFrame) -> DataFrame:
        return sets_of(texts, materialize(nodes.join(wanted, "node", "left_semi").select("id", "text_hash"), "wide-wanted"))

    near = fingerprint_pairs(nodes.filter("n > 0").select("node", "fp"))
    roots = materialize(components(links(posted, near, fetch, counts, rounds)), "wide-components")
    rooted = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = rooted.join(first, "root").select("node", "component_id")
    return rows.join(labels, "node").select("id", "text_hash", "component_id")


def near_duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, component_id): the smallest id of the group of every row; rows with a null id are left out."""
    return near_duplicate_rows(docs, id_column, text_column, rounds).select(F.col("id").alias(id_column), "component_id")


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, with all their columns.

    Rows with a null id stay. Rows that repeat an id are told apart by their texts, so a text goes only for its own
    group; rows that repeat both are one document, and stay or go together. An empty table gives an empty result.
    Only ids and hashes cross the network here: rows that go are taken out by an anti join. Columns of ``docs`` may
    have any names.
    """
    id_name, hash_name = unused(docs, 2)
    with scratch(docs.sparkSession):
        groups = near_duplicate_rows(docs, id_column, text_column)
        gone = groups.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct()
        gone = materialize(gone, "wide-gone", keep=True)
        del groups
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = (docs[id_column].cast("long") == F.col(id_name)) & (F.xxhash64(docs[text_column].cast("string")) == F.col(hash_name))
    return docs.join(gone, same, "left_anti")
