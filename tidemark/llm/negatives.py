"""Hard negatives by threshold joins over an inverted index.

For each anchor two questions are asked of all other vectors: which are nearest with its own label (the positives), and
for each positive, which with another label are nearest below a share of its score. Both are windows on the score
that want a number of rows, best first. A window is searched with a high threshold first; as long as it is not full the
threshold is lowered, and what a threshold has filled is final, for all that it passed over scores less.

A search deals rows and anchors into blocks and joins each block of the one with each block of the other, so that no task
holds more than two blocks. Within a pair of blocks:

* dimensions are ordered by the energy they carry, so that the norms of what is left of a vector fall fast;
* a row is indexed only up to the part after which the norm of its rest, times the greatest such norm of any
  anchor, stays below the least threshold: such a pair cannot come from the rest alone;
* posting lists of a part hold the rows that are indexed there, and an anchor's partial scores grow list by list;
* a pair goes as soon as its partial score and the product of both remaining norms stay below the anchor's threshold;
* what survives is scored over all dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import materialize

ROWS_IN_BLOCK = 16_384
ANCHORS_IN_BLOCK = 4_096
LEAST_BLOCKS = 16
PART = 8  # dimensions between two looks at the bounds
PAIRS_AT_ONCE = 1_000_000
EXACT = float(1 << 53)
#: Shares of the greatest score that an anchor can have; the last threshold lets everything through.
POSITIVE_STEPS = (0.5, 0.25, None)
#: How far up a window its threshold lies.
NEGATIVE_STEPS = (0.75, 0.0)


@dataclass
class Index:
    """Rows of a block, those indexed furthest first."""

    rows: np.ndarray  # their places in the block
    vectors: np.ndarray
    rest: np.ndarray  # norms of what each row has from a part on
    parts: np.ndarray  # how many parts of each row are indexed
    listed: np.ndarray  # length of the posting lists of each part


def rest_norms(vectors: np.ndarray) -> np.ndarray:
    """(row, part): norm of the dimensions from the part on; one more column of zeros ends it."""
    squares = np.add.reduceat(vectors**2, np.arange(0, vectors.shape[1], PART), axis=1)
    rest = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return np.hstack([rest * (1 + 1e-9), np.zeros((len(vectors), 1))])


def indexed(vectors: np.ndarray, anchor_rest: np.ndarray, least: float) -> Index:
    """Omits from the lists what the norms of the rest keep below the least threshold of any anchor."""
    rest = rest_norms(vectors)
    needed = rest * anchor_rest.max(axis=0) >= least
    parts = np.where(needed[:, :-1].any(axis=1), needed.shape[1] - 1 - np.argmax(needed[:, -2::-1], axis=1), 0)
    order = np.argsort(-parts, kind="stable")
    listed = np.array([(parts > p).sum() for p in range(rest.shape[1] - 1)])
    return Index(order, vectors[order], rest[order], parts[order], listed)


def candidates(index: Index, anchors: np.ndarray, anchor_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, place in the index) of the pairs that no bound rules out."""
    scores = np.zeros((len(anchors), len(index.rows)))
    alive = np.ones(scores.shape, bool)
    low = (least - 1e-6)[:, None]
    for part, n in enumerate(index.listed.tolist()):
        if not n:
            break
        dims = slice(part * PART, (part + 1) * PART)
        scores[:, :n] += anchors[:, dims] @ index.vectors[:n, dims].T
        if np.isfinite(low).any() and (part % 2 or part + 1 == len(index.listed)):
            done = np.minimum(index.parts, part + 1)
            alive = scores + anchor_rest[:, done] * index.rest[np.arange(len(done)), done] >= low
            if alive.mean() < 0.05:
                break  # few enough to score one by one
    if not index.listed.size or not index.listed[0]:
        alive = anchor_rest[:, :1] * index.rest[:, 0] >= low
    return np.nonzero(alive)


def exact_scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of the pairs as longs; doubles hold them exactly up to 2^53, beyond that longs are multiplied."""
    found = np.zeros(len(a), np.int64)
    fits = len(anchors) and len(rows) and np.abs(anchors).max() * np.abs(rows).max() * anchors.shape[1] < EXACT
    kind = np.float64 if fits else np.int64
    anchors, rows = anchors.astype(kind), rows.astype(kind)
    for i in range(0, len(a), 100_000):
        found[i : i + 100_000] = np.einsum("ij,ij->i", anchors[a[i : i + 100_000]], rows[r[i : i + 100_000]])
    return found


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, need: int) -> np.ndarray:
    """Places of the ``need`` best of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    sorted_groups = groups[order]
    first = np.searchsorted(sorted_groups, sorted_groups)
    return order[np.arange(len(order)) - first < need]


def join_blocks(rows: dict[str, np.ndarray], anchors: dict[str, np.ndarray], same: bool, need: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor number, window, row id, score) of the best rows of this block in each window of each anchor."""
    energy = np.argsort(-(rows["v"] ** 2).sum(axis=0), kind="stable")
    row_vectors, anchor_vectors = rows["v"][:, energy], anchors["v"][:, energy]
    anchor_rest = rest_norms(anchor_vectors)
    labels = np.intersect1d(rows["label"], anchors["label"]) if same else [None]
    for label in labels:
        of_rows = np.flatnonzero(rows["label"] == label) if same else np.arange(len(rows["label"]))
        of_anchors = np.flatnonzero(anchors["label"] == label) if same else np.arange(len(anchors["label"]))
        least = anchors["least"][of_anchors].min(axis=1)
        index = indexed(row_vectors[of_rows], anchor_rest[of_anchors], least.min())
        step = max(1, PAIRS_AT_ONCE // max(1, len(of_rows)))
        for i in range(0, len(of_anchors), step):
            own = of_anchors[i : i + step]
            a, r = candidates(index, anchor_vectors[own], anchor_rest[own], least[i : i + step])
            a, r = own[a], of_rows[index.rows[r]]
            fit = (rows["id"][r] != anchors["id"][a]) & ((rows["label"][r] == anchors["label"][a]) == same)
            a, r = a[fit], r[fit]
            score = exact_scores(anchors["v"], rows["v"], a, r)
            for w in range(anchors["least"].shape[1]):
                inside = np.flatnonzero((score >= anchors["least"][a, w]) & (score <= anchors["most"][a, w]))
                inside = inside[best(a[inside], score[inside], rows["id"][r[inside]], need)]
                yield anchors["a"][a[inside]], anchors["w"][a[inside], w], rows["id"][r[inside]], score[inside]


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def search(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, need: int, grid: tuple[int, int]) -> DataFrame:
    """(a, w, vec_id, score, rank): the ``need`` best rows of each window (a, w, least, most), by label ``same`` as the anchor's or not."""
    listed = windows.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("w", "least", "most"))).alias("ws"))
    slots = F.max(F.size("ws"))
    n_slots = listed.agg(slots.alias("n")).first()["n"] or 1
    spare = F.struct(F.lit(-1).alias("w"), F.lit(float("inf")).alias("least"), F.lit(float("-inf")).alias("most"))
    padded = F.concat("ws", F.array_repeat(spare, F.lit(n_slots) - F.size("ws")))
    asked = anchors.join(listed.select("a", padded.alias("ws")), "a").select("a", "anchor_id", "label", "v", "anchor_block", *[F.col(f"ws.{c}").alias(c) for c in ("w", "least", "most")])
    row_blocks, anchor_blocks = grid
    left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchor_block"))
    right = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"))

    def run(of_rows: pa.Table, of_anchors: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(of_rows) and len(of_anchors):
            ours = {c: of_rows[c].to_numpy() for c in ("label",)} | {"id": of_rows["vec_id"].to_numpy(), "v": matrix(of_rows["v"], len(of_rows))}
            theirs = {c: of_anchors[c].to_numpy() for c in ("a", "label")} | {c: matrix(of_anchors[c], len(of_anchors)) for c in ("v", "least", "most")}
            theirs |= {"id": of_anchors["anchor_id"].to_numpy(), "w": matrix(of_anchors["w"], len(of_anchors)).astype(np.int32)}
            found = list(join_blocks(ours, theirs, same, need))
        columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(4)]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("a", "w", "vec_id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    keys = ("row_block", "anchor_block")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, w int, vec_id long, score long")
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= need)


def fill(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, need: int, grid: tuple[int, int], steps: tuple) -> DataFrame:
    """The rows of each window (a, w, low, high), by thresholds that are lowered until the window is full."""
    found = None
    for step in steps:
        last = step == steps[-1]
        share = F.lit(None if step is None else float(step))
        least = F.coalesce(F.greatest(F.col("low"), F.col("base") + share * (F.col("high") - F.col("base"))), F.col("low"))
        asked = windows.select("a", "w", (F.col("low") if last else least).alias("least"), F.col("most"))
        hits = materialize(search(rows, anchors, asked, same, need, grid), "negatives-hits")
        full = hits.filter(F.col("rank") == need).select("a", "w")
        done = hits if last else hits.join(full, ["a", "w"], "left_semi")
        found = done if found is None else found.unionByName(done)
        if not last:
            windows = materialize(windows.join(full, ["a", "w"], "left_anti"), "negatives-open")
            if windows.isEmpty():
                break
    return found


def valid_vectors(rows: DataFrame, scale: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; ``v`` has whole numbers, as doubles."""
    x = F.col(vector_column)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("double"))
    return rows.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull() & sound).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), whole.alias("v"))


def hard_negatives(
    rows: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rows_in_block: int = ROWS_IN_BLOCK, anchors_in_block: int = ANCHORS_IN_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors and their positives.

    Anchors are rows whose id ``anchor_every`` divides. A component x counts as floor(scale * x), a score is the inner product, and higher scores come
    first, ties by the smaller id. An anchor's positives are its best ``positives`` rows of its label; negatives of a
    positive are the best ``negatives`` rows of other labels with a score from ``low_percent`` to ``high_percent`` of the positive's.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Rows are told apart by id:
    a row with the anchor's own id is not its partner; other rows that repeat an id each count, and so do repeated anchors,
    each with its own result. Vectors of unlike lengths are filled up with zeros. Ids and labels are whole numbers; scores must fit a long. An empty table gives an empty
    result; other columns are not read. Results do not depend on the sizes of blocks.
    """
    sound = valid_vectors(rows, scale, id_column, vector_column, label_column)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    is_anchor = F.col("vec_id") % anchor_every == 0
    facts = sound.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("dims"), F.max(norm).alias("norm")).first()
    grid = (max(1, min(LEAST_BLOCKS, facts["n"] // 256), -(-facts["n"] // rows_in_block)), max(1, -(-facts["anchors"] // anchors_in_block)))
    even = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(max(1, facts["dims"] or 0)) - F.size("v")))
    placed = materialize(sound.select("vec_id", "label", even.alias("v"), F.floor(F.rand(7) * grid[0]).cast("int").alias("row_block")), "negatives-rows")
    anchors = placed.filter(is_anchor).select(
        F.monotonically_increasing_id().alias("a"), F.col("vec_id").alias("anchor_id"), "label", "v", norm.alias("norm"), F.floor(F.rand(11) * grid[1]).cast("int").alias("anchor_block")
    )
    anchors = materialize(anchors, "negatives-anchors")
    everything = anchors.select("a", F.lit(0).alias("w"), F.lit(float("-inf")).alias("low"), F.lit(0.0).alias("base"), (F.col("norm") * F.lit(facts["norm"] or 0.0)).alias("high"), F.lit(float("inf")).alias("most"))
    near = fill(placed, anchors, everything, True, positives, grid, POSITIVE_STEPS)
    near = materialize(near.select("a", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    low, high = F.expr(f"(positive_score * {low_percent} + 99) DIV 100"), F.expr(f"positive_score * {high_percent} DIV 100")  # not of scores below 0
    windows = near.filter("positive_score >= 0").select("a", "w", low.cast("double").alias("low"), low.cast("double").alias("base"), high.cast("double").alias("high"), high.cast("double").alias("most"))
    found = fill(placed, anchors, windows, False, negatives, grid, NEGATIVE_STEPS)
    named = found.select("a", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["a", "w"]).join(anchors.select("a", "anchor_id"), "a")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
