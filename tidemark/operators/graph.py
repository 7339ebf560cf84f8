"""Redirects and depth levels of concept graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import ranked
from tidemark.storage import materialize


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """(src, dst) with one dst for each src -> (src, dst) with the end of each chain.

    Reach doubles in every round, and only moved rows count as progress. What lies on or leads into a cycle has no end and is left out.
    """
    found = materialize(redirects.filter(F.col("src") != F.col("dst")), "redirects")
    for _ in range(found.count().bit_length()):
        ahead = found.select(F.col("src").alias("via"), F.col("dst").alias("further"))
        stepped = materialize(found.join(ahead, found["dst"] == ahead["via"], "left").select("src", F.coalesce("further", "dst").alias("dst"), F.col("further").isNotNull().alias("moved")), "redirects")
        found = stepped.select("src", "dst")
        if stepped.filter("moved").isEmpty():
            break
    return found.join(found.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")


def redirected_edges(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """(src, dst, confidence) with the ends of redirects as dst: no self loops, the best confidence and the count of each edge."""
    ends = resolve_redirects(redirects).select(F.col("src").alias("old"), F.col("dst").alias("new"))
    compact = edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.count("*").alias("evidence"))
    moved = compact.join(ends, F.col("dst") == F.col("old"), "left").select("src", F.coalesce("new", "dst").alias("dst"), "confidence", "evidence")
    return moved.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.sum("evidence").alias("evidence"))


def canonical_relations(relations: DataFrame, merges: DataFrame, formal: DataFrame) -> DataFrame:
    """(slug, type, target, confidence, urls) with merged targets followed to their end: each once, the best confidence, all urls.

    ``merges``: src, dst, one dst for each src; ``formal``: slug. A target that is not formal in the end goes, one on a circle of
    merges included, and so does a relation to itself. A concept that was merged away takes its own relations along.
    """
    ends = materialize(resolve_redirects(merges), "merge-ends")
    circles = merges.select(F.col("src").alias("slug")).join(ends.select(F.col("src").alias("slug")), "slug", "left_anti")
    to = lambda c: ends.select(F.col("src").alias(c), F.col("dst").alias(f"{c}_end"))
    moved = relations.join(to("slug"), "slug", "left").join(to("target"), "target", "left").withColumns({c: F.coalesce(f"{c}_end", c) for c in ("slug", "target")})
    alive = formal.select("slug").join(circles, "slug", "left_anti").select(F.col("slug").alias("target")).distinct()
    kept = moved.filter(F.col("slug") != F.col("target")).join(alive, "target", "left_semi")
    sums = kept.groupBy("slug", "type", "target").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("urls", F.array().cast("array<string>")))))).alias("urls"))
    return sums.select("slug", "type", "target", "confidence", "urls")


CONTRACT_EVERY = 8  # levels peeled between two contractions


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, w) without the nodes that have one edge in and one out, whose lengths go to what is left; and where those nodes hang: (node, head, distance).

    Nodes in a row find the node that the row begins at by doubling: after k rounds each has looked 2^k nodes back. Those that have none are
    circles of their own, with a null head.
    """
    single_in = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("head"), F.min("w").alias("distance")).filter("n = 1")
    single_out = edges.groupBy("src").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("src").alias("node"))
    rows = materialize(single_in.select(F.col("dst").alias("node"), "head", "distance").join(single_out, "node"), "rows-of-nodes")
    inner = rows.select("node")
    hanging, moving = rows.join(inner.select(F.col("node").alias("head")), "head", "left_anti").select(*rows.columns), rows.join(inner.select(F.col("node").alias("head")), "head", "left_semi").select(*rows.columns)
    hanging, moving = materialize(hanging, "hanging"), materialize(moving, "moving")
    for _ in range(rows.count().bit_length() + 1):
        if moving.isEmpty():
            break
        ahead = hanging.withColumn("ended", F.lit(True)).unionByName(moving.withColumn("ended", F.lit(False))).select(F.col("node").alias("head"), F.col("head").alias("further"), F.col("distance").alias("more"), "ended")
        stepped = materialize(moving.join(ahead, "head").select("node", F.col("further").alias("head"), (F.col("distance") + F.col("more")).alias("distance"), "ended"), "moving")
        hanging, moving = hanging.unionByName(stepped.filter("ended").drop("ended")), stepped.filter("NOT ended").drop("ended")
    hanging = materialize(hanging.unionByName(moving.withColumns({"head": F.lit(None).cast(moving.schema["head"].dataType)})), "hanging")
    kept = edges.join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    begun = kept.join(hanging.select(F.col("node").alias("src"), "head", "distance"), "src", "left")
    short = begun.filter("distance IS NULL OR head IS NOT NULL").select(F.coalesce("head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("distance", F.lit(0))).alias("w"))
    return materialize(short.groupBy("src", "dst").agg(F.max("w").alias("w")), "open-edges"), hanging


def depths(edges: DataFrame) -> DataFrame:
    """(node, depth) for (src, dst): the longest path from a root; null for nodes on cycles and behind them.

    Rows of nodes with one edge in and one out are contracted first and now and then; in between, nodes without an open edge in are
    taken off level by level. A long path takes rounds by its length's logarithm, and what is contracted gets its depth from its head at the end.
    """
    edges = materialize(edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct().withColumn("w", F.lit(1)), "open-edges")
    nodes = materialize(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct(), "nodes")
    removed: list[DataFrame] = []
    pending, waiting, done = nodes.withColumn("depth", F.lit(0)), nodes, None
    turn = 0
    while not edges.isEmpty():
        if turn % CONTRACT_EVERY == 0:
            edges, hanging = contracted(edges)
            if not hanging.isEmpty():
                removed.append(hanging)
                waiting = materialize(waiting.join(hanging, "node", "left_anti"), "waiting")
        held = edges.select(F.col("dst").alias("node")).distinct()
        ready = materialize(pending.join(waiting, "node", "left_semi").join(held, "node", "left_anti").groupBy("node").agg(F.max("depth").alias("depth")), "ready")
        if ready.isEmpty():
            break  # only cycles and what hangs on them are left
        reached = edges.join(ready.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("depth") + F.col("w")).alias("depth"))
        done = ready if done is None else done.unionByName(ready)
        waiting = materialize(waiting.join(ready, "node", "left_anti"), "waiting")
        pending = materialize(pending.join(waiting, "node", "left_semi").unionByName(reached).groupBy("node").agg(F.max("depth").alias("depth")), "pending")
        edges = materialize(edges.join(ready.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "w"), "open-edges")
        turn += 1
    if edges.isEmpty():
        rest = pending.join(waiting, "node", "left_semi").groupBy("node").agg(F.max("depth").alias("depth"))
        done = rest if done is None else done.unionByName(rest)
    done = materialize(nodes.limit(0).withColumn("depth", F.lit(0)) if done is None else done, "depths")
    for hanging in reversed(removed):
        own = hanging.join(done.select(F.col("node").alias("head"), F.col("depth").alias("from")), "head").select("node", (F.col("from") + F.col("distance")).alias("depth"))
        done = materialize(done.unionByName(own), "depths")
    return nodes.join(done, "node", "left").select("node", "depth")


def levels(edges: DataFrame) -> DataFrame:
    """(node, depth, rank, column_size): the longest path from a root; members of cycles, and what lies behind them, lie one below all others.

    Nodes are of any type. With a column ``position`` (numbers) nodes are ranked in their level by where they first appear, as src before dst, those of one place by themselves; else by themselves. Self
    loops and edges without an end are left out.
    """
    sound = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    found = materialize(depths(sound), "levels")
    last = found.agg(F.max("depth")).first()[0]
    placed = found.select("node", F.coalesce("depth", F.lit(0 if last is None else last + 1)).alias("depth"))
    by = "node"
    if "position" in edges.columns:
        seen = sound.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (F.col("position") * 2).alias("first")), F.struct(F.col("dst").alias("node"), (F.col("position") * 2 + 1).alias("first")))).alias("s")).select("s.*")
        placed, by = placed.join(seen.groupBy("node").agg(F.min("first").alias("first")), "node").withColumn("first", F.struct("first", "node")), "first"
    sizes = placed.groupBy("depth").agg(F.count("*").alias("column_size"))
    return ranked(placed, "depth", by, "rank").join(sizes, "depth").select("node", "depth", "rank", "column_size")
