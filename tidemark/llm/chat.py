"""Chat formatting of reply trees.

Messages form trees. Iterative self-joins double the reach of every message's ancestor link, so a path of any
length is known after as many joins as its length has binary digits; root-to-leaf paths are ranked by the sum of
their scores, and the best path of each tree (or every path) is formatted as one conversation.

Template of a turn, a fixed format: ``<|from role|>text<|end|>``. Inside roles and texts, ``\\`` is written ``\\b``, ``<|`` is
written ``\\o`` and ``|>`` is written ``\\c``, so that a marker can only come from the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import numbered_in_groups
from tidemark.storage import materialize

OPEN, CLOSE, FROM, END = "<|", "|>", "<|from ", "<|end|>"
TURNS_TOGETHER = 256  # turns of one conversation that are numbered by one task


def escape(text: Column) -> Column:
    """Neither ``<|`` nor ``|>`` is left, and the template's own markers never meet a text to form one."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit(OPEN), F.lit("\\o")), F.lit(CLOSE), F.lit("\\c"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\c"), F.lit(CLOSE)), F.lit("\\o"), F.lit(OPEN)), F.lit("\\b"), F.lit("\\"))


def chain(messages: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: every row answers the row before it (by turn, role, text).

    Returns ``tree``, ``node`` (0, 1, ...), ``parent`` (null for the first), ``role``, ``text`` and ``score`` (1.0).
    """
    stretch = F.coalesce(F.floor(F.col(turn) / TURNS_TOGETHER), F.lit(-(1 << 55)))
    rows = messages.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), stretch.alias("stretch"))
    numbered = numbered_in_groups(rows, "tree", "stretch", [F.col("turn"), F.col("role"), F.col("text")], "node")
    return numbered.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def one_row_a_node(nodes: DataFrame) -> DataFrame:
    """(tree, node, link, hops, total) with ``link`` the parent, null where there is none or it does not exist.

    Of rows that repeat a node, the one with the smallest parent (null first), then score, tells its place.
    """
    placed = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("first"))
    start = materialize(placed.select("tree", "node", F.col("first.parent").alias("link"), F.lit(1).cast("long").alias("hops"), F.col("first.score").alias("total")), "reply-nodes")
    known = start.select(F.col("tree").alias("tree_2"), F.col("node").alias("node_2"))
    same = F.col("tree").eqNullSafe(F.col("tree_2")) & (F.col("link") == F.col("node_2"))
    return start.join(known, same, "left").select("tree", "node", F.col("node_2").alias("link"), "hops", "total")


def ancestor_links(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, link, hops, total): in table k, ``link`` is the ancestor 2^k above; and the same, without links, of all nodes.

    ``hops`` and ``total`` count and sum the scores of the messages from ``node`` to just below ``link``. A message whose
    link would pass the root is done and leaves the tables, so a message is joined as often as its own depth has
    binary digits, however deep other trees are. A message on a cycle would keep its links for ever; no path is longer
    than the number of messages, so what then has links is on a cycle, and on no path.
    """
    start = materialize(one_row_a_node(nodes), "reply-links")
    tables, done = [start.filter(F.col("link").isNotNull())], start.filter(F.col("link").isNull())
    messages = start.count()
    while 1 << (len(tables) - 1) < messages and not tables[-1].isEmpty():
        below = tables[-1]
        above = below.unionByName(done).select(F.col("tree").alias("tree_2"), F.col("node").alias("node_2"), F.col("link").alias("link_2"), F.col("hops").alias("hops_2"), F.col("total").alias("total_2"))
        joined = below.join(above, F.col("tree").eqNullSafe(F.col("tree_2")) & (F.col("link") == F.col("node_2")))
        stepped = materialize(joined.select("tree", "node", F.col("link_2").alias("link"), (F.col("hops") + F.col("hops_2")).alias("hops"), (F.col("total") + F.col("total_2")).alias("total")), "reply-links")
        tables.append(stepped.filter(F.col("link").isNotNull()))
        done = done.unionByName(stepped.filter(F.col("link").isNull()))
    return tables, done


def ranked_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, branch, node, depth): the messages of each tree's best root-to-leaf paths; ``branch`` counts from 1.

    Paths are ranked by the sum of their scores, ties by the smaller leaf. A parent that does not exist makes its
    message a root.
    """
    tables, whole = ancestor_links(nodes)
    answered = tables[0].select(F.col("tree").alias("tree_2"), F.col("link").alias("node_2")).distinct()
    leaves = whole.join(answered, F.col("tree").eqNullSafe(F.col("tree_2")) & (F.col("node") == F.col("node_2")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    found = leaves.select("tree", "node", rank.alias("branch")).filter(F.col("branch") <= branches)
    for table in reversed(tables):  # each step adds the ancestors 2^k above those found so far
        links = table.select(F.col("tree").alias("tree_2"), F.col("node").alias("node_2"), "link")
        up = found.join(links, F.col("tree").eqNullSafe(F.col("tree_2")) & (F.col("node") == F.col("node_2"))).select("tree", F.col("link").alias("node"), "branch")
        found = materialize(found.unionByName(up), "reply-paths")
    depths = whole.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("hops").alias("depth"))
    return found.join(depths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", "node", "depth")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """One conversation for each tree and chosen branch, from (tree, node, parent, role, text, score).

    Returns ``tree``, ``branch``, ``formatted`` and ``loss_spans``: array of (start, length) in code points of ``formatted``, one
    for each assistant text. Null roles and texts count as empty, null scores as 0; null trees are one tree; messages
    without a node are left out, and of messages that repeat a node all are formatted, in order of role and text, at
    the place of the one with the smallest parent. An empty table gives an empty result; other columns are not read.
    """
    nodes = materialize(nodes.filter(F.col("node").isNotNull()), "messages")
    paths = ranked_paths(nodes.select("tree", "node", "parent", "score"), branches)
    texts = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "branch", "depth", "role", "text")
    head, body = F.concat(F.lit(FROM), escape(F.col("role")), F.lit(CLOSE)), escape(F.col("text"))
    order = Window.partitionBy("tree", "branch").orderBy("depth", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = F.when(F.col("role") == "assistant", F.struct((before + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    pieces = turns.select("tree", "branch", "depth", "role", "text", head.alias("head"), body.alias("body")).select(
        "tree", "branch", F.row_number().over(order).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"), spans.alias("span")
    )
    whole = pieces.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "span"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    return whole.select("tree", "branch", formatted.alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    segments = F.filter(F.split(formatted, r"<\|end\|>"), lambda s: s != "")
    cut = F.transform(segments, lambda s: F.split(s, r"\|>", 2))
    return F.transform(cut, lambda c: F.struct(unescape(F.substring(c[0], len(FROM) + 1, 1 << 30)).alias("role"), unescape(c[1]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """What a formatted conversation says, read back from it."""
    read = conversations.select("tree", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
