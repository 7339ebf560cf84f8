"""Which signal an item belongs to: similar titles, and the assignment of items in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.storage import materialize

LEAST_TITLE = 0.375  # title and tags weigh 0.8 and 0.2, so a score of 0.5 needs a title at least this similar
LEAST_SCORE, TITLE_WEIGHT, TAG_WEIGHT = 0.5, 0.8, 0.2
DAYS = 21


def candidate_window(items: DataFrame, as_of: Column, days: int = DAYS, most: int | None = None) -> DataFrame:
    """Published items of the last days, newest first; on request only so many of them."""
    time = F.coalesce("published_at", "discovered_at")
    recent = items.filter((F.col("publish_decision") == "publish") & (F.unix_seconds(as_of) - F.unix_seconds(time) <= days * 86400))
    return recent if most is None else recent.orderBy(time.desc(), "url").limit(most)


BLOCK, TASK_PAIRS = 1000, 2_000_000  # members that travel together; pairs that a task writes


def prefixes(classes: DataFrame, least: float) -> DataFrame:
    """(columns of classes but key and tokens, ids, n, before, id) of (cls, key, tokens, ...): the tokens as numbers, rarest of their key first, and a row for each of the prefix.

    Of n tokens, rarest first, two similar sets share one of the first n - ceil(least n) + 1. Exploded rows look small to Spark, so joins of
    them are never left to a broadcast.
    """
    each = classes.select("cls", "key", F.explode("tokens").alias("token")).hint("merge")
    numbers = materialize(each.groupBy("key", "token").agg(F.count("*").alias("c")).select(F.monotonically_increasing_id().alias("id"), "*"), "token-numbers")
    order = each.join(numbers, ["key", "token"]).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("c", "id"))).alias("order"))
    ids = order.select("cls", F.transform("order", lambda t: t["id"]).alias("ids")).withColumn("n", F.size("ids"))
    sets = materialize(classes.drop("key", "tokens").join(ids, "cls"), "numbered-sets")
    prefix = F.slice("ids", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    return sets.select("*", F.posexplode(prefix).alias("before", "id")).hint("merge")


def meeting(least: float) -> tuple[Column, Column]:
    """Of rows ``x`` and ``y`` of ``prefixes`` with one id: whether they may be similar and meet here first; and their share of tokens.

    Sizes, and what may still be shared behind the token, tell apart most pairs before tokens are compared.
    """
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    room = F.least(x("n") - x("before"), y("n") - y("before"))  # at most so many are shared
    sized = (F.least(x("n"), y("n")) >= least * F.greatest(x("n"), y("n"))) & (F.round(room / (x("n") + y("n") - room), 6) >= least)
    common = F.array_intersect(x("ids"), y("ids"))
    return sized & (F.get(common, F.lit(0)) == x("id")), F.size(common) / (x("n") + y("n") - F.size(common))


def similar_classes_of(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity, members_a, members_b) of classes (cls, key, tokens, members) of one key whose tokens are similar enough, ``a`` being the one with fewer members.

    An exact prefix filter: a pair is made at the first token that both have.
    """
    listed, (meet, share) = prefixes(classes, least), meeting(least)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))  # both sides are one exchange
    similarity = F.round(share, 6)
    met = listed.alias("x").join(listed.alias("y"), x("id") == y("id")).filter((x("cls") < y("cls")) & meet & (similarity >= least))
    fewer = x("members") <= y("members")
    either = lambda c, one, other: F.when(fewer, one(c)).otherwise(other(c))
    return met.select(either("cls", x, y).alias("a"), either("cls", y, x).alias("b"), similarity.alias("similarity"), either("members", x, y).alias("members_a"), either("members", y, x).alias("members_b"))


def similar_pairs(items: DataFrame, key: str, least: float = LEAST_TITLE) -> DataFrame:
    """(doc_id, other_id, similarity) of pairs of one key whose ``tokens`` are similar enough, doc_id being the smaller.

    Rows of equal tokens are one class, and only classes are compared. The pairs of rows themselves, as many as there are, are made last, block by
    block of members in the tasks that write them; what is shuffled are blocks. Rows with a null id or key pair with nothing.
    """
    sound = F.col("doc_id").isNotNull() & F.col(key).isNotNull() & (F.size("tokens") > 0)
    rows = materialize(items.filter(sound).select("doc_id", F.col(key).alias("key"), F.array_sort(F.array_distinct("tokens")).alias("tokens")), "token-sets")
    classes = materialize(rows.groupBy("key", "tokens").agg(F.count("*").alias("members")).select(F.monotonically_increasing_id().alias("cls"), "*"), "token-classes")
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / BLOCK))
    blocks = materialize(rows.join(classes, ["key", "tokens"]).groupBy("cls", block.alias("block")).agg(F.collect_list("doc_id").alias("ids")), "blocks-of-members")
    own = classes.filter((F.col("members") > 1) & F.lit(least <= 1)).select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity"), F.col("members").alias("members_a"), F.col("members").alias("members_b"))
    pairs = materialize(similar_classes_of(classes, least).unionByName(own), "similar-classes")
    most = pairs.agg(F.sum(F.col("members_a") * F.col("members_b"))).first()[0] or 0
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // TASK_PAIRS + 1)
    of = lambda side: blocks.select(F.col("cls").alias(side), F.col("block").alias(f"block_{side}"), F.col("ids").alias(f"ids_{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").filter("a <> b OR block_a <= block_b").repartition(tasks, "a", "b", "block_a", "block_b")
    one = met.select("*", F.explode("ids_a").alias("x")).select("a", "b", "block_a", "block_b", "similarity", "x", F.explode("ids_b").alias("y"))
    once = one.filter("x <> y AND (a <> b OR block_a <> block_b OR x < y)")
    return once.select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other_id"), "similarity")


ITEM_COLUMNS = ["concept_slug", "title", "tags", "independent_group", "event_key"]


def fresh_slug(concept: Column, title: Column) -> Column:
    concept = F.coalesce(concept, F.lit(""))
    return F.concat(concept, F.lit("-"), F.substring(F.sha2(F.concat(concept, F.lit("\n"), F.lower(title)), 256), 1, 10))


def comparable(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items and stored signals as rows of one kind: ``at`` orders them and says what they are, ``cls`` is shared by rows of equal title tokens, tags and version."""
    at = lambda kind, number, slug: F.struct(F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), number.cast("long").alias("id"), slug.cast("string").alias("slug"))
    before = stored.select(*ITEM_COLUMNS, at(0, F.lit(None), F.col("signal_slug")).alias("at"), F.lit(True).alias("joins"))
    after = items.select(*ITEM_COLUMNS, at(1, F.col("id"), F.lit(None)).alias("at"), F.coalesce("joins", F.lit(False)).alias("joins"))
    title = F.coalesce("title", F.lit(""))
    rows = before.unionByName(after).withColumns({
        "title": title, "concept": F.coalesce("concept_slug", F.lit("\0")), "event_key": F.nullif("event_key", F.lit("")), "version": tx.version_key(title), "tokens": F.array_sort(tx.tokens(title)),
        "tags": F.array_sort(F.array_distinct(F.array_compact(F.coalesce("tags", F.array().cast("array<string>"))))),
    })
    return rows.withColumn("cls", F.sha2(F.to_json(F.struct("concept", "tokens", "tags", "version"), {"ignoreNullFields": "false"}), 256))


def equal_before(rows: DataFrame) -> DataFrame:
    """(at, equal) of each item: the first candidate before it with its event key, or with its version and group, unless versions differ.

    The first of all candidates with a key is the first before an item, or there is none; so one row a key is joined to the items.
    """
    known = rows.filter("joins")
    events = known.filter("event_key IS NOT NULL").groupBy("concept", "event_key").agg(F.min("at").alias("any_first"), F.min(F.when(F.col("version").isNull(), F.col("at"))).alias("plain_first"))
    versioned = known.filter("event_key IS NOT NULL AND version IS NOT NULL").groupBy("concept", "event_key", "version").agg(F.min("at").alias("event_first"))
    groups = known.filter("version IS NOT NULL").groupBy("concept", "version", F.coalesce(F.concat(F.lit("="), "independent_group"), F.lit("")).alias("grp")).agg(F.min("at").alias("group_first"))
    own = rows.filter("at.kind = 1").withColumn("grp", F.coalesce(F.concat(F.lit("="), "independent_group"), F.lit(""))).select("concept", "event_key", "version", "grp", "at")
    met = own.join(events, ["concept", "event_key"], "left").join(versioned, ["concept", "event_key", "version"], "left").join(groups, ["concept", "version", "grp"], "left")
    by_event = [F.when(F.col("version").isNull(), F.col("any_first")), F.when(F.col("version").isNotNull(), F.col("plain_first")), F.col("event_first")]
    earlier = [F.when(c < F.col("at"), c) for c in (*by_event, F.col("group_first"))]
    return met.select("at", F.least(*earlier).alias("equal"))


def title_classes(rows: DataFrame) -> DataFrame:
    """(cls, name, key, tokens, tags, version, first, asks): classes of equal titles by number, their first candidate, and whether items are among them."""
    classes = rows.filter(F.size("tokens") > 0).groupBy("cls").agg(*[F.first(c).alias(c) for c in ("concept", "tokens", "tags", "version")], F.min(F.when(F.col("joins"), F.col("at"))).alias("first"), F.max(F.col("at.kind") == 1).alias("asks"))
    named = classes.withColumnsRenamed({"cls": "name", "concept": "key"})
    return materialize(named.select(F.monotonically_increasing_id().alias("cls"), "*"), "title-classes")


def similar_classes(classes: DataFrame) -> DataFrame:
    """(cls, score, first): for each class of equal titles, the classes that its items may join, with their first candidate.

    An exact prefix filter as in ``similar_pairs``; a pair is made at the first token that both have.
    """
    listed, (meet, share) = prefixes(classes.drop("name"), LEAST_TITLE), meeting(LEAST_TITLE)
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    apart = F.coalesce(x("version") != y("version"), F.lit(False))
    score = TITLE_WEIGHT * share + TAG_WEIGHT * tx.jaccard(x("tags"), y("tags"))
    met = listed.filter("asks").alias("x").join(listed.filter("first IS NOT NULL").alias("y"), x("id") == y("id")).filter(meet & ~apart)
    return met.select(x("cls").alias("cls"), score.alias("score"), y("first").alias("first")).filter(F.col("score") >= LEAST_SCORE)


def best_before(rows: DataFrame) -> DataFrame:
    """(at, similar) of each item: of the candidates before it the one of the best score, the first of equals.

    Which is best for a class changes only where a better candidate comes in. These changes are the steps that an item's
    place is looked up in, so a class with many items and many neighbours makes no pairs of both.
    """
    past = Window.partitionBy("cls").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    classes = title_classes(rows)
    changes = similar_classes(classes).withColumn("best", F.max("score").over(past)).filter(F.col("best").isNull() | (F.col("score") > F.col("best")))
    until = changes.select("cls", "first", F.lead("first").over(Window.partitionBy("cls").orderBy("first")).alias("until"))
    steps = materialize(until.join(classes.select("cls", "name"), "cls").select(F.col("name").alias("cls"), "first", "until"), "title-steps")
    own = rows.filter("at.kind = 1").select("at", "cls")
    inside = (own["cls"] == steps["cls"]) & (steps["first"] < own["at"]) & (steps["until"].isNull() | (own["at"] <= steps["until"]))
    return own.join(steps, inside).select("at", F.col("first").alias("similar"))


def assigned(items: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, signal_slug): the signal of every item, as if decided one by one in the order of ``place`` among the items of its concept.

    ``stored`` holds earlier signals (concept_slug, place, title, tags, independent_group, event_key, signal_slug), looked at first
    in order of their place. An item whose ``joins`` is true is a candidate for those after it. The first candidate of equal event key, or of equal version and
    group, wins; else the most similar title and tags; else the item opens a signal. Null titles are empty; ties of place go by id; ids are
    distinct; a null concept is one of its own.

    Which candidate an item joins follows from titles, keys and places alone, never from the signal that the candidate got. So all
    items choose at once, over keys and classes of equal titles, and a concept of any size is spread over all tasks. What remains are chains
    from item to item; they are halved until each ends at an item that opens a signal or at a stored one.
    """
    rows = materialize(comparable(items, stored), "comparable-items")
    opens = rows.filter("at.kind = 1").select("at", "concept_slug", "title")
    chosen = opens.join(equal_before(rows), "at").join(best_before(rows), "at", "left").withColumn("joined", F.coalesce("equal", "similar"))
    slug = F.when(F.col("joined").isNull(), fresh_slug(F.col("concept_slug"), F.col("title"))).otherwise(F.col("joined.slug"))
    links = materialize(chosen.select(F.col("at.id").alias("id"), F.col("joined.id").alias("to"), slug.alias("signal_slug")), "signal-links")
    ended, waiting = links.filter("signal_slug IS NOT NULL"), links.filter("signal_slug IS NULL")
    while not waiting.isEmpty():
        ahead = ended.unionByName(waiting).select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("signal_slug").alias("found"))
        stepped = materialize(waiting.select("id", "to").join(ahead, "to").select("id", F.col("further").alias("to"), F.col("found").alias("signal_slug")), "signal-links")
        ended, waiting = ended.unionByName(stepped.filter("signal_slug IS NOT NULL")), stepped.filter("signal_slug IS NULL")
    return ended.select("id", "signal_slug")
