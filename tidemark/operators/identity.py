"""Concepts by slug and alias: who is who, what was merged, what is only a candidate."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.operators.signals import LAYERS, event_time, layer_weight
from tidemark.storage import materialize

MOST_ALIASES, LEAST_CONFIDENCE = 16, 0.8
MOST_TERM_BYTES = 16 << 20  # terms that may go to all tasks
GRAM = 5


def replaced_if_valid(old: DataFrame, new: DataFrame, valid: Column, least: int) -> tuple[DataFrame, bool]:
    """(the new rows that are valid, true) if they are enough, else (the old rows, false)."""
    good = new.filter(valid)
    enough = good.count() >= least
    return (good if enough else old), enough


def alias_registry(aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, owner) of every alias key, owned by its first claimant; and the claims (key, owner, claimant) that conflict.

    ``aliases``: alias, slug, place. Empty keys are left out.
    """
    keyed = aliases.select(tx.alias_key(F.col("alias")).alias("key"), "slug", "place").filter(F.col("key") != "")
    owners = keyed.groupBy("key").agg(F.min_by("slug", F.struct("place", "slug")).alias("owner"))
    conflicts = keyed.select("key", F.col("slug").alias("claimant")).distinct().join(owners, "key").filter(F.col("claimant") != F.col("owner"))
    return owners, conflicts.select("key", "owner", "claimant")


def looked_up(asked: DataFrame, concepts: DataFrame, owners: DataFrame) -> DataFrame:
    """(name, found, redirected): the concept of each asked ``name`` by slug or else by alias key, and where it was merged into."""
    named = asked.withColumn("key", tx.alias_key(F.col("name"))).join(owners, "key", "left")
    by_slug = concepts.select(F.col("slug").alias("name"), F.lit(True).alias("is_slug"))
    found = named.join(by_slug, "name", "left").select("name", F.when(F.col("is_slug"), F.col("name")).otherwise(F.col("owner")).alias("found"))
    return found.join(concepts.select(F.col("slug").alias("found"), "merged_into"), "found", "left").select("name", "found", F.coalesce("merged_into", "found").alias("redirected"))


def redirect_map(concepts: DataFrame) -> DataFrame:
    """Merged concepts and their targets, latest merge first."""
    return concepts.filter(F.col("merged_into").isNotNull()).orderBy(F.desc("merged_at"), "slug").select("slug", "merged_into", "merged_at")


def resolved_identities(proposals: DataFrame, concepts: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, problem, slug, name, aliases, stage): what each proposal writes, or why it must not.

    ``proposals``: id, action, slug, name, aliases, canonical_slug, confidence, stage. Reusing takes the known concept's
    slug and name and unites the aliases, 16 at most; too little confidence, or a review, makes a candidate; a new concept
    must not meet a known slug or alias. ``concepts``: slug, name, aliases, merged_into.
    """
    known = concepts.filter(F.col("merged_into").isNull()).select(F.col("slug").alias("canonical_slug"), F.col("name").alias("known_name"), F.col("aliases").alias("known_aliases"))
    taken = concepts.select(F.col("slug"), F.lit(True).alias("slug_taken"))
    names = proposals.select("id", F.explode(F.array_union(F.array("slug", "name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    # Spark takes exploded rows for as small as the rows they come from, and would send all of them to the driver to broadcast; a stored table has its real size
    keys = materialize(names.select("id", tx.alias_key(F.col("alias")).alias("key")), "proposed-keys")
    clashes = keys.join(owners, "key").groupBy("id").agg(F.min("owner").alias("alias_owner"))
    rows = proposals.join(known, "canonical_slug", "left").join(taken, "slug", "left").join(clashes, "id", "left")
    reuse, create = F.col("action") == "reuse-existing", F.col("action") == "create-new"
    is_known = F.col("known_name").isNotNull()
    problem = (
        F.when(~F.coalesce(F.col("action").isin("reuse-existing", "create-new", "needs-review"), F.lit(False)), "action")
        .when((reuse | create) & (F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE), "confidence")
        .when(reuse & ~is_known, "unknown-concept").when((F.col("action") == "needs-review") & (F.col("canonical_slug") != F.col("slug")) & ~is_known, "unknown-concept")
        .when(create & (F.col("canonical_slug") != F.col("slug")), "slug-differs").when(create & F.coalesce("slug_taken", F.lit(False)), "slug-taken").when(create & F.col("alias_owner").isNotNull(), "alias-taken")
    )
    none = F.array().cast("array<string>")
    united = F.array_compact(F.array_distinct(F.concat(F.array("canonical_slug", "known_name"), F.coalesce("known_aliases", none), F.array("slug", "name"), F.coalesce("aliases", none))))
    taken_over = reuse & problem.isNull()
    return rows.select(
        "id", problem.alias("problem"), F.when(taken_over, F.col("canonical_slug")).otherwise(F.col("slug")).alias("slug"), F.when(taken_over, F.col("known_name")).otherwise(F.col("name")).alias("name"),
        F.when(taken_over, F.slice(united, 1, MOST_ALIASES)).otherwise(F.col("aliases")).alias("aliases"), F.when((F.col("action") == "needs-review") | problem.isin("confidence", "unknown-concept"), "candidate").otherwise(F.col("stage")).alias("stage"),
    )


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}  # of this worker: the last one


def _automaton(name: str, terms: Broadcast) -> ahocorasick.Automaton:
    if name not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for term in terms.value:
            made.add_word(term, term)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = made
    return _AUTOMATA[name]


def _found_by_automaton(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(columns of texts but ``text``, term): one pass over each text, whatever the number of terms."""
    kept = [c for c in texts.columns if c != "text"]
    shared, name = texts.sparkSession.sparkContext.broadcast(terms), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(name, shared)
        for batch in batches:
            found = [sorted({term for _, term in machine.iter(text)}) if text else [] for text in batch.column(0).to_pylist()]
            rows = pa.array([i for i, each in enumerate(found) for _ in each], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array([t for each in found for t in each], pa.string())], [*kept, "term"])

    return texts.select("text", *kept).mapInArrow(run, texts.select(*kept, F.lit("").alias("term")).schema)


def _found_by_pieces(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The same without terms in a task: pieces of texts meet the beginnings of terms by number of text, and each text is brought back once."""
    kept = [c for c in texts.columns if c != "text"]
    rows = materialize(texts.select(F.monotonically_increasing_id().alias("number_of_text"), F.struct(*kept, F.lit(0).alias("_")).alias("of"), "text"), "numbered-texts")
    begun = terms.select("term", F.left("term", F.lit(GRAM)).alias("piece"))
    sizes = [r[0] for r in begun.select(F.length("piece")).distinct().collect()]  # at most GRAM numbers
    pieces_of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.substr(F.col("text"), i, F.lit(n)))
    cut = [pieces_of(n) for n in sizes]
    pieces = rows.select("number_of_text", F.explode(F.array_distinct(F.concat(*cut))).alias("piece")) if cut else rows.select("number_of_text", F.lit("").alias("piece")).limit(0)
    possible = pieces.join(begun, "piece").groupBy("number_of_text").agg(F.collect_set("term").alias("terms"))
    held = rows.join(possible, "number_of_text").select("of", F.explode(F.filter("terms", lambda t: F.contains(F.col("text"), t))).alias("term"))
    return held.select(*[F.col("of")[c].alias(c) for c in kept], "term")


def mentions(texts: DataFrame, terms: DataFrame, most_bytes: int = MOST_TERM_BYTES) -> DataFrame:
    """(columns of texts but ``text``, columns of terms): each term (lower-cased, ``term``) that a lower-cased text contains.

    Terms of up to ``most_bytes`` together go to all tasks as one automaton that reads each text once. More of them stay where they are and
    meet the texts by their first letters. Null and empty terms are nowhere, null texts hold none, and rows of ``terms`` that repeat a term each count.
    """
    low = texts.withColumn("text", F.lower("text"))
    names = materialize(terms.filter(F.length("term") > 0).select("term").distinct(), "terms")
    if (names.agg(F.sum(F.octet_length("term"))).first()[0] or 0) <= most_bytes:
        found = _found_by_automaton(low, [r.term for r in names.collect()])
    else:
        found = _found_by_pieces(low, names)
    return found.join(terms, "term").select(*[c for c in texts.columns if c != "text"], *terms.columns)


def mentioned_owners(texts: DataFrame, terms: DataFrame, most_bytes: int = MOST_TERM_BYTES) -> DataFrame:
    """(columns of texts but ``text``, columns of terms but ``term``): for each text, whose terms (see ``mentions``) it contains, each owner once however many of its terms do.

    Terms and their owners' numbers of up to ``most_bytes`` go to all tasks, and a text is read only until all owners are found. Beyond that
    size rows come from ``mentions``, and those that are equal are one.
    """
    of, kept = [c for c in terms.columns if c != "term"], [c for c in texts.columns if c != "text"]
    sound = terms.filter(F.length("term") > 0).distinct()
    pairs = materialize(sound.select("term", F.struct(*of).alias("of")), "terms-of-owners")
    owners = materialize(pairs.select("of").distinct().select(F.monotonically_increasing_id().alias("owner"), "of"), "owners-of-terms")
    if (pairs.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0) > most_bytes:
        return mentions(texts, sound, most_bytes).select(*kept, *of).distinct()
    held = pairs.join(owners, pairs["of"].eqNullSafe(owners["of"])).groupBy("term").agg(F.collect_list("owner").alias("owners")).collect()
    shared, name = texts.sparkSession.sparkContext.broadcast({r.term: tuple(r.owners) for r in held}), uuid4().hex
    low = texts.select(F.lower("text").alias("text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, owners_of = _automaton(name, shared), shared.value
        total = len({o for each in owners_of.values() for o in each})
        for batch in batches:
            found: list[set[int]] = []
            for text in batch.column(0).to_pylist():
                seen, own = set(), set()
                for _, term in machine.iter(text) if text and total else ():
                    if term not in seen:
                        seen.add(term)
                        own.update(owners_of[term])
                        if len(own) == total:
                            break
                found.append(own)
            rows = pa.array([i for i, each in enumerate(found) for _ in each], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array([o for each in found for o in each], pa.int64())], [*kept, "owner"])

    met = low.mapInArrow(run, low.select(*kept, F.lit(0).cast("long").alias("owner")).schema)
    return met.join(owners, "owner").select(*kept, "of.*")


def shortlist(texts: DataFrame, hints: DataFrame, concepts: DataFrame, most: int = 24) -> DataFrame:
    """(id, slug, score, rank): the concepts to compare each text with.

    100 for a hint of the text whose key is an alias's, else 20 and the alias's length (20 at most) where an alias of five
    letters or more stands in the text; the best of each concept counts, ties go to the smaller ``place``. ``texts``: id,
    text; ``hints``: id, hint; ``concepts``: slug, alias, place.
    """
    keyed = concepts.select("slug", "place", tx.alias_key(F.col("alias")).alias("key"))
    hinted = hints.select("id", tx.alias_key(F.col("hint")).alias("key")).join(keyed, "key").select("id", "slug", "place", F.lit(100).alias("score"))
    long_enough = concepts.filter(F.length("alias") >= GRAM).select("slug", "place", F.lower("alias").alias("term"))
    written = mentions(texts, long_enough).select("id", "slug", "place", (20 + F.least(F.lit(20), F.length("term"))).alias("score"))
    best = hinted.unionByName(written).groupBy("id", "slug").agg(F.max("score").alias("score"), F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "place", "slug"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "slug", "score", "rank")


def item_candidates(items: DataFrame, most_sources: int = 8) -> DataFrame:
    """Candidate concepts that items name: one for each name, whatever its case.

    Returns key, name (the first by place), signals (distinct published ones), evidence (distinct urls), groups, layer
    (the highest), practised, last_seen and urls: the first sources by layer, time and url. Reads candidate_concept,
    place and what an article has.
    """
    name = F.trim(F.col("candidate_concept"))
    rows = items.filter((F.coalesce(name, F.lit("")) != "") & (F.col("publish_decision") != "reject")).select(
        F.lower(name).alias("key"), name.alias("name"), "place", "url", F.when(F.col("publish_decision") == "publish", F.col("signal_slug")).alias("signal"), F.coalesce("independent_group", "source_id").alias("grp"), layer_weight(F.col("source_layer")).alias("w"), event_time().alias("t"),
    )
    sums = rows.groupBy("key").agg(F.min_by("name", "place").alias("name"), F.count_distinct("signal").alias("signals"), F.count_distinct("url").alias("evidence"), F.count_distinct("grp").alias("groups"), F.max("w").alias("w"), F.bool_or(F.col("w") == 2).alias("practised"), F.max("t").alias("last_seen"))
    sources = rows.groupBy("key", "url").agg(F.max("w").alias("w"), F.max("t").alias("t"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("w"), F.desc("t"), "url"))).filter(F.col("rank") <= most_sources)
    urls = ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("urls"))
    layer = F.element_at(F.array(*[F.lit(x) for x, _ in sorted(LAYERS.items(), key=lambda x: x[1])]), F.col("w"))
    return sums.join(urls, "key").select("key", "name", "signals", "evidence", "groups", layer.alias("layer"), "practised", "last_seen", "urls")


def promotion_criteria(candidates: DataFrame) -> DataFrame:
    """Adds ``criteria``: array of (key, status) for definition, sources, practice and identity, each ready, missing or review.

    Reads defined (has definition, boundary and mechanism), groups, practised, identity_action and identity_confidence.
    """
    ready = lambda c, other="missing": F.when(F.coalesce(c, F.lit(False)), "ready").otherwise(other)
    distinct = (F.col("identity_action") == "create-new") & (F.col("identity_confidence") >= LEAST_CONFIDENCE)
    rules = {"stable-definition": ready(F.col("defined")), "independent-sources": ready(F.col("groups") >= 2), "practice-evidence": ready(F.col("practised")), "distinct-identity": ready(distinct, "review")}
    return candidates.withColumn("criteria", F.array(*[F.struct(F.lit(k).alias("key"), v.alias("status")) for k, v in rules.items()]))


def stored_candidates(concepts: DataFrame, evidence: DataFrame, most_sources: int = 24) -> DataFrame:
    """(slug, name, evidence, layer, revision, urls) of stored concepts that are candidates: their first sources by place, and latest revision.

    ``concepts``: slug, name, stage, revision; ``evidence``: slug, place, url, source_layer.
    """
    rank = F.row_number().over(Window.partitionBy("slug").orderBy("place", "url"))
    first = evidence.withColumn("rank", rank).filter(F.col("rank") <= most_sources)
    sums = first.groupBy("slug").agg(F.count("*").alias("evidence"), F.max(layer_weight(F.col("source_layer"))).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("urls"))
    layer = F.when(F.col("w") == 3, "official").when(F.col("w") == 2, "practitioner").otherwise("community")
    rows = concepts.filter(F.col("stage") == "candidate").join(sums, "slug", "left")
    return rows.select("slug", "name", F.coalesce("evidence", F.lit(0)).alias("evidence"), layer.alias("layer"), "revision", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def identity_keys(candidates: DataFrame) -> DataFrame:
    """(slug, key) of each candidate's slug, name and aliases, empty keys left out."""
    names = candidates.select("slug", F.explode(F.array_distinct(F.concat(F.array("slug", "name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
    return names.select("slug", tx.alias_key(F.col("alias")).alias("key")).filter(F.coalesce("key", F.lit("")) != "").distinct()


def candidate_homes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(slug, home) of each incoming candidate: the slug of the first candidate that has one of its keys when its turn comes, else its own.

    Stored candidates come first, then incoming ones, both by place. Whoever joins a home hands on the keys of its name and aliases; its slug's key counts only while it stands
    alone. All look at once for the least home that held one of their keys before them, and follow that home's own home; this is repeated
    until nothing moves. As a home depends on earlier candidates only, what no longer moves is what taking them one by one gives.
    """
    at = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("place").cast("long").alias("place"), "slug")
    alias_key = tx.alias_key(F.col("alias"))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = stored.select(at(0).alias("at"), "slug", names.alias("names")).unionByName(incoming.select(at(1).alias("at"), "slug", names.alias("names")))
    kept = each.select("at", F.explode("names").alias("alias"), F.lit(True).alias("handed_on")).unionByName(each.select("at", F.col("slug").alias("alias"), F.lit(False).alias("handed_on")))
    keys = kept.select("at", alias_key.alias("key"), "handed_on").filter(F.coalesce("key", F.lit("")) != "").groupBy("at", "key").agg(F.max("handed_on").alias("handed_on"))
    keys = materialize(keys, "candidate-keys")
    homes = materialize(each.select("at", F.col("at").alias("home")), "candidate-homes")
    earlier = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        held = keys.join(homes, "at").withColumn("offered", F.when(F.col("handed_on") | (F.col("home") == F.col("at")), F.col("home")))
        least = held.withColumn("before", F.min("offered").over(earlier)).groupBy("at").agg(F.min("before").alias("before"))
        found = homes.join(least, "at", "left").select("at", F.col("home").alias("was"), F.when(F.col("at.kind") == 0, F.col("at")).otherwise(F.coalesce("before", "at")).alias("home"))
        further = homes.select(F.col("at").alias("home"), F.col("home").alias("further"))
        moved = materialize(found.join(further, "home").select("at", "was", F.when(F.col("home") == F.col("at"), F.col("at")).otherwise(F.least("home", "further")).alias("home")), "candidate-homes")
        homes = moved.select("at", "home")
        if moved.filter("was <> home").isEmpty():
            return homes.filter("at.kind = 1").select(F.col("at.slug").alias("slug"), F.col("home.slug").alias("home"))


def merged_candidates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(slug, name, aliases, signals, last_seen, members): stored candidates, and incoming ones each at its home (see ``candidate_homes``).

    Aliases unite, signals add up, the latest time stays. Both sides: slug, name, aliases, place, signals, last_seen; slugs are distinct.
    """
    placed = incoming.join(candidate_homes(stored, incoming), "slug")
    own = stored.withColumn("home", F.col("slug")).withColumn("kind", F.lit(0))
    both = own.unionByName(placed.withColumn("kind", F.lit(1)).select(*own.columns))
    return both.groupBy("home").agg(
        F.min_by("name", F.struct("kind", "place")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))).alias("aliases"),
        F.sum("signals").alias("signals"), F.max("last_seen").alias("last_seen"), F.count("*").alias("members"),
    ).withColumnRenamed("home", "slug")


def without_promoted(candidates: DataFrame, formal: DataFrame, redirects: DataFrame) -> DataFrame:
    """Candidates that share no key with a formal concept (slug, name, aliases) or a merged slug."""
    taken = identity_keys(formal).select("key").unionByName(redirects.select(tx.alias_key(F.col("slug")).alias("key"))).distinct()
    gone = identity_keys(candidates).join(taken, "key", "left_semi").select("slug").distinct()
    return candidates.join(gone, "slug", "left_anti")
