"""Tables brought up to date: conditional upserts, retirements, compare-and-set, revisions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(stored: DataFrame, incoming: DataFrame, key: str, replaceable: Column) -> DataFrame:
    """``stored`` after ``incoming`` (same columns, one row for each key), with ``changed``: new keys come in, stored rows give way only if ``replaceable``.

    ``replaceable`` is judged on the stored row. One full join by key, so a repeated batch changes nothing more.
    """
    columns = [c for c in stored.columns if c != key]
    old = stored.select(key, F.struct(*columns).alias("old"), replaceable.alias("gives_way"))
    joined = old.join(incoming.select(key, F.struct(*columns).alias("new")), key, "full")
    changed = F.col("new").isNotNull() & (F.col("old").isNull() | F.coalesce("gives_way", F.lit(False)))
    return joined.select(key, F.when(changed, F.col("new")).otherwise(F.col("old")).alias("row"), changed.alias("changed")).select(key, "row.*", "changed")


def retired(stored: DataFrame, listed: DataFrame, key: str = "url") -> DataFrame:
    """``stored`` with listed rows that were watched rejected and their candidate cleared; ``changed`` marks them."""
    marked = stored.join(listed.select(key).distinct().withColumn("listed", F.lit(True)), key, "left")
    changed = F.coalesce("listed", F.lit(False)) & (F.col("publish_decision") == "watch")
    rows = marked.withColumn("changed", changed).drop("listed")
    gone = F.col("changed")
    return rows.withColumns({"publish_decision": F.when(gone, "reject").otherwise(F.col("publish_decision")), "candidate_concept": F.when(gone, F.lit(None).cast("string")).otherwise(F.col("candidate_concept"))})


def compare_and_set(stored: DataFrame, proposed: DataFrame, key: str, guards: list[str], fields: list[str]) -> DataFrame:
    """``stored`` with the proposed values of ``fields`` where all ``guards`` and fields still are as the proposal saw them, and ``outcome``.

    ``proposed`` has key, seen (struct of guards and fields), next (struct of fields) and failed. The outcome is updated,
    conflict, failed, or null where nothing was proposed.
    """
    seen = F.struct(*[F.col(c) for c in (*guards, *fields)])
    joined = stored.join(proposed.select(key, "seen", "next", "failed", F.lit(True).alias("asked")), key, "left")
    same = F.to_json(seen, {"ignoreNullFields": "false"}) == F.to_json("seen", {"ignoreNullFields": "false"})
    outcome = F.when(F.col("asked").isNull(), None).when(F.coalesce("failed", F.lit(False)), "failed").when(same, "updated").otherwise("conflict")
    rows = joined.withColumn("outcome", outcome)
    updated = F.coalesce(F.col("outcome") == "updated", F.lit(False))
    return rows.withColumns({f: F.when(updated, F.col(f"next.{f}")).otherwise(F.col(f)) for f in fields}).select(*stored.columns, "outcome")


def appended(current: DataFrame, incoming: DataFrame, payload: list[str], as_of: Column) -> DataFrame:
    """(slug, outcome, revision, created_at, changed_at): what an incoming state of each concept becomes.

    Equal payloads, by hash, are unchanged. A formal concept that would become a candidate is rejected, for a set-based job
    keeps a list of refusals instead of stopping. Others are appended as the next revision; a new concept is created. The
    time of the last meaningful change moves only if the payload's first field does. Both sides: slug, stage and the
    payload's fields; ``current`` also revision, created_at, changed_at.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"}), 256)
    old = current.select("slug", "revision", "created_at", "changed_at", digest.alias("old_hash"), F.col("stage").alias("old_stage"), F.col(payload[0]).alias("old_first"))
    rows = incoming.select("slug", "stage", F.col(payload[0]).alias("first"), digest.alias("new_hash")).join(old, "slug", "left")
    formal = ~F.col("old_stage").isin("candidate", "archived")
    outcome = F.when(F.col("revision").isNull(), "created").when(F.col("old_hash") == F.col("new_hash"), "unchanged").when(formal & (F.col("stage") == "candidate"), "rejected").otherwise("appended")
    grows = outcome.isin("created", "appended")
    meaningful = grows & ~F.col("first").eqNullSafe(F.col("old_first"))
    return rows.select("slug", outcome.alias("outcome"), (F.coalesce("revision", F.lit(0)) + grows.cast("int")).alias("revision"), F.coalesce("created_at", as_of).alias("created_at"), F.when(meaningful, as_of).otherwise(F.col("changed_at")).alias("changed_at"))


def audit(attempts: DataFrame, outputs: DataFrame) -> DataFrame:
    """(url, status, attempts, outputs) of each item: its last state, how many attempts, and what the last one wrote, in order.

    ``attempts``: id, url, at, status, slug, revision (an older form of a single output); ``outputs``: attempt_id, place, slug,
    revision. A completed attempt without listed outputs counts its own.
    """
    last = attempts.groupBy("url").agg(F.max_by(F.struct("id", "status", "slug", "revision"), F.struct("at", "id")).alias("l"), F.count("*").alias("attempts"))
    listed = outputs.groupBy("attempt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "slug", "revision"))), lambda o: F.concat_ws(":", o["slug"], o["revision"])).alias("listed"))
    rows = last.join(listed, F.col("l.id") == F.col("attempt_id"), "left")
    own = F.when((F.col("l.status") == "completed") & F.col("l.slug").isNotNull() & F.col("l.revision").isNotNull(), F.array(F.concat_ws(":", "l.slug", "l.revision"))).otherwise(F.array().cast("array<string>"))
    return rows.select("url", F.col("l.status").alias("status"), "attempts", F.coalesce("listed", own).alias("outputs"))


def knowledge_status(concepts: DataFrame, claims: DataFrame, evidence: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: formal, candidate and merged concepts, revisions, claims, evidence, and items whose last attempt failed or is open."""
    formal = ~F.col("stage").isin("candidate", "archived")
    alive = F.col("merged_into").isNull()
    counts = concepts.agg(F.count_if(alive & formal).alias("formal"), F.count_if(alive & (F.col("stage") == "candidate")).alias("candidates"), F.count_if(~alive).alias("merged"), F.coalesce(F.sum("revision"), F.lit(0)).alias("revisions"))
    work = attempts.agg(F.count_if(F.col("status").isin("failed", "conflict")).alias("failed"), F.count_if(F.col("status") != "completed").alias("pending"))
    one = [counts, claims.agg(F.count("*").alias("claims")), evidence.agg(F.count_distinct("slug", "url").alias("evidence")), work]
    whole = one[0]
    for part in one[1:]:
        whole = whole.crossJoin(part)  # frames of one row
    return whole


def newest_failures(attempts: DataFrame, most: int = 10) -> DataFrame:
    """The newest failed attempts."""
    return attempts.filter(F.col("status").isin("failed", "conflict")).orderBy(F.desc("at"), "url").limit(most)
