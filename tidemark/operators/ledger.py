"""Ledger of revisions: numbering, changed fields, appends, outcomes and claims of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_revisions(rows: DataFrame, entity: str, order: list[str], fields: list[str]) -> DataFrame:
    """Adds ``revision`` from 1 and ``changed``: the fields that differ from the revision before, all in the first."""
    history = Window.partitionBy(entity).orderBy(*order)
    differs = [F.when(~F.col(f).eqNullSafe(F.lag(f).over(history)) | (F.row_number().over(history) == 1), F.lit(f)) for f in fields]
    return rows.withColumns({"revision": F.row_number().over(history), "changed": F.array_compact(F.array(*differs))})


def append_revisions(current: DataFrame, incoming: DataFrame, entity: str, payload: list[str]) -> DataFrame:
    """(entity, revision, appended): an incoming payload equal to the current one by hash is no revision."""
    digest = F.sha2(F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"}), 256)
    old = current.select(entity, F.col("revision").alias("old_revision"), digest.alias("old_hash"))
    new = incoming.select(entity, digest.alias("new_hash"))
    appended = F.col("old_hash").isNull() | (F.col("old_hash") != F.col("new_hash"))
    return new.join(old, entity, "left").select(entity, (F.coalesce("old_revision", F.lit(0)) + appended.cast("int")).alias("revision"), appended.alias("appended"))


def outcome(found_hash: Column, expected_hash: Column, found_owner: Column, expected_owner: Column, failed: Column) -> Column:
    """What became of a unit of work: superseded, conflict, failed or updated, in this order."""
    return (
        F.when(~found_owner.eqNullSafe(expected_owner), "superseded").when(~found_hash.eqNullSafe(expected_hash), "conflict")
        .when(F.coalesce(failed, F.lit(False)), "failed").otherwise("updated")
    )


def claimable(work: DataFrame, as_of: Column) -> DataFrame:
    """Rows without a live lease on the same content: (leased_until, leased_hash, content_hash) tell."""
    live = (F.col("leased_until") > as_of) & F.col("leased_hash").eqNullSafe(F.col("content_hash"))
    return work.filter(~F.coalesce(live, F.lit(False)))


def claimed(work: DataFrame, leases: DataFrame, attempts: DataFrame, as_of: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """((id, content_hash, owner) of the work that is claimed now, the attempts after it).

    ``work``: id, content_hash; ``leases``: id, content_hash, owner, leased_until, one an id; ``attempts``: id, owner, status and
    any others. A running attempt of the owner whose lease the claim takes over is superseded; all others stay as they are.
    """
    held = leases.select("id", F.col("content_hash").alias("leased_hash"), F.col("owner").alias("held_by"), "leased_until")
    free = claimable(work.join(held, "id", "left"), as_of)
    lost = free.filter(F.col("held_by").isNotNull()).select("id", F.col("held_by").alias("owner"), F.lit(True).alias("is_lost"))
    status = F.when(F.col("is_lost") & (F.col("status") == "running"), "superseded").otherwise(F.col("status"))
    after = attempts.join(lost, ["id", "owner"], "left").withColumn("status", status)
    return free.select("id", "content_hash", owner.alias("owner")), after.select(*attempts.columns)


def field_log(revisions: DataFrame, states: DataFrame) -> DataFrame:
    """(slug, revision, field, before, value): what each revision changed, a null value where it took a field away.

    ``revisions``: slug, revision, each once; ``states``: slug, revision, field, value, the whole of each. Any fields may come and go.
    """
    grid = revisions.select("slug", "revision").join(states.select("slug", "field").distinct(), "slug")
    whole = grid.join(states.select("slug", "revision", "field", "value"), ["slug", "revision", "field"], "left")
    before = F.lag("value").over(Window.partitionBy("slug", "field").orderBy("revision"))
    return whole.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("value"))).select("slug", "revision", "field", "before", "value")


def fields_at(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slug, at, field, value) of concepts as of the revisions ``wanted`` (slug, revision), from a log of changes alone."""
    asked = wanted.select("slug", F.col("revision").alias("at")).distinct()
    known = log.join(asked, "slug").filter(F.col("revision") <= F.col("at"))
    return known.groupBy("slug", "at", "field").agg(F.max_by("value", "revision").alias("value")).filter(F.col("value").isNotNull())


def first_usable(attempts: DataFrame, source: str, usable: Column, order: list[str]) -> DataFrame:
    """(source, status, chosen, failures_before): success if the first attempt works, degraded if a later one, else error.

    Aggregates only: attempts are combined before the shuffle, so one source may hold any number of them.
    """
    place = F.struct(*order)
    best = attempts.groupBy(source).agg(F.min(F.when(usable, place)).alias("best"), F.min(place).alias("first"))
    failures = attempts.join(best.select(source, "best"), source).groupBy(source).agg(F.count_if(F.col("best").isNull() | (place < F.col("best"))).alias("failures_before"))
    status = F.when(F.col("best").isNull(), "error").when(F.col("best") == F.col("first"), "success").otherwise("degraded")
    return best.join(failures, source).select(source, status.alias("status"), F.col("best")[order[-1]].alias("chosen"), "failures_before")


def positive_growth(history: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """(entity, warming): the sum of all increases from one point of the history to the next."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(entity).orderBy(time))
    return history.select(entity, F.greatest(step, F.lit(0)).alias("step")).groupBy(entity).agg(F.sum(F.coalesce("step", F.lit(0))).alias("warming"))
