"""Logs, recovery, claims, gates and search on small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import knowledge as kn
from tidemark.operators import ledger, search, views
from tidemark.operators import payloads as pl


def test_log_gives_every_revision_back(spark):
    rng = random.Random(5)
    states, revisions, now = [], [], {s: {} for s in "abc"}
    for r in range(1, 8):
        for s in now:
            for f in rng.sample("vwxyz", 2):
                now[s][f] = rng.choice([None, "1", "2"])
            now[s] = {f: v for f, v in now[s].items() if v}
            revisions.append((s, r))
            states += [(s, r, f, v) for f, v in now[s].items()]
    of_revisions, of_states = spark.createDataFrame(revisions, "slug string, revision int"), spark.createDataFrame(states, "slug string, revision int, field string, value string")
    log = ledger.field_log(of_revisions, of_states)
    assert log.count() <= 2 * len(revisions)  # two fields at most change in a revision, so the log grows with the changes
    assert sorted(map(tuple, ledger.fields_at(log, of_revisions).collect())) == sorted((s, r, f, v) for s, r, f, v in states)
    validity = of_revisions.withColumn("valid", F.col("revision") != 7)
    current = validity.filter("revision = 7").filter("slug <> 'c'").unionByName(validity.filter("revision = 6 AND slug = 'c'"))
    got = pl.recovered_fields(current, validity, log)
    assert sorted((r.slug, r.field, r.value) for r in got.collect()) == sorted((s, f, v) for s, r, f, v in states if r == 6)
    assert pl.recovered_fields(current, validity.withColumn("valid", F.lit(False)), log).filter("slug <> 'c'").isEmpty()


def test_claims_supersede_only_the_owner_that_lost(spark):
    as_of = F.lit("2024-01-10").cast("timestamp")
    work = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h"), (4, None)], "id long, content_hash string")
    leases = spark.createDataFrame([(1, "h", "a", "2024-01-11"), (2, "h", "a", "2024-01-09"), (3, "old", "a", "2024-01-11")], "id long, content_hash string, owner string, until string").select("id", "content_hash", "owner", F.to_timestamp("until").alias("leased_until"))
    attempts = spark.createDataFrame([(1, "a", "running"), (2, "a", "running"), (2, "b", "running"), (3, "a", "completed")], "id long, owner string, status string")
    claims, after = ledger.claimed(work, leases, attempts, as_of, F.lit("me"))
    assert sorted(r.id for r in claims.collect()) == [2, 3, 4]
    assert sorted(map(tuple, after.collect())) == [(1, "a", "running"), (2, "a", "superseded"), (2, "b", "running"), (3, "a", "completed")]


def test_gates(spark):
    rows = spark.createDataFrame([(1,), (2,)], "a int")
    assert views.gated(rows, rows.limit(0), rows.limit(0)).count() == 2
    assert views.gated(rows, rows.limit(0), rows).count() == 0
    assert views.gated(rows.limit(0)).count() == 0


def test_search_over_concepts(spark):
    fields = spark.createDataFrame([("c", "definition", "A Thing"), ("c", "themes", "t1\nt2"), ("c", "stage", "secret"), ("d", "aliases", "x\nOther"), ("d", "definition", None)], "slug string, field string, value string")
    labels = spark.createDataFrame([("t1", "First Theme")], "theme string, label string")
    texts = search.concept_texts(fields, labels, ["definition", "themes", "aliases"])
    kinds = {"concept": texts.select(F.col("slug").alias("id"), "text")}
    found = lambda needle: sorted(map(tuple, search.search(kinds, needle).collect()))
    assert [found(n) for n in (" thing ", "thing first", "OTHER", "secret", "t1", "", "none")] == [[("concept", "c")], [("concept", "c")], [("concept", "d")], [], [], [], []]


def test_maintenance_outcomes(spark):
    states = spark.createDataFrame([("a", "emerging", 50, 1.0, True, True), ("b", "candidate", 0, 0.0, True, True), ("c", "validated", 50, 1.0, False, True), ("d", "emerging", 50, 1.0, True, False)], "slug string, stage string, maturity long, heat double, supported boolean, usable boolean")
    relations = spark.createDataFrame([("a", "b"), ("b", "a"), ("d", "c")], "slug string, target string")
    done = spark.createDataFrame([("a", "emerging", 50, 1.0), ("b", "candidate", 0, 0.0), ("c", "archived", 50, 1.0), ("d", "candidate", 0, 0.0)], "slug string, stage string, maturity long, heat double")
    outcomes, kept = kn.maintenance(states, done, relations)
    assert sorted(map(tuple, outcomes.collect())) == [("a", "updated", 1), ("b", "unchanged", 0), ("c", "updated", 0), ("d", "failed", 0)]
    assert sorted(map(tuple, kept.collect())) == [("b", "a"), ("d", "c")]
