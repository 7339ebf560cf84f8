"""Queries on inputs whose size or letters the smallest tables don't have."""

from __future__ import annotations

import glob
import os
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import clustering as cl
from tidemark.operators import graph
from tidemark.operators import identity as idn
from tidemark.plans import registry
from tidemark.plans.inputs import table

SF = "/root/testdata/sf0.001"


def rows_of(spark, name, folder, own):
    """What a query gives, and what its SQL gives, on the tables of ``own`` and the smallest ones besides."""
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        if not os.path.exists(to := f"{folder}/{os.path.basename(path)}"):
            os.symlink(path, to)
    for made, rows in own.items():
        os.unlink(f"{folder}/{made}.parquet")
        rows.coalesce(1).write.parquet(f"{folder}/{made}.parquet")
    for to in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(to).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{to}{'/*.parquet' if os.path.isdir(to) else ''}')")
    found = registry.queries()[name](spark, str(folder))
    said = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(map(str, r)) for r in found.collect()), sorted(tuple(map(str, r)) for r in said)


def test_identities_never_broadcast_proposed_names(spark):
    proposals = spark.range(2000).select(
        "id", F.lit("create-new").alias("action"), F.concat(F.lit("s"), "id").alias("slug"), F.concat(F.lit("N "), "id").alias("name"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("x"), i, F.lit("-"), "id")).alias("aliases"),
        F.concat(F.lit("s"), "id").alias("canonical_slug"), F.lit(0.9).alias("confidence"), F.lit("emerging").alias("stage"),
    )
    concepts = spark.createDataFrame([("c", "X7 3!", ["n"], None)], "slug string, name string, aliases array<string>, merged_into string")
    owners, _ = idn.alias_registry(concepts.select("slug", F.col("name").alias("alias"), F.lit(0).alias("place")))
    found = idn.resolved_identities(proposals, concepts, owners)
    assert "explode(array_union" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.problem) for r in found.filter("problem IS NOT NULL").collect()] == [(3, "alias-taken")] and found.count() == 2000


def test_similar_pairs_of_copies_are_never_shuffled(spark, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK", 3)
    rng = random.Random(5)
    sets = [(i, "kl"[i % 2], ["a", "b", "c"] if i % 3 else sorted({rng.choice("abcdef") for _ in range(rng.randrange(0, 6))})) for i in range(80)]
    sets += [(7, "k", ["a", "b", "c"]), (None, "k", ["a", "b", "c"]), (90, None, ["a", "b", "c"]), (91, "k", None)]
    found = cl.similar_pairs(spark.createDataFrame(sets, "doc_id long, key string, tokens array<string>"), "key", 0.5)
    same = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
    sound = [s for s in sets if None not in s and s[2]]
    want = sorted((i, j, same(a, b)) for i, k, a in sound for j, m, b in sound if i < j and k == m and same(a, b) >= 0.5)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 500
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert moved and not any("doc_id" in line or "other_id" in line for line in moved)


def test_page_items_keep_the_source_of_a_label(spark, tmp_path):
    page = '<article><p>Inoure token = {}f91f2b873 and words enough for a text. <p>Some more here of it</article>'
    pages = spark.createDataFrame([(i, f"https://e.example.com/{i}/", page.format(c)) for i, c in enumerate(["&quot;", "&amp;", "&#39;", "&amp;amp;", "'", "x"])], table(spark, SF, "pages").schema)
    got, want = rows_of(spark, "b_page_items", tmp_path, {"pages": pages})
    assert got == want and sum("&quot;" in str(r) for r in got) == 1


def test_shortlist_hints_of_words_without_capitals_of_their_own(spark, tmp_path):
    docs = table(spark, SF, "documents").withColumn("text", F.when(F.col("doc_id") == 20, F.concat(F.lit("berzußen und\n"), "text")).when(F.col("doc_id") == 40, F.concat(F.lit("strassen\n"), "text")).otherwise(F.col("text")))
    got, want = rows_of(spark, "d_shortlist", tmp_path, {"documents": docs})
    assert got == want and any(r[0] == "21" and "100" in r for r in got)


def test_levels_rank_nodes_of_one_place_by_themselves(spark):
    edges = spark.createDataFrame([("root", f"n{i * 37 % 60:02}", i % 2) for i in range(60)], "src string, dst string, position int")
    assert [r.node for r in graph.levels(edges).filter("depth = 1").orderBy("rank").collect()] == [f"n{i * 37 % 60:02}" for p in (0, 1) for i in sorted(range(p, 60, 2), key=lambda i: i * 37 % 60)]


def test_owners_of_terms_are_found_once_for_a_text(spark):
    texts = spark.createDataFrame([(i, None if i == 3 else f"{'ab' * (i % 7)} Cd{i} e{i % 5}") for i in range(60)], "id long, text string")
    terms = spark.createDataFrame([(f"m{m}", None if m == 2 else m, t) for m in range(4) for t in ["ab", "b", "ba", f"cd{m}", f"e{m}", "zz", "", None]] * 2, "model string, n int, term string")
    want = sorted({(r.id, t.model, str(t.n)) for r in texts.collect() for t in terms.collect() if r.text and t.term and t.term in r.text.lower()})
    for most in (1 << 20, 0):
        found = idn.mentioned_owners(texts, terms, most)
        assert sorted((r.id, r.model, str(r.n)) for r in found.collect()) == want and want
    assert idn.mentioned_owners(texts, terms.limit(0)).collect() == []


def test_titles_are_compared_by_numbers_of_tokens(spark):
    rows = [("c", i, i, f"title w{i % 4} of words x{i % 3} y{i % 2}" if i % 5 else f"other z{i % 2}", ["t", f"u{i % 2}"], None, None, True) for i in range(40)]
    items = spark.createDataFrame(rows, "concept_slug string, place long, id long, title string, tags array<string>, independent_group string, event_key string, joins boolean")
    stored = items.limit(0).drop("id", "joins").withColumn("signal_slug", F.lit(""))
    classes = cl.title_classes(cl.comparable(items, stored))
    met = cl.similar_classes(classes)
    assert "my_tokens" not in (plan := met._jdf.queryExecution().executedPlan().toString()) and "tokens#" not in plan
    of = {r.cls: r for r in classes.collect()}
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    score = lambda a, b: round(0.8 * share(a.tokens, b.tokens) + 0.2 * share(a.tags, b.tags), 9)
    want = sorted((a.cls, score(a, b), b.first.id) for a in of.values() for b in of.values() if score(a, b) >= 0.5 and share(a.tokens, b.tokens) >= 0.375)
    assert sorted((r.cls, round(r.score, 9), r.first.id) for r in met.collect()) == want and len(want) > len(of)
