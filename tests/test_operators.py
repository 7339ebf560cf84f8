"""Operators of the library against brute force, and properties that hold whatever the order or the partitions."""

import datetime as dt
import hashlib
import os
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import clustering as cl
from tidemark.operators import graph
from tidemark.operators import identity as idn
from tidemark.operators import ordering, signals, upserts, views
from tidemark.operators import payloads as pl
from tidemark.streaming import items as it

ITEM = "concept_slug string, place long, id long, title string, tags array<string>, independent_group string, event_key string, joins boolean"
STORED = "concept_slug string, place long, title string, tags array<string>, independent_group string, event_key string, signal_slug string"


def column(spark, make, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in rows.select(make(F.col("v")).alias("out"), "i").orderBy("i").collect()]


def test_addresses(spark):
    given = {
        "https://Example.com/a?utm_source=x&id=7&REF=z#part": "https://example.com/a?id=7", "https://example.com": "https://example.com/", "http://example.com/a": None, "https://user:pw@example.com/a": None,
        "https://localhost/a": None, "https://a.internal/": None, "https://127.0.0.1/": None, "https://10.1.2.3/": None, "https://172.20.0.1/": None, "https://172.32.0.1/": "https://172.32.0.1/", "https://192.0.2.7/": None,
        "https://198.51.100.2/x": None, "https://240.0.0.1/": None, "https://8.8.8.8/": "https://8.8.8.8/", "https://[::1]/": None, "https://[::ffff:10.0.0.1]/": None, "https://[fd00::1]/": None, "https://[2606:4700::1]/x": "https://[2606:4700::1]/x",
        "https://example.com:443/a?a=1&a=2": "https://example.com/a?a=1&a=2", "https://example.com:8443/a?feature=1&spm=2": "https://example.com:8443/a?feature=1&spm=2", "https://999.1.1.1/": None, "no address": None, None: None,
    }
    assert column(spark, tx.canonical_url, list(given)) == list(given.values())


def test_titles(spark):
    assert column(spark, tx.version_key, ["v1.2", "发布v1.2版", "x1.2", "1.2.3.", "a 10.0 b", "none"]) == ["1.2", "1.2", None, "1.2.3", "10.0", None]
    assert column(spark, lambda c: F.array_sort(tx.tokens(c)), ["The C++ 工程 at https://x.y/z a", ""]) == [["at", "c++", "the", "工程"], []]
    assert column(spark, tx.alias_key, ["Ａ－b", "A_b", "a·B", "①", None]) == ["ab", "ab", "ab", "1", None]
    assert column(spark, tx.candidate_slug, ["Über Graph!", "ab", "x" * 90])[0] == "u-ber-graph"
    day = dt.datetime(2024, 3, 5)
    assert column(spark, tx.find_date, ["on 2024/3/5 or so", "March 5, 2024", "2024-13-40", "nothing"]) == [day, day, None, None]
    assert column(spark, tx.date_from_url, ["https://x/2024/03/05/a", "https://x/2024/Mar/5", "https://x/2024/3"]) == [day, day, None]


def test_messages(spark):
    said = ["fetch of https://u:p@h.example.com/p?token=abc#x abc", "HTTP 503 from https://x/y"]
    assert column(spark, lambda c: tx.safe_message(c, F.lit("abc")), said) == ["fetch of h.example.com/p [redacted]", "HTTP 503"]
    assert column(spark, lambda c: tx.failure_category(c, F.lit("failed")), ["http 401", "HTTP 429", "http 502", "socket", "缺少 title", "?"]) == ["provider-auth", "provider-rate-limit", "provider-server-error", "provider-transport", "schema-contract", "concept-analysis-failed"]


def title_tokens(title):
    return frozenset(re.findall(r"[a-z][a-z0-9+#.-]+|[一-鿿]{2,}", re.sub(r"https?://\S+", " ", title.lower())))


def version_of(title):
    found = re.search(r"(?<![A-Za-z0-9_])v?(\d+\.\d+(?:\.\d+)?)(?![A-Za-z0-9_])", title, re.I)
    return found[1] if found else None


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def new_slug(concept, title):
    digest = hashlib.sha256(f"{concept}\n{title.lower()}".encode()).hexdigest()
    return f"{concept}-{digest[:10]}"


def brute_assigned(items, stored):
    """Every candidate is looked at, in order, for every item."""
    out, known = {}, {}
    for c, _, title, tags, group, event, slug in sorted(stored, key=lambda r: r[1]):
        known.setdefault(c, []).append((slug, title, tags, group, event))
    for c, _, i, title, tags, group, event, joins in sorted(items, key=lambda r: (r[1], r[2])):
        version, best, found = version_of(title), (0, None), None
        for slug, t, g_tags, g, e in known.get(c, []):
            v = version_of(t)
            if version and v and version != v:
                continue
            if (event and event == e) or (version and v and g == group):
                found = slug
                break
            score = 0.8 * overlap(title_tokens(title), title_tokens(t)) + 0.2 * overlap(frozenset(tags), frozenset(g_tags))
            if score >= 0.5 and score > best[0]:
                best = (score, slug)
        out[i] = found or best[1] or new_slug(c, title)
        if joins:
            known.setdefault(c, []).append((out[i], title, tags, group, event))
    return out


@pytest.fixture(scope="module")
def arrivals():
    rng = random.Random(4)
    words = ["agent", "graph", "engine", "tools", "v1.2", "v1.3", "notes", "tests", "图引擎", "runtime"]
    title = lambda: " ".join(rng.sample(words, rng.randrange(2, 6)))
    row = lambda: (title(), rng.sample(["a", "b", "c"], 2), rng.choice(["g1", "g2", None]), rng.choice(["e1", "e2", None, None, None]))
    items = [(rng.choice(["c1", "c2", "c3"]), n // 2, n, *row(), rng.random() < 0.7) for n in range(160)]
    stored = [(rng.choice(["c1", "c2"]), n, *row(), f"old-{n}") for n in range(8)]
    return items, stored


@pytest.mark.parametrize("parts", [1, 5])
def test_assignment_is_that_of_a_full_scan_in_order(spark, arrivals, parts):
    items, stored = arrivals
    shuffled = random.Random(parts).sample(items, len(items))
    got = cl.assigned(spark.createDataFrame(shuffled, ITEM).repartition(parts), spark.createDataFrame(stored, STORED)).collect()
    assert {r.id: r.signal_slug for r in got} == brute_assigned(items, stored)
    assert cl.assigned(spark.createDataFrame([], ITEM), spark.createDataFrame([], STORED)).collect() == []


def test_assignment_of_one_concept_of_many_items(spark):
    """Equal titles, chains, ties of place, tags, versions and odd rows, all in one concept."""
    rng = random.Random(11)
    words = [f"w{n}x" for n in range(30)] + ["v1.2", "2.0"]
    titles = [" ".join(rng.sample(words, rng.randrange(1, 7))) for _ in range(60)]
    items = [("hot", n // 3, n, rng.choice(titles) if n % 3 else " ".join(rng.sample(words, 4)), rng.sample(["a", "b"], rng.randrange(3)), rng.choice(["g", "h", None]), f"e{n}" if n % 40 else "", n % 5 != 0) for n in range(700)]
    items += [("hot", 400 + n, 1000 + n, " ".join(f"c{k}k" for k in range(n, n + 9)), [], None, None, True) for n in range(150)]  # each joins the one before it
    got = cl.assigned(spark.createDataFrame(items, ITEM), spark.createDataFrame([], STORED)).collect()
    assert {r.id: r.signal_slug for r in got} == brute_assigned(items, [])
    odd = [(None, None, 1, None, None, None, None, None), (None, 1, 2, "", [], None, "", True), ("", 1, 3, "same title here", None, None, None, True), (None, 2, 4, "same title here", ["t", None, "t"], None, None, True), (None, 3, 5, "Same Title here", ["t"], None, None, False)]
    got = {r.id: r.signal_slug for r in cl.assigned(spark.createDataFrame(odd, ITEM), spark.createDataFrame([], STORED)).collect()}
    assert got[1] == got[2] == new_slug("", "") and got[3] == new_slug("", "same title here") == got[4] == got[5]


def test_assignment_of_a_stream_goes_on_where_it_stopped(spark, arrivals, tmp_path):
    items, _ = arrivals
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/job"
    for first in (0, 60, 110):
        batch = [r for r in items if first <= r[1] * 2 < {0: 60, 60: 110, 110: 1000}[first]]
        spark.createDataFrame(batch, ITEM).coalesce(1).write.mode("append").parquet(source)
        rows = it.assign_stream(it.stream_of(spark, source), folder)()
    assert {r.id: r.signal_slug for r in rows.collect()} == brute_assigned(items, [])


def test_a_run_with_nothing_new_gives_all_rows_again(spark, arrivals, tmp_path):
    items, _ = arrivals
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/job"
    spark.createDataFrame(items[:40], ITEM).coalesce(1).write.parquet(source)
    run = lambda: {r.id: r.signal_slug for r in it.assign_stream(it.stream_of(spark, source), folder)().collect()}
    assert run() == run() == brute_assigned(items[:40], [])
    shutil.rmtree(f"{tmp_path}/job/checkpoint")  # the batch comes again under its old number
    assert run() == brute_assigned(items[:40], [])


def test_candidates_of_a_stream_expire(spark, tmp_path):
    """60 days, a batch every twelve: as with the window over a full scan; days that are out of reach are gone from the disk."""
    rng = random.Random(6)
    words = ["agent", "graph", "engine", "tools", "notes", "tests"]
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("c", n, n, " ".join(rng.sample(words, 3)), ["t"], "g", None, n % 4 != 0, day(n // 2)) for n in range(120)]
    rows.append(("c", 500, 500, "agent graph engine", ["t"], "g", None, True, None))
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/job"
    known, want = [], {}
    for first in range(0, 120, 24):
        batch = rows[first : first + 24] + (rows[-1:] if first == 0 else [])
        spark.createDataFrame(batch, ITEM + ", at timestamp").coalesce(1).write.mode("append").parquet(source)
        got = it.assign_stream(it.stream_of(spark, source), folder, "at")()
        oldest = day((first + 23) // 2 - 21)
        found = brute_assigned([r[:8] for r in batch], [(r[0], r[1], *r[3:7], want[r[2]]) for r in known if r[8] is None or r[8] >= oldest])
        want |= found
        known += [r for r in batch if r[7]]
    assert {r.id: r.signal_slug for r in got.collect()} == want
    days = {p.name for p in tmp_path.glob("job/state/batch=*/day=*")}
    assert len(days) == 23 and f"day={oldest:%Y-%m-%d}" in days | {"day=always"} and min(days) >= f"day={oldest:%Y-%m-%d}"


def test_upserts_of_a_stream_survive(spark, tmp_path):
    kinds = "url string, publish_decision string, n int"
    watched = F.col("publish_decision") == "watch"
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/job"
    stored = spark.createDataFrame([("a", "watch", 1), ("b", "publish", 2)] + [(f"x{n}", "publish", n) for n in range(50)], kinds)
    run = lambda: {r.url: (r.publish_decision, r.n) for r in it.upsert_stream(it.stream_of(spark, source), stored, "url", watched, folder, F.col("n")).filter("url not like 'x%'").collect()}
    spark.createDataFrame([("a", "publish", 5), ("c", "watch", 7), ("c", "publish", 8), ("c", "publish", 9), ("d", "watch", 1), ("d", "watch", 2), (None, "watch", 3)], kinds).write.parquet(source)
    want = {"a": ("publish", 5), "b": ("publish", 2), "c": ("publish", 8), "d": ("watch", 2)}
    assert run() == want == run()
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("job/table/bucket=*/*.parquet")}
    spark.createDataFrame([("d", "publish", 4)], kinds).write.mode("append").parquet(source)
    assert run() == want | {"d": ("publish", 4)}
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("job/table/bucket=*/*.parquet")}
    assert len({p.parent for p in before.items() ^ after.items() for p in p[:1]}) == 1  # one bucket was written
    shutil.rmtree(f"{tmp_path}/job/checkpoint")  # all batches come again
    assert run() == want | {"d": ("publish", 4)}


def test_mentions_by_pieces_are_those_of_the_broadcast(spark):
    rng = random.Random(9)
    texts = spark.createDataFrame([(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(60)))) for i in range(80)] + [(99, None)], "id long, text string")
    terms = spark.createDataFrame([("".join(rng.choice("abc ") for _ in range(n)), n) for n in (1, 3, 5, 5, 6, 7, 8)], "term string, n int").distinct()
    rows = lambda few: sorted(map(tuple, idn.mentions(texts, terms, few).collect()))
    plain = [(i, term, n) for i, t in map(tuple, texts.collect()) for term, n in map(tuple, terms.collect()) if t is not None and term in t.lower()]
    assert rows(0) == rows(100) == sorted(plain) and plain


def test_mentions_of_very_many_terms(spark):
    """100,000 terms, an empty and a null one, a repeated one, and a hot text and term; texts have further columns."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    names = sorted({word(rng.randrange(3, 9)) for _ in range(120_000)})[:100_000]
    texts = [(i, f"{word(60)} Zürich ABCDE", "clash", dt.datetime(2024, 1, 1)) for i in range(60)] + [(60, "", None, None), (61, None, None, None)]
    df = spark.createDataFrame(texts, "id long, text string, piece string, at timestamp")
    terms = spark.createDataFrame([(n, 1) for n in [*names, "", None, "zürich", "zürich"]], "term string, weight int")
    want = sorted((i, term) for i, t, *_ in texts if t for term in [*names, "zürich", "zürich"] if term in t.lower())
    for most in (1 << 24, 1000):
        assert sorted((r.id, r.term) for r in idn.mentions(df, terms, most).collect()) == want
    plan = idn.mentions(df, terms)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_similar_pairs_are_all_there(spark):
    rng = random.Random(3)
    sets = [(i, "k", sorted({rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9))})) for i in range(70)]
    got = {(r.doc_id, r.other_id) for r in cl.similar_pairs(spark.createDataFrame(sets, "doc_id long, key string, tokens array<string>"), "key", 0.6).collect()}
    want = {(i, j) for i, _, a in sets for j, _, b in sets if i < j and a and b and round(len(set(a) & set(b)) / len(set(a) | set(b)), 6) >= 0.6}
    assert got == want and want


def test_numbers_are_gapless_in_groups_of_any_size(spark):
    rows = spark.range(3000).select((F.col("id") * F.col("id") % 1_000_003).alias("at"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("grp"))
    found = ordering.numbered(rows, "grp", "at", "nth", ranges=9).collect()
    for grp in {r.grp for r in found}:
        own = sorted((r.at, r.nth) for r in found if r.grp == grp)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert ordering.numbered(rows.limit(0), "grp", "at", "nth").collect() == []


def test_upserts_are_idempotent(spark):
    stored = spark.createDataFrame([("a", "watch", 1), ("b", "publish", 2)], "url string, publish_decision string, n int")
    new = spark.createDataFrame([("a", "publish", 5), ("b", "publish", 6), ("c", "watch", 7)], "url string, publish_decision string, n int")
    once = upserts.upserted(stored, new, "url", F.col("publish_decision") == "watch")
    assert sorted(map(tuple, once.collect())) == [("a", "publish", 5, True), ("b", "publish", 2, False), ("c", "watch", 7, True)]
    twice = upserts.upserted(once.drop("changed"), new, "url", F.col("publish_decision") == "watch")
    assert sorted(r.n for r in twice.collect()) == [2, 5, 7]


def test_a_snapshot_is_written_only_without_issues(spark):
    rows = spark.range(3)
    assert views.publish(rows, 2) is None
    assert spark.read.parquet(views.publish(rows, 0)).count() == 3


def test_heat_grows_with_each_of_its_parts(spark):
    at = dt.datetime(2024, 1, 30)
    base = [("k", "g1", "s", 10, at, at)]
    kinds = "key string, independent_group string, source_id string, engagement_count long, published_at timestamp, discovered_at timestamp"
    score = lambda rows: signals.heat(spark.createDataFrame(rows, kinds), "key", F.lit("2024-01-31").cast("timestamp")).first().score
    plain = score(base)
    assert score([("k", "g1", "s", 900, at, at)]) > plain and score([*base, ("k", "g2", "s", 0, at, at)]) > plain and score([("k", "g1", "s", 10, at + dt.timedelta(hours=12), at)]) > plain


def test_merged_payloads_of_nothing_are_empty(spark):
    empty = pl.Payloads(*(spark.createDataFrame([], s) for s in (
        "slug string, field string, value string", "slug string, key string, text string, kind string, confidence double", "slug string, url string, title string, source_layer string, grp string, stance string, decision string, supports array<string>",
        "slug string, field string, urls array<string>", "slug string, type string, target string, confidence double, urls array<string>")))
    whole, conflicts = pl.merged(empty, empty, spark.createDataFrame([], "slug string, field string"))
    assert conflicts.collect() == [] and whole.evidence.collect() == [] and whole.citations.collect() == []
    assert pl.violations(empty, spark.createDataFrame([("a", "candidate")], "slug string, stage string"), spark.createDataFrame([], "slug string")).filter("code = 'no-claims'").count() == 1


def test_the_entry_without_the_training_data_operators(tmp_path):
    """With both removed, the entry imports and offers the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name in ('tidemark.llm', 'corpus_pipeline') or name.startswith('tidemark.llm.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'flagship_signals' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def plain_levels(edges):
    """Kahn's algorithm; what it does not reach lies one below."""
    names = list(dict.fromkeys(n for e in edges if e[0] != e[1] for n in e))
    out, count = {n: set() for n in names}, dict.fromkeys(names, 0)
    for a, b in set(edges):
        if a != b:
            out[a].add(b)
            count[b] += 1
    depth, queue, seen = dict.fromkeys(names, 0), [n for n in names if not count[n]], set()
    for n in queue:
        seen.add(n)
        for m in out[n]:
            depth[m] = max(depth[m], depth[n] + 1)
            count[m] -= 1
            queue += [m] * (not count[m])
    lowest = max((depth[n] for n in seen), default=-1) + 1
    depth = {n: depth[n] if n in seen else lowest for n in names}
    rank = {}
    for n in names:
        rank[n] = sum(depth[m] == depth[n] for m in rank) + 1
    return {n: (depth[n], rank[n], sum(d == depth[n] for d in depth.values())) for n in names}


LADDER = [(f"{a}{i}", f"{b}{i + (a == 'd')}") for i in range(6) for a, b in ("ab", "ac", "bd", "cd", "da")]
GRAPHS = {
    "ladder of diamonds": LADDER, "ring with a tail and a way in": [("x", "y"), ("y", "z"), ("z", "y"), ("z", "t"), ("t", "tt"), ("r", "x"), ("r", "t")], "ring alone": [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")],
    "ring and path": [("a", "b"), ("b", "a"), ("p", "q"), ("q", "s")], "loops only": [("a", "a")], "random": [(f"n{random.Random(i).randrange(30)}", f"n{random.Random(-i - 1).randrange(60)}") for i in range(60)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_levels(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, position int").repartition(3)
    assert {r.node: (r.depth, r.rank, r.column_size) for r in graph.levels(df).collect()} == plain_levels(edges)


def test_levels_of_a_long_path(spark):
    path = spark.range(100_000).select(F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("s"), F.col("id") + 1).alias("dst"))
    found = graph.levels(path)
    assert found.filter(F.concat(F.lit("s"), "depth") != F.col("node")).count() == 0 and found.count() == 100_001


def plain_homes(stored, incoming):
    """One by one: the first candidate of the list that has a key of the incoming one takes it, with its name and aliases."""
    listed, out = [(s, {s, n, *a}) for s, n, a, _ in sorted(stored, key=lambda r: r[3])], {}
    for slug, name, aliases, _ in sorted(incoming, key=lambda r: r[3]):
        keys = {slug, name, *aliases}
        for home, held in listed:
            if held & keys:
                held |= {name, *aliases}
                break
        else:
            home = slug
            listed.append((slug, keys))
        out[slug] = home
    return out


@pytest.mark.parametrize("seed", range(3))
def test_candidates_find_their_homes(spark, seed):
    """Keys that a home gains count on, incoming candidates meet each other, chains follow to their end, a slug's key goes when its owner joins another."""
    rng = random.Random(seed)
    key = lambda: f"k{rng.randrange(60)}"
    row = lambda n: (f"s{n}", key(), [key() for _ in range(rng.randrange(3))], n)
    stored, incoming = [row(n) for n in range(8)], [row(n) for n in range(100, 140)]
    incoming += [(f"c{n}", f"chain{n}", [f"chain{n + 1}"], 200 + n) for n in range(20)]  # each shares a key with the one before only
    incoming += [("t1", "t1name", [], 300), ("t2", "t1name", [], 301), ("t3", "t2", [], 302), ("t4", "t1", [], 303)]
    kinds = "slug string, name string, aliases array<string>, place int"
    got = idn.candidate_homes(spark.createDataFrame(stored, kinds), spark.createDataFrame(incoming, kinds).repartition(3))
    assert {r.slug: r.home for r in got.collect()} == plain_homes(stored, incoming)
