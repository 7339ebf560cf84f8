"""Odd inputs for every operator, the SQL of the queries, and the pipeline as a whole."""

import collections
import functools
import glob
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, classlm, exact, langid, lines, mixing, quality, queries, shards, simhash, simhash_wide

SF = "/root/testdata/sf0.001"
CLASHING = ["_doc", "_hash", "_lines", "_quality", "_kept", "_start", "_n", "_rn", "_g", "own_0", "own_1", "row", "nth", "bucket", "block", "of", "id", "h1", "gone", "node", "n", "key", "word", "lang_2"]
LINE = "a passage of well over forty characters that many documents share"


def odd_rows():
    rng = random.Random(8)
    prose = [" ".join(f"w{rng.randrange(400)}" for _ in range(80)) for _ in range(12)]
    texts = [None, "", " \n\t ", "x" * 400_000, "word " * 60_000, f"{LINE}\n" * 3, *[f"{LINE}\nown {i} {p}" for i, p in enumerate(prose)], *prose[:4], prose[0], prose[0].upper()]
    rows = [(None if i % 9 == 8 else i // 2, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], rows[0]]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(c) for c in CLASHING}).repartition(3)


OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, queries.vocabulary_path()), "shards": lambda d: shards.shard_documents(d, slots=64), "class_lm": classlm.score_documents,
    "mixing": mixing.mix, "mixed_order": mixing.mixed_order, "simhash": simhash.near_duplicates, "keep_one": simhash_wide.keep_one_of_each,
    "quality": quality.verdicts, "keep_good": quality.keep_good, "language": langid.held_out_languages, "exact": exact.exact_duplicates, "lines": lines.deduplicate_lines,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(odd, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    if name in ("keep_good", "keep_one"):
        assert set(out.columns) == set(odd.columns) and 0 < len(rows) < odd.count()
    else:
        ids = [r[0] for r in odd.select("doc_id").collect()]
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(ids)
    if name in ("mixing", "mixed_order", "keep_good", "keep_one", "lines"):
        assert all(r[c] == c for r in rows for c in CLASHING)


def test_near_dedup_tells_rows_apart_that_repeat_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (None, a), (3, f" {b.upper()}\n")], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in simhash_wide.keep_one_of_each(docs).collect()}
    assert kept == {(1, a), (2, b), (None, a)}


def test_near_dedup_finds_every_pair_of_the_table(spark):
    """On all documents: groups are those of all pairs of texts at 0.8 or more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(simhash_wide.shingle_hashes((r.text or "").encode()).tolist()) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(docs).collect()} == {i: find(i) for i in sets}


@pytest.mark.parametrize("few", [0, 32])
def test_a_passage_that_long_texts_share_crowds_no_list(spark, monkeypatch, few):
    """40 texts of 1000 words with one passage of 30, in prefixes of no order by frequency; a text at the limit of each of four finds its own."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"w{rng.random()}" for _ in range(970)] + passage for _ in range(40)]
    near = [[f"x{rng.random()}" if k < 22 * 40 and k % 40 == 20 else word for k, word in enumerate(b)] for b in bases[:4]]
    texts = [" ".join(t) for t in bases + near]
    sets = [frozenset(simhash_wide.shingle_hashes(t.encode()).tolist()) for t in texts]
    linked = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)}
    assert linked == {(40 + i, i) for i in range(4)}
    rows, plain = collections.Counter(), simhash_wide.materialize

    def counted(df, label, keep=False):
        out = plain(df, label, keep)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(simhash_wide, "materialize", counted)
    monkeypatch.setattr(simhash_wide, "frequencies", lambda sketch: np.zeros(1 << simhash_wide.SKETCH_BITS, np.int64))
    monkeypatch.setattr(simhash_wide, "FEW_NODES", few)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(docs).collect()}
    assert got == {i: i - 40 if i >= 40 else i for i in range(44)}
    assert rows["wide-pairs"] <= 28 and rows["wide-members"] == 0  # no more than all of the eight that are in enough lists


def rows_made(spark, since=-1):
    """(last execution, [(node, rows)]): what the nodes of all plans after execution ``since`` gave out."""
    store = spark._jsparkSession.sharedState().statusStore()
    found, last, runs = [], since, store.executionsList()
    for run in (runs.apply(i) for i in range(runs.size())):
        if run.executionId() > since:
            last, values, nodes = max(last, run.executionId()), store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        found.append((node.desc(), int(values.apply(metric.accumulatorId()).replace(",", ""))))
    return last, found


def test_crowded_sets_are_not_taken_apart_to_find_their_center(spark, monkeypatch):
    """120 texts share a passage and go by differences from what most hold: no join, generator or task gives a row for each shingle of each of them."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    bases = [[f"w{rng.random()}" for _ in range(270)] + passage for _ in range(120)]
    near = [[f"x{rng.random()}" if k in (40, 90, 140, 190) else word for k, word in enumerate(b)] for b in bases[:5]]
    texts = [" ".join(t) for t in bases + near]
    shingles = sum(len(simhash_wide.shingle_hashes(t.encode())) for t in texts)
    members, centers, plain = [], [], simhash_wide.materialize

    def counted(df, label, keep=False):
        out = plain(df, label, keep)
        if label == "wide-members":
            members.append(out.count())
        if label == "wide-centers":
            centers.extend(set(r.of_main) for r in out.collect())
        return out

    monkeypatch.setattr(simhash_wide, "materialize", counted)
    monkeypatch.setattr(simhash_wide, "frequencies", lambda sketch: np.zeros(1 << simhash_wide.SKETCH_BITS, np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    last, _ = rows_made(spark)
    got = {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(docs).collect()}
    assert got == {i: i - 120 if i >= 120 else i for i in range(125)}
    assert sum(members) >= 100
    assert centers and all(c == set(simhash_wide.shingle_hashes(" ".join(passage).encode()).view(np.int64).tolist()) for c in centers)
    made = [(rows, node) for node, rows in rows_made(spark, last)[1] if re.match(r"Generate|\w*Join|Cartesian|\w*Arrow|\w*Python|\w*Pandas", node)]
    assert made and max(made)[0] < shingles / 2, max(made)


def test_near_dedup_measures_what_fingerprints_name(spark, monkeypatch):
    """The nearest pairs are linked by op5's method before any list is; where all fingerprints are equal, whole sets still decide."""
    rng = random.Random(7)
    bases = [[f"w{rng.random()}" for _ in range(400)] for _ in range(6)]
    texts = [" ".join(b) for b in bases] + [" ".join([*b[:-1], "new"]) for b in bases]
    docs = spark.createDataFrame([*enumerate(texts), (12, None), (13, " ")], "doc_id long, text string")
    want = {i: i % 6 for i in range(12)} | {12: 12, 13: 12}
    prints = [simhash.fingerprint_of(simhash_wide.shingle_hashes(t.encode())) for t in texts]
    assert prints == [simhash.signed(simhash.fingerprint(t.encode(), simhash_wide.SHINGLE_WORDS)) for t in texts]
    rows, plain = collections.defaultdict(list), simhash_wide.materialize

    def counted(df, label, keep=False):
        out = plain(df, label, keep)
        rows[label].append(out.filter("linked").count() if label == "wide-tested" else 0)
        return out

    monkeypatch.setattr(simhash_wide, "materialize", counted)
    assert {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(docs).collect()} == want
    assert rows["wide-tested"][0] == sum((a ^ b).bit_count() <= 2 for a, b in zip((p & (1 << 64) - 1 for p in prints[:6]), (p & (1 << 64) - 1 for p in prints[6:]), strict=True)) > 0
    monkeypatch.setattr(simhash_wide, "fingerprint_of", lambda hashes: 0)
    assert {r.doc_id: r.component_id for r in simhash_wide.near_duplicate_groups(docs).collect()} == want


def test_near_duplicates_by_fingerprint(spark):
    """Groups of all fingerprints of the table within two bits, by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    root = {i: i for i in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in found.items():
        for j, (b, _) in found.items():
            if j < i and (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {i: c for i, (_, c) in found.items()} == {i: find(i) for i in found}


def test_exact_weights_without_rounding(spark):
    """1000 : 1 : 0.4, for longer than the rarest source's first block: always within a block of the targets."""
    weights, rows = {"a": 1000.0, "b": 1.0, None: 0.4}, {"a": 9000, "b": 9, None: 4}
    docs = functools.reduce(lambda x, y: x.unionByName(y), [spark.range(n).select(F.col("id").alias("doc_id"), F.lit(s).cast("string").alias("source")) for s, n in rows.items()])
    placed = [r.source for r in mixing.mix(docs, weights, block_rows=1).orderBy("mix_position").collect()]
    seen, total = collections.Counter(), sum(weights.values())
    for t, source in enumerate(placed, 1):
        seen[source] += 1
        if seen[source] == rows[source]:
            break
        assert all(abs(seen[s] - t * w / total) < 1 for s, w in weights.items())
    assert t > 8_000 and len(placed) == sum(rows.values())
    with pytest.raises(ValueError, match="weight above 0"):
        mixing.mix(docs, {"a": 1.0, "b": 0.0, None: 1.0})
    with pytest.raises(ValueError, match="too short"):
        mixing.whole_shares(dict.fromkeys("abc", 1.0), 2)


def test_mixing_of_many_sources(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1300).alias("source"))
    rows = mixing.mix(docs, block_rows=1).collect()
    assert sorted(r.mix_position for r in rows) == list(range(4000))


def test_a_trie_spills_its_largest_branches():
    trie = exact.Trie()
    for i in range(300):
        trie.insert(bytes([i % 3]) + bytes([i % 3]) * (i % 3) + i.to_bytes(2, "big"), i, 1)
    whole = sorted(trie.terminals())
    held = trie.held
    out = list(trie.spill(held // 2))
    assert sorted([*out, *trie.terminals()]) == whole and out and trie.held <= held // 2


def test_exact_duplicates_of_a_small_trie(odd, monkeypatch):
    monkeypatch.setattr(exact, "TRIE_BYTES", 2_000)
    monkeypatch.setattr(exact, "combine", functools.partial(exact.combine))
    want = collections.defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        want[(r.text or "").encode().lower()].append(r.doc_id)
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_duplicates(odd).collect())
    assert got == collections.Counter((i, max((x for x in ids if x is not None), default=None), len(ids)) for ids in want.values() for i in ids)


def test_shards_by_an_edited_map(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 90).cast("int")).alias("text"))
    path = f"file://{tmp_path}/map"
    first = {r.doc_id: r for r in shards.shard_documents(docs, shards=8, slots=256, map_path=path).collect()}
    second = {r.doc_id: r for r in shards.shard_documents(docs, shards=9, slots=256, map_path=path, version=0).collect()}
    assert {r.map_version for r in first.values()} == {0} and {r.map_version for r in second.values()} == {1}
    assert all(r.size == 2 * (i % 90) + 8 and r.text_crc32 == zlib.crc32(("é" * (i % 90)).encode()) for i, r in first.items())
    moved = [i for i in first if first[i].shard != second[i].shard]
    assert {second[i].shard for i in moved} == {8} and len(moved) < 3000 / 6
    assert {(r.virtual_slot, r.shard) for r in first.values()} <= {(r.virtual_slot, r.shard) for r in shards.read_map(spark, path, 0).collect()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in result.fetchall())


def test_the_pipeline_as_a_whole(spark):
    """run() against a plain reading of its stages, over all documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    good = {r.doc_id for r in quality.verdicts(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    blanks = " \t\n\x0b\x0c\r"
    owners = collections.defaultdict(set)
    for i, text in texts.items():
        for line in text.split("\n"):
            owners[line.strip(blanks).lower()].add(i)
    shared = {k: max(v) for k, v in owners.items() if len(k) >= 40 and len(v) >= 5}
    texts = {i: "\n".join(x for x in t.split("\n") if shared.get(x.strip(blanks).lower(), i) == i) for i, t in texts.items()}
    sets = {i: frozenset(simhash_wide.shingle_hashes(t.encode()).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    kept = {i: t for i, t in texts.items() if find(i) == i}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert rows.keys() == kept.keys() and shared and len(kept) < len(texts) < len(source)
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())
    assert all(rows[i].ids == library.encode(t, add_special_tokens=False).ids for i, t in kept.items())
    counts = collections.Counter(source[i] for i in kept)
    slots = list(mixing.placed_blocks({s: -(-n // 16) for s, n in counts.items()}, mixing.tempered_weights(counts)))
    order = [source[i] for i, _ in sorted(rows.items(), key=lambda r: r[1].mix_position)]
    assert collections.Counter(order) == counts and len(order) == len(kept)
    assert all(source[i] == slots[r.mix_position // 16] for i, r in rows.items())
