"""Periodic runs against a plain reading of their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(words, min_words=6, min_exponent=4):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(min_words, min_exponent * q):
                found.setdefault((i, size), q)  # the smallest period comes first
            i = max(i, j) + 1
    return sorted((start, size, q) for (start, size), q in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), max_size=6), st.sampled_from([3, 4]), st.sampled_from([1, 6, 9]))
def test_block_against_definition(texts, exponent, least):
    texts = [[w.encode() for w in t] for t in texts]
    got = periodic.block_runs(texts, least, exponent) if texts else []
    for words, runs in zip(texts, got, strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words, max(least, exponent), exponent)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)), min_size=1, max_size=5))
def test_nested_and_neighbouring_runs(parts):
    words = [c.encode() for root, times, more in parts for c in root * times + root[:more]]
    got = [tuple(r) for r in periodic.block_runs([words, words[::-1]], 6, 4)[0].tolist()]
    assert got == plain_runs(words)


def odd_rows():
    rng = random.Random(5)
    prose = " ".join(f"w{rng.randrange(300)}" for _ in range(500))
    texts = [None, "", " \n ", "x" * 300_000, "again " * 50_000, "a b c " * 7 + prose + " d" * 6 + " d e" * 4, "a b c d " * 5, prose, "a a a a a", "a a a a a a"]
    return [(None if i == 7 else i, t, "clash", 3) for i, t in enumerate(texts)] + [(5, texts[5], "clash", 3)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, runs string, period int").repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id or 0), [tuple(x) for x in r.runs], r.collapsed_text) for r in periodic.periodic_runs(docs, block_words=400).collect())
    want = []
    for doc_id, text, *_ in odd_rows():
        words = [w.decode() for w in (text or "").encode().split()]
        runs = [(0, 50_000, 1)] if len(words) == 50_000 else plain_runs(words)
        want.append(((doc_id is None, doc_id or 0), runs, plain_collapse(words, runs)))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, min_exponent=2)


def test_query_against_plain_reading(spark):
    got = {r.doc_id: r for r in queries.op12_periodic(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 4000:
            continue  # the plain reading is quadratic
        runs, r = plain_runs(words), got[doc_id]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert planted > 5 and sum(r.n_runs for r in got.values()) > 5
