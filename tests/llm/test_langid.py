"""Language identification against a plain reading of its definition."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid

SCHEMA = "doc_id long, text string, lang string, word string, score string, base string, copies string"


def brute(rows):
    """{row number: (lang_pred, score)} of (doc_id, text, lang) rows, word by word."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i, _, _ in rows]
    seen = defaultdict(Counter)
    for (_, text, lang), out in zip(rows, held, strict=True):
        if not out and lang is not None:
            seen[lang].update(w.decode() for w in langid.words_of((text or "").encode()))
    languages = sorted(x for x in seen if seen[x])
    vocabulary = {w for x in languages for w in seen[x]}
    grams = {o: {x: Counter(g for w in seen[x] for g in langid.grams(w, o)) for x in languages} for o in langid.ORDERS}
    kinds = {o: {g for c in grams[o].values() for g in c} for o in langid.ORDERS}

    def logs(word, lang):
        if word in vocabulary:
            return math.log10(seen[lang][word] + 1) - math.log10(seen[lang].total() + len(vocabulary) + 1)
        for step, o in enumerate(langid.ORDERS, 1):
            known = [g for g in langid.grams(word, o) if g in kinds[o]]
            if known:
                return sum(math.log10(grams[o][lang][g] + 1) - math.log10(grams[o][lang].total() + len(kinds[o]) + 1) for g in known) / len(known) + step * langid.BACKOFF
        return 0.0

    found = []
    for _, text, _ in rows:
        if not languages or not any(c.isalpha() for c in text or ""):
            found.append(("und", 0.0))
            continue
        total = [sum(logs(w.decode(), x) for w in langid.words_of(text.encode())) for x in languages]
        belief = [10 ** max((t - max(total)) / langid.SPREAD, -300) for t in total]
        found.append((languages[total.index(max(total))], max(belief) / sum(belief)))
    return found


def invented(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) + rng.choice(["", ",", ".", "!9"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    spoken = {"aa": "abcdeé", "bb": "cdefgh", "cc": "あいうeba", "dd": "xyz"}
    made = [(i, invented(rng, spoken[x], rng.randrange(1, 30)), None if rng.random() < 0.2 else x) for i in range(240) for x in [rng.choice(["aa", "bb", "cc"])]]
    made += [(900 + i, t, x) for i, (t, x) in enumerate([(None, "aa"), ("", "bb"), ("12 ,. !", "aa"), ("longword" * 400 + " a b", "aa"), (None, "ee"), ("zzz qqq", None), ("Ωmega", None)])]
    return made + [(None, "abc abc", None), (5, "Abc!", None), (5, "Abc!", None), (5, "other", None)]


@pytest.mark.parametrize("head", [0, 30, 10_000])
def test_scores_are_those_of_brute_force_at_any_size_of_the_head(spark, rows, head):
    docs = spark.createDataFrame([(*r, "x", "y", "z", "t") for r in rows], SCHEMA).repartition(3)
    got = sorted(langid.held_out_languages(docs, head).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.lang_pred, r.score))
    want = sorted(((i, *b) for (i, _, _), b in zip(rows, brute(rows), strict=True)), key=lambda r: (r[0] is None, r[0], r[1], r[2]))
    assert [(r.doc_id, r.lang_pred) for r in got] == [w[:2] for w in want]
    assert all(abs(r.score - w[2]) < 1e-4 for r, w in zip(got, want, strict=True))
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)


def test_without_training_rows_all_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.held_out_languages(docs).collect()} == {("und", 0.0)}
    assert langid.held_out_languages(docs.filter(F.lit(False))).collect() == []
