"""Language identification: known words first, shorter and shorter character n-grams for unseen words.

A word that the training rows hold scores by its log frequency in each language. An unseen word backs off to its
character n-grams: the longest order with a known n-gram scores it, at a discount for each step down.

Every word and n-gram of the training rows counts. The scores of all words are one table on the cluster, made by
joins. A fixed number of the most frequent words goes to all tasks beside it, which is where most of a text is looked
up; each other word of a text meets the table in a join. Either way a word has the same score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, frequent, utf8_list
from tidemark.storage import materialize

ORDERS = (4, 3, 2, 1)
BACKOFF = math.log10(0.4)
HEAD_WORDS = 400_000  # words that every task holds; all others are looked up by a join
HEAD_BYTES = 64  # so are words longer than that
BROADCAST_GRAMS = 400_000  # n-grams that may go to all tasks; more of them meet the unseen words in a join
FLUSH = 400_000
CACHE_TOKENS = 500_000
BATCH_ROWS = 100_000
UNKNOWN = "und"
SPREAD = 4.0  # evidence in log10 units that makes a prediction nearly certain

ENDS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
NOT_ASCII_LETTERS = bytes(b for b in range(256) if b > 127 or not chr(b).isalpha())


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without ASCII punctuation and digits at their ends."""
    return [w for w in (x.strip(ENDS) for x in (text or b"").lower().split()) if w]


def grams(word: str, order: int) -> list[str]:
    framed = f"_{word}_"
    return [framed[i : i + order] for i in range(len(framed) - order + 1)]


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return text.translate(None, NOT_ASCII_LETTERS) != b"" or any(c.isalpha() for c in text.decode(errors="replace"))


def each(languages: list[str], make) -> Column:
    """An array with ``make(i)`` for each language."""
    return F.array(*[make(i) for i in range(len(languages))])


def count_words(rows: DataFrame, languages: list[str]) -> DataFrame:
    """(word, n, seen) over all rows of (text, lang): how often in all, and in each language; each task adds up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(utf8_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[lang].update((text or b"").lower().split())
            if sum(map(len, counts.values())) > FLUSH:
                yield flushed(counts)
                counts.clear()
        yield flushed(counts)

    def flushed(counts: dict[str | None, Counter]) -> pa.RecordBatch:
        langs, words, ns = [], [], []
        for lang, tokens in counts.items():
            found: Counter = Counter()
            for token, n in tokens.items():
                found[token.strip(ENDS)] += n
            found.pop(b"", None)
            langs += [lang] * len(found)
            words += found.keys()
            ns += found.values()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "n"])

    counted = rows.mapInArrow(run, "lang string, word string, n long")
    seen = each(languages, lambda i: F.sum(F.when(F.col("lang") == languages[i], F.col("n")).otherwise(0)))
    return counted.groupBy("word").agg(F.sum("n").alias("n"), seen.alias("seen"))


def count_grams(words: DataFrame, languages: list[str]) -> DataFrame:
    """(order, gram, seen): in how many places of each language's distinct framed words each n-gram stands.

    Unseen words are new words, so distinct words, not running text, are what their n-grams are like.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = defaultdict(Counter)
        for batch in batches:
            for word, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = [gram for order in ORDERS for gram in grams(word, order)]
                for i, n in enumerate(seen):
                    if n:
                        found[i].update(pieces)
                if sum(map(len, found.values())) > FLUSH:
                    yield flushed(found)
                    found.clear()
        yield flushed(found)

    def flushed(found: dict[int, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in found.items() for _ in c]
        texts = [gram for c in found.values() for gram in c]
        ns = [n for c in found.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.int32()), pa.array(texts, pa.string()), pa.array(ns, pa.int64())], ["lang", "gram", "n"])

    counted = words.select("word", "seen").mapInArrow(run, "lang int, gram string, n long")
    seen = each(languages, lambda i: F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)))
    return counted.groupBy("gram").agg(seen.alias("seen")).withColumn("order", F.length("gram"))


def totals(counted: DataFrame, languages: list[str]) -> list:
    """Sums over ``seen`` by language, and the number of rows."""
    return [F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)).alias(f"n_{i}") for i in range(len(languages))] + [F.count("*").alias("kinds")]


def smoothed(total, languages: list[str], discount: float = 0.0) -> Column:
    """log10 of the add-one share of each count in ``seen``."""
    return each(languages, lambda i: F.log10(F.col("seen")[i] + 1) - F.lit(math.log10(total[f"n_{i}"] + total["kinds"] + 1) - discount))


def backed_off(words: DataFrame, found: DataFrame, languages: list[str]) -> DataFrame:
    """(word, logs) of unseen words by the longest order with a known n-gram; words without any are left out."""
    by_order = {r["order"]: r for r in found.groupBy("order").agg(*totals(found, languages)).collect()}
    scored, left, few = None, words.select("word", "n"), sum(r["kinds"] for r in by_order.values()) <= BROADCAST_GRAMS
    framed = F.concat(F.lit("_"), "word", F.lit("_"))
    for step, order in enumerate(ORDERS, 1):
        if order not in by_order:
            continue
        starts = F.when(F.length(framed) >= order, F.sequence(F.lit(1), F.length(framed) - order + 1)).otherwise(F.array().cast("array<int>"))
        pieces = left.select("word", "n", F.explode(F.transform(starts, lambda i: F.substr(framed, i, F.lit(order)))).alias("gram"))
        logs = found.filter(F.col("order") == order).select("gram", smoothed(by_order[order], languages, step * BACKOFF).alias("g"))
        logs = F.broadcast(logs) if few else logs
        means = each(languages, lambda i: F.avg(F.col("g")[i]))
        done = materialize(pieces.join(logs, "gram").groupBy("word").agg(F.first("n").alias("n"), means.alias("logs")), "language-unseen")
        scored = done if scored is None else scored.unionByName(done)
        left = left.join(done, "word", "left_anti")
    return scored


@dataclass
class Model:
    """Languages, the scores (word, n, logs) of all words, and the most frequent of them for every task."""

    languages: list[str]
    scores: DataFrame | None = None
    head: bytes = b""  # words, each ended by a line feed
    head_logs: np.ndarray | None = None  # 32-bit, as in the scores


def fit(rows: DataFrame, head_words: int = HEAD_WORDS) -> Model:
    """A model from rows (text, lang): those with a language train it, the words of all others get a score too.

    Only the languages, sums over them and the head leave the cluster.
    """
    languages = [r[0] for r in rows.filter(F.col("lang").isNotNull()).select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([])
    counts = materialize(count_words(rows, languages), "language-words")
    known = F.exists("seen", lambda n: n > 0)
    total = counts.filter(known).agg(*totals(counts, languages)).first()
    spoken = [i for i in range(len(languages)) if total[f"n_{i}"]]
    if not spoken:
        return Model([])
    found = materialize(count_grams(counts.filter(known), languages), "language-grams")
    scored = counts.filter(known).select("word", "n", smoothed(total, languages).alias("logs"))
    scored = scored.unionByName(backed_off(counts.filter(~known), found, languages))
    scored = materialize(scored.select("word", "n", F.array(*[F.col("logs")[i] for i in spoken]).cast("array<float>").alias("logs")), "language-scores")
    head = frequent(scored.filter(F.octet_length("word") <= HEAD_BYTES), head_words).select("word", "logs").toArrow()
    logs = head["logs"].combine_chunks().flatten().to_numpy().reshape(-1, len(spoken))
    return Model([languages[i] for i in spoken], scored, b"".join(w + b"\n" for w in utf8_list(head["word"].combine_chunks())), logs)


class Lookup:
    """Rows of the head by raw token: at least 0 a head word, -1 no word, else the word of ``rare`` at -2 minus it."""

    def __init__(self, head: bytes):
        self.row = {word: i for i, word in enumerate(head.split(b"\n")[:-1])}
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[bytes, int] = {}
        self.rare: list[bytes] = []

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.tokens) > CACHE_TOKENS:
            self.clear()
        find = self.tokens.get
        found = [find(t) for t in tokens]
        if None in found:
            for at, code in enumerate(found):
                if code is None:
                    found[at] = self.learn(tokens[at])
        return np.array(found, np.int64)

    def learn(self, token: bytes) -> int:
        word = token.strip(ENDS)
        code = self.row.get(word, -1) if word else -1
        if word and code < 0:
            self.rare.append(word)
            code = -1 - len(self.rare)
        self.tokens[token] = code
        return code


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the best language of the whole text and its share of the belief, 0 to 1.

    ``und`` with score 0 where the text is null or has no letter, or the model knows no language. Only the text is
    read. Ties go to the first language in binary order. A word that the model's scores lack counts for nothing.
    """
    languages = model.languages
    if not languages:
        return docs.select(id_column, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.head_logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, logs = Lookup(shared.value[0]), shared.value[1].astype(np.float64)
        for batch in batches:
            source, keys, words, ns, copies, letters, bases = [], [], [], [], [], [], []
            for at, text in enumerate(utf8_list(batch.column(1))):
                key = xxhash.xxh64_intdigest(text or b"") >> 1
                spoken = has_letter(text)
                base = None
                if spoken:
                    counts = Counter(text.lower().split())
                    rows = lookup.rows(list(counts))
                    times = np.fromiter(counts.values(), np.float64, len(counts))
                    held = rows >= 0
                    base = times[held] @ logs[rows[held]]
                    rare = np.flatnonzero(rows < -1)
                    source += [at] * len(rare)
                    keys += [key] * len(rare)
                    words += [lookup.rare[i] for i in (-2 - rows[rare]).tolist()]
                    ns += times[rare].astype(np.int64).tolist()
                    copies += [0] * len(rare)
                    letters += [True] * len(rare)
                    bases += [None] * len(rare)
                source.append(at)
                keys.append(key)
                words.append(b" %x" % key)  # no word holds a space: such a row meets none in the join
                ns.append(0)
                copies.append(1)
                letters.append(spoken)
                bases.append(base)
                if len(source) > BATCH_ROWS:
                    yield record_batch(batch, source, keys, words, ns, copies, letters, bases)
                    source, keys, words, ns, copies, letters, bases = [], [], [], [], [], [], []
            if source:
                yield record_batch(batch, source, keys, words, ns, copies, letters, bases)

    def record_batch(batch: pa.RecordBatch, source: list, keys: list, words: list, ns: list, copies: list, letters: list, bases: list) -> pa.RecordBatch:
        columns = [
            batch.column(0).take(pa.array(source, pa.int64())), pa.array(keys, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64()),
            pa.array(copies, pa.int32()), pa.array(letters, pa.bool_()), pa.array(bases, pa.list_(pa.float64())),
        ]
        return pa.RecordBatch.from_arrays(columns, [id_column, "key", "word", "times", "copies", "letters", "base"])

    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, key long, word string, times long, copies int, letters boolean, base array<double>"
    parts = docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, schema)
    met = parts.join(model.scores.select("word", "logs"), "word", "left")
    evidence = each(languages, lambda i: F.sum(F.coalesce(F.col("base")[i], F.lit(0.0)) + F.coalesce(F.col("times") * F.col("logs")[i], F.lit(0.0))))
    whole = met.groupBy(id_column, "key").agg(F.sum("copies").alias("copies"), F.bool_or("letters").alias("letters"), evidence.alias("evidence"))
    mean = whole.withColumn("evidence", F.transform("evidence", lambda x: x / F.col("copies")))  # rows that repeat an id and a text
    best = F.array_max("evidence")
    belief = F.aggregate("evidence", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), F.greatest((x - best) / SPREAD, F.lit(-300.0))))
    name = F.get(F.array(*map(F.lit, languages)), (F.array_position("evidence", best) - 1).cast("int"))
    one = mean.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select(id_column, F.when(F.col("letters"), name).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), 1 / belief).otherwise(0.0).alias("score"))


def held_out_languages(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """Fit on rows with a language whose fold of 3 is not 1; predict every row.

    Null texts and texts without letters are ``und``; a null doc_id has a fold like any other; without a training
    row every prediction is ``und``. Columns other than doc_id, text and lang are not read.
    """
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = fit(docs.select(F.col("text").cast("string"), F.when(~held_out, F.col("lang")).alias("lang")), head_words)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
