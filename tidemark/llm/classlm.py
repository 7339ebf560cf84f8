"""Class-based n-grams after Brown: P(text) = product of P(class | class before) * P(word | class).

Exchange clustering assigns words to classes in two steps. First the most frequent words, and for all other words their
ending (the last two letters' bytes), are exchanged one at a time: each goes to the class that raises the likelihood of
the bigram counts most. Then every other known word is exchanged by itself: its counts of the classes before and after
it are summed on the cluster, and it goes to the class of the greatest gain against the table of class bigrams, which
has a fixed size. Known are the words from a count on that holds ``KNOWN_WORDS`` of them. A word that is not known has the
class of its ending, and is emitted with its smoothed share of the count that the ending has without the known words.

All counts cover all training documents: tasks add up their own words, bigrams and neighbours, and the sums are
shuffled. Only the units' bigram table (a fixed number of units, by parameter) and the known words (likewise) leave the
cluster; rarer words are looked up by a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, frequent, utf8_list
from tidemark.storage import materialize

UNIT_WORDS = 1000
UNIT_ENDINGS = 400
KNOWN_WORDS = 120_000
KNOWN_WORD_BYTES = 48
CLASSES = 40
NEIGHBOURS = 8_000_000  # neighbours of words that a task holds before it sums them up
SWEEPS = 6
PRIOR = 20.0  # weight of the class frequencies in the class transitions
FLUSH = 300_000
FOLDS, HELD_OUT = 7, 2


def ending(word: bytes) -> bytes:
    return word[-2:]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in utf8_list(batch.column(0)):
                found.update((text or b"").lower().split())
                if len(found) > FLUSH:
                    yield flushed(found)
                    found.clear()
        yield flushed(found)

    def flushed(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Codes(dict):
    """Row of each known word, or -1 - unit of any other one: its ending's."""

    def __init__(self, row: dict[bytes, int], ending_unit: dict[bytes, int], other: int):
        super().__init__(row)
        self.ending_unit, self.other = ending_unit, other

    def __missing__(self, word: bytes) -> int:
        return -1 - self.ending_unit.get(word[-2:], self.other)


class Units:
    """The unit of each known word: frequent words are their own, others share that of their ending."""

    def __init__(self, known: list[tuple[bytes, int]], endings: list[bytes]):
        own = [word for word, _ in known[:UNIT_WORDS]]
        self.own = len(own)
        self.end = len(own)  # the end of a text is a unit of its own
        self.ending_unit = {e: len(own) + 2 + i for i, e in enumerate(endings)}
        self.other = len(own) + 1  # endings too rare for a unit
        self.size = len(own) + 2 + len(endings)
        self.words = [word for word, _ in known]
        self.row_unit = np.array([*range(len(own)), *(self.ending_unit.get(ending(word), self.other) for word, _ in known[len(own) :])], np.int64)
        self.row_count = np.array([n for _, n in known], np.int64)

    def codes(self) -> Codes:
        return Codes({word: i for i, word in enumerate(self.words)}, self.ending_unit, self.other)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The unit of each code."""
        known = self.row_unit[np.maximum(rows, 0)] if len(self.row_unit) else np.zeros(len(rows), np.int64)
        return np.where(rows >= 0, known, -1 - rows)


def codes_of(words: list[bytes], codes: Codes) -> np.ndarray:
    return np.array(list(map(codes.__getitem__, words)), np.int64)


def framed(values: np.ndarray, end: int) -> np.ndarray:
    """The values of a text with its end before and after it."""
    return np.concatenate([[end], values, [end]])


def count_bigrams(docs: DataFrame, units: Units, row_of: np.ndarray, unit_of: np.ndarray) -> np.ndarray:
    """How often each value follows each other one over all texts, given the value of every known word and of every unit.

    A task holds one table of counts; what is shuffled and reaches the driver is at most one row for each of its cells.
    """
    shared = docs.sparkSession.sparkContext.broadcast((units, row_of, unit_of))
    size = int(max(row_of.max(initial=0), unit_of.max(initial=0))) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, row_of, unit_of = shared.value
        codes = units.codes()
        row_of = row_of if len(row_of) else np.zeros(1, np.int64)
        counts = np.zeros(size * size, np.int64)
        for batch in batches:
            pairs, held = [], 0
            for text in utf8_list(batch.column(0)):
                rows = codes_of((text or b"").lower().split(), codes)
                found = framed(np.where(rows >= 0, row_of[np.maximum(rows, 0)], unit_of[np.maximum(-1 - rows, 0)]), unit_of[units.end])
                pairs.append(found[:-1] * size + found[1:])
                held += len(found)
                if held > 2_000_000:
                    counts += np.bincount(np.concatenate(pairs), minlength=len(counts))
                    pairs, held = [], 0
            if pairs:
                counts += np.bincount(np.concatenate(pairs), minlength=len(counts))
        at = np.flatnonzero(counts)
        for first in range(0, len(at), 100_000):
            part = at[first : first + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["pair", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(size, size)


def count_neighbours(docs: DataFrame, units: Units, of: np.ndarray) -> DataFrame:
    """(row, cells, counts): for each known word without a unit of its own, the classes before (cell = class) and after it (class + classes + 1).

    A task sends one row for a word, not one for each of its cells.
    """
    shared = docs.sparkSession.sparkContext.broadcast((units, of))
    width = 2 * (CLASSES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = shared.value
        codes = units.codes()
        found, held = [], 0
        for batch in batches:
            for text in utf8_list(batch.column(0)):
                rows = codes_of((text or b"").lower().split(), codes)
                classes = of[framed(units.of(rows), units.end)]
                at = np.flatnonzero(rows >= units.own)
                base = (rows[at] - units.own) * width
                found += [base + classes[at], base + classes[at + 2] + CLASSES + 1]
                held += 2 * len(at)
                if held > NEIGHBOURS:
                    yield from summed(np.concatenate(found), units.own)
                    found, held = [], 0
        if found:
            yield from summed(np.concatenate(found), units.own)

    def summed(cells: np.ndarray, own: int) -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(cells, return_counts=True)
        rows, starts = np.unique(values // width, return_index=True)
        ends = np.append(starts, len(values))
        for first in range(0, len(rows), 50_000):
            last = min(len(rows), first + 50_000)
            offsets = pa.array(ends[first : last + 1] - ends[first], pa.int32())
            inside = slice(ends[first], ends[last])
            columns = [
                pa.array(rows[first:last] + own, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array((values[inside] % width).astype(np.int16), pa.int16())),
                pa.ListArray.from_arrays(offsets, pa.array(counts[inside].astype(np.int32), pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "cells", "counts"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "row long, cells array<short>, counts array<int>")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(before: np.ndarray, after: np.ndarray, home: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the greatest gain of each word (rows of ``before`` and ``after``: its counts by neighbouring class).

    Every word is judged against the same table, as if only it moved; the end's class takes none. Ties go to its home.
    """
    classes = len(table) - 1
    left, right = table.sum(axis=0), table.sum(axis=1)  # of each class as second and as first
    gains = np.empty((len(home), classes))
    for k in range(classes):
        at_home = (home == k)[:, None]
        row, column = table[k] - at_home * after, table[:, k] - at_home * before
        gain = (xlogx(row + after) - xlogx(row)).sum(axis=1) + (xlogx(column + before) - xlogx(column)).sum(axis=1)
        n_before, n_after = before.sum(axis=1), after.sum(axis=1)
        l, r = left[k] - at_home[:, 0] * n_before, right[k] - at_home[:, 0] * n_after
        gains[:, k] = gain - (xlogx(l + n_before) - xlogx(l)) - (xlogx(r + n_after) - xlogx(r))
    best = gains.argmax(axis=1)
    stay = gains[np.arange(len(home)), best] <= gains[np.arange(len(home)), home] + 1e-9
    return np.where(stay, home, best)


def likelihood(table: np.ndarray) -> float:
    """What the class bigrams add to the log likelihood of the texts."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=0)).sum() - xlogx(table.sum(axis=1)).sum())


def exchanged_words(docs: DataFrame, units: Units, of: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each known word, class bigrams): every known word without a unit of its own is moved once.

    Words are dealt out by row, so a task sums up and moves its own ones; one row for each known word reaches the driver.
    All move against the same table. As that may overshoot, the bigrams are counted anew, and the moves stand only if they
    raise the likelihood.
    """
    home = of[units.row_unit] if len(units.row_unit) else np.zeros(0, np.int64)
    if len(home) <= units.own:
        return home, table
    shared = docs.sparkSession.sparkContext.broadcast((home, table))
    width = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, table = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, cells, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if (own := sums.get(row)) is None:
                    own = sums[row] = np.zeros(2 * width, np.int64)
                own[cells.values.to_numpy()] += counts.values.to_numpy()
        rows = list(sums)
        for first in range(0, len(rows), 2000):
            some = rows[first : first + 2000]
            held = np.stack([sums[r] for r in some]).astype(float)
            best = best_classes(held[:, :width], held[:, width:], home[some], table)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(best, pa.int64())], ["row", "class"])

    found = count_neighbours(docs, units, of).repartition("row").mapInArrow(run, "row long, class long").toArrow()
    moved = home.copy()
    moved[found["row"].to_numpy()] = found["class"].to_numpy()
    after = count_bigrams(docs, units, moved, of)
    return (moved, after) if likelihood(after) > likelihood(table) else (home, table)


def exchange(bigrams: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. ``bigrams[i, j]`` counts j after i; unit ``fixed`` keeps the last class for itself.

    Starts with units dealt to classes in order of frequency. The gain of a move is exact, for sum of n log n over
    class bigrams minus that over the class counts on both sides. Ties go to the lowest class; ends early when a
    sweep moves nothing.
    """
    size = len(bigrams)
    left, right = bigrams.sum(axis=0), bigrams.sum(axis=1)
    order = [u for u in np.argsort(-(left + right), kind="stable").tolist() if u != fixed]
    of = np.zeros(size, np.int64)
    of[order] = np.arange(len(order)) % classes
    of[fixed] = classes
    member = np.zeros((size, classes + 1))
    member[np.arange(size), of] = 1
    after, before = bigrams @ member, bigrams.T @ member  # unit x class: what follows and what precedes it
    table = member.T @ after
    before_class, after_class = table.sum(axis=0), table.sum(axis=1)

    f = xlogx
    for _ in range(sweeps):
        moves = 0
        for u in order:
            home = of[u]
            own = bigrams[u, u]
            out, into = after[u].copy(), before[u].copy()
            out[home] -= own
            into[home] -= own
            base = table.copy()  # without u
            base[home] -= out
            base[:, home] -= into
            base[home, home] -= own
            rows, columns = base[:classes], base[:, :classes].T
            gain = (f(rows + out) - f(rows)).sum(axis=1) + (f(columns + into) - f(columns)).sum(axis=1)
            diagonal = np.arange(classes)
            d = base[diagonal, diagonal]
            gain += f(d + out[:classes] + into[:classes] + own) - f(d + out[:classes]) - f(d + into[:classes]) + f(d)
            counts_left, counts_right = before_class[:classes].copy(), after_class[:classes].copy()
            counts_left[home] -= left[u]
            counts_right[home] -= right[u]
            gain -= f(counts_left + left[u]) - f(counts_left) + f(counts_right + right[u]) - f(counts_right)
            best = int(np.argmax(gain))
            if best == home or gain[best] <= gain[home] + 1e-9:
                continue
            table = base
            table[best] += out
            table[:, best] += into
            table[best, best] += own
            for total, part in ((before_class, left[u]), (after_class, right[u])):
                total[home] -= part
                total[best] += part
            after[:, home] -= bigrams[:, u]
            after[:, best] += bigrams[:, u]
            before[:, home] -= bigrams[u]
            before[:, best] += bigrams[u]
            of[u] = best
            moves += 1
        if not moves:
            break
    return of


class Model:
    """Log10 class transitions and emissions: of known words, of the end, and of what is left of each ending."""

    def __init__(self, units: Units, of: np.ndarray, row_class: np.ndarray, table: np.ndarray, rest_words: np.ndarray, rest_types: np.ndarray, texts: int):
        self.units, self.row_class, self.texts = units, row_class, texts
        self.of = of.copy()
        self.of[: units.own] = row_class[: units.own]
        share = (table.sum(axis=0) + 1) / (table.sum() + CLASSES + 1)
        self.transition = np.log10((table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR))
        shared = np.arange(units.size) > units.end
        mass = np.where(shared, rest_words, 0.0) + 0.5  # half a count: what training lacks still has some probability
        mass[units.end] = texts + 0.5
        of_class = np.bincount(row_class, units.row_count + 0.5, minlength=CLASSES + 1) + np.bincount(self.of[units.own :], mass[units.own :], minlength=CLASSES + 1)
        self.row_emission = np.log10((units.row_count + 0.5) / of_class[row_class])
        self.unit_emission = np.log10(mass / of_class[self.of])
        # a word of an ending's rest: (count + 1) / (words of the rest + distinct ones + 1 for all unseen)
        self.share_log = np.where(shared, np.log10(np.maximum(rest_words + rest_types, 0) + 1), 0.0)
        self.train_tokens = int(units.row_count.sum() + rest_words.sum()) + texts
        self.types = len(units.row_count) + int(rest_types.sum()) + (texts > 0)
        self.row_log = np.log10(units.row_count + 1)

    def score(self, words: list[bytes], codes: Codes) -> tuple[float, float, int, Counter]:
        """(score, base score) without the counts of rare words, known tokens so far, the rare words."""
        rows = codes_of(words, codes)
        known = rows >= 0
        at, rest = rows[known], -1 - rows[~known]
        classes = np.empty(len(rows), np.int64)
        classes[known], classes[~known] = self.row_class[at], self.of[rest]
        path = framed(classes, self.of[self.units.end])
        score = self.transition[path[:-1], path[1:]].sum() + self.row_emission[at].sum() + (self.unit_emission[rest] - self.share_log[rest]).sum() + self.unit_emission[self.units.end]
        base = self.row_log[at].sum() + math.log10(self.texts + 1) - (len(words) + 1) * math.log10(self.train_tokens + self.types + 1)
        rare = Counter([words[i] for i in np.flatnonzero(~known).tolist()])
        return float(score), float(base), len(at) + (self.texts > 0), rare


def fit(training: DataFrame, counts: DataFrame) -> Model:
    """A model from training texts and their word counts (word, n)."""
    short = counts.filter(F.octet_length("word") <= KNOWN_WORD_BYTES)
    known = sorted(((bytes(r[0]), r[1]) for r in frequent(short, KNOWN_WORDS).collect()), key=lambda x: (-x[1], x[0]))
    tail = F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")
    by_ending = counts.groupBy(tail.alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    top = [(bytes(r[0]), r[1], r[2]) for r in by_ending.orderBy(F.desc("n"), "ending").limit(UNIT_ENDINGS).collect()]
    rest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    units = Units(known, [e for e, _, _ in top])
    n, types = np.zeros(units.size), np.zeros(units.size)
    for e, count, distinct in top:
        n[units.ending_unit[e]], types[units.ending_unit[e]] = count, distinct
    n[units.other], types[units.other] = rest[0] - n.sum(), rest[1] - types.sum()
    for word, count in known:  # these words are not emitted through their ending
        u = units.ending_unit.get(ending(word), units.other)
        n[u] -= count
        types[u] -= 1
    bigrams = count_bigrams(training, units, units.row_unit, np.arange(units.size))
    of = exchange(bigrams, units.end)
    member = np.zeros((units.size, CLASSES + 1))
    member[np.arange(units.size), of] = 1
    row_class, table = exchanged_words(training, units, of, member.T @ bigrams @ member)
    return Model(units, of, row_class, table, n, types, training.count())


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on the documents whose fold of 7 is not 2, and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (class-based
    bigrams), both log10 probabilities of the whole text. A null text is empty and scores its end alone; a null
    doc_id has the fold of empty text; repeated rows each give a row; without training texts all words are unseen.
    Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    training = docs.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = materialize(count_words(training), "word-counts")
    model = fit(training, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = model.units.codes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1)), strict=True):
                words = (text or b"").lower().split()
                score, base, known, rare = model.score(words, codes)
                key = xxhash.xxh64_intdigest(text or b"") >> 1
                rows.append((doc_id, key, None, 1, len(words) + 1, known, base, score))
                rows += [(doc_id, key, word, n, 0, 0, 0.0, 0.0) for word, n in rare.items()]
                if len(rows) > 100_000:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows)

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "key", "word", "n", "n_tokens", "n_known", "base", "score"]

    def record_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = materialize(docs.mapInArrow(run, "doc_id long, key long, word binary, n long, n_tokens long, n_known long, base double, score double"), "text-scores")
    looked_up = parts.filter(F.col("word").isNotNull()).join(counts.withColumnRenamed("n", "c"), "word", "left")
    gain = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    rare = looked_up.select("doc_id", "key", F.lit(0).cast("long").alias("n"), "n_tokens", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"), gain.alias("base"), gain.alias("score"))
    whole = parts.filter(F.col("word").isNull()).drop("word").unionByName(rare).groupBy("doc_id", "key")
    copies = whole.agg(F.sum("n").alias("copies"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    one = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))  # rows that repeat an id and a text
    per = {c: F.col(c) / F.col("copies") for c in ("n_tokens", "n_known", "base", "score")}
    return one.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), per["n_tokens"].cast("long").alias("n_tokens"), per["n_known"].cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), per["base"].alias("base_score"), per["score"].alias("score"),
    )
