"""Periodic runs of words through a dictionary of basic factors.

A basic factor is a stretch of 1, 2, 4, ... words. At each length L equal factors get one name, made of the names of
their two halves, and every position looks at the next occurrence of its own factor. Where that successor is at most L
words away, occurrences overlap, and while the distance stays the same from one position to the next they form
arithmetic progressions whose difference is a period: a stretch of consecutive positions with one distance d is
extended by itself to the whole run, from its first position to L + d words after its last.

Why each run appears once, in full and under its smallest period q: let L be the least power of two not below q. A
factor of L words inside the run contains a whole period, which is primitive, so it recurs after exactly q words, and
every position of the run that has room for it says so; a longer stretch of that distance would lengthen the run, and
a smaller period would have shown as a smaller distance. Distances up to L / 2 have been seen a level before, those
between L and 2 L are proposals that the next level, whose factors hold a whole period, confirms.

Positions without an occurrence of their factor near enough for a run that fits the text, before or after, are left
out of longer factors. In ordinary text hardly any remain after two or three levels.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import utf8_list

MIN_WORDS = 6
MIN_EXPONENT = 4
BLOCK_WORDS = 300_000


def successors(names: np.ndarray, order: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance to the next and from the previous occurrence of each name (0: none), and the names numbered densely.

    ``order`` sorts by (name, place).
    """
    ranked = names[order]
    again = ranked[1:] == ranked[:-1]
    gaps = np.where(again, np.diff(places[order]), 0)
    after, before, dense = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    after[order[:-1]] = gaps
    before[order[1:]] = gaps
    dense[order[1:]] = np.cumsum(~again)
    return after, before, dense


def find_runs(names: np.ndarray, longest: np.ndarray, min_words: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in a row of words given as names.

    Words of unlike texts have unlike names, so no factor that reaches into another text ever recurs. ``longest`` has, for
    each word, the greatest period that its text has room for.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    places = np.flatnonzero(longest > 0)
    names, longest, length = names[places], longest[places], 1
    order = np.sort(names * len(names) + np.arange(len(names))) % max(1, len(names))
    while len(places):
        after, before, names = successors(names, order, places)
        own = np.flatnonzero((2 * after > length) & (after <= length))
        if len(own):
            at, period = places[own], after[own]
            first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(period) != 0)])
            positions = np.diff(np.r_[first, len(own)])
            start, period = at[first], period[first]
            size = positions - 1 + length + period
            long = size >= np.maximum(min_words, min_exponent * period)
            found.append((start[long], size[long], period[long]))
        near = ((after > 0) & (after <= longest)) | ((before > 0) & (before <= longest))
        stay = np.flatnonzero(near & (longest > length))
        places, names, longest, distinct = places[stay], names[stay], longest[stay], len(names) + 1
        half = np.minimum(np.searchsorted(places, places + length), max(0, len(places) - 1))
        whole = np.flatnonzero(places[half] == places + length)
        names = names[whole] * distinct + names[half[whole]]
        places, longest, length = places[whole], longest[whole], 2 * length
        order = np.argsort(names, kind="stable")
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def block_runs(texts: list[list[bytes]], min_words: int, min_exponent: int) -> list[np.ndarray]:
    """For each text, an array of (start, length, period), sorted by start and period."""
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = np.fromiter((number[w] for text in texts for w in text), np.int64, int(sizes.sum()))
    room = np.where(sizes >= min_words, sizes // min_exponent, 0)
    start, length, period = find_runs(owner * len(number) + words, room[owner], min_words, min_exponent)
    order = np.lexsort((period, start))
    runs = np.stack([start, length, period], 1)[order]
    cuts = np.searchsorted(runs[:, 0], ends)
    return [runs[a:b] - [end - size, 0, 0] for a, b, end, size in zip(np.r_[0, cuts[:-1]], cuts, ends, sizes, strict=True)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(w for w, inside in zip(words, np.cumsum(edges).tolist(), strict=False) if not inside)


def blocks(texts: list[bytes | None], most: int) -> Iterator[list[list[bytes]]]:
    """The words of texts in groups of about ``most`` words; a longer text is a group of its own."""
    held: list[list[bytes]] = []
    n = 0
    for text in texts:
        words = (text or b"").split()
        if held and n + len(words) > most:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT, id_column: str = "doc_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, runs, collapsed_text) of every row.

    ``runs``: array of (start, length, period), by start and period: maximal stretches of words with smallest period q and at least
    max(``min_words``, ``min_exponent`` * q) words; words are separated by ASCII white space and numbered from 0. ``collapsed_text`` leaves
    of each run its first period. ``min_exponent`` is 3 or more. Null and empty texts have no runs and an empty
    ``collapsed_text``; a text of any length is looked at whole, by one task. Repeated rows and null ids each give their own row; an empty table gives an
    empty result; other columns are not read. Nothing is shuffled.
    """
    if min_exponent < 3:
        raise ValueError("a factor holds up to two periods, and a run has to be longer than that")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for group in blocks(utf8_list(batch.column(1)), block_words):
                found = block_runs(group, min_words, min_exponent)
                flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
                fields = [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)]
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                kept = pa.array([collapse(words, r) for words, r in zip(group, found, strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), runs, kept], [id_column, "runs", "collapsed_text"])
                done += len(group)

    id_type = docs.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {id_type}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string"
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, out)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones the first by start and period. Null without runs."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def run_lines(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line end."""
    whole = [part for field in ("start", "length", "period") for part in (field, "," if field != "period" else "\n")]
    return F.array_join(F.transform(runs, lambda r: F.concat(*[r[p] if p.isalpha() else F.lit(p) for p in whole])), "")
