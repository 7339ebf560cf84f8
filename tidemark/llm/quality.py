"""Quality rules with thresholds that adapt to each language and source.

Every metric of a document is an integer. A quantile sketch of a group is a histogram over buckets that keep the
six leading bits of a value, so any quantile is known within 1/32 of itself; sketches merge by adding counts, in any
order, and give the same result. Thresholds come from the sketch of (language, source), or of the language or of
all documents where a group is too small, and are joined back to the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import unused, utf8_list
from tidemark.storage import materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP = 100
SPREAD = 6
#: metric -> (numerator, denominator, scale, least distance of the threshold from the median)
METRICS = {
    "symbols": ("n_symbols", "word_chars", 10_000, 500),
    "marks": ("n_marks", "word_chars", 10_000, 500),
    "capitals": ("n_capitals", "word_chars", 10_000, 3_000),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 5_000),
    "repeats": ("n_repeat_words", "n_words", 10_000, 4_000),
    "word_length": ("word_chars", "n_words", 100, 400),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals"]
BROADCAST_ROWS = 200_000

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The counts named in COUNTS, over the whole text."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]

    def n(kinds: bytes) -> int:
        return len(text) - len(text.translate(None, kinds))

    return (len(words), len(text.translate(None, BLANKS + CONTINUATION)), n(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), n(b"!?"), n(CAPITALS))


def measure(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_quality`` of counts (replacing one of that name)."""
    docs = docs.drop("_quality")
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts_of(text) for text in utf8_list(batch.column(at))]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, COUNTS)], [*batch.schema.names, "_quality"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_quality", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    return docs.mapInArrow(run, schema)


def base_failed():
    q = F.col("_quality")
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def metric_value(metric: str):
    numerator, denominator, scale, _ = METRICS[metric]
    q = F.col("_quality")
    return F.floor(scale * q[numerator] / F.greatest(q[denominator], F.lit(1))).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over the documents that pass the base rules; ``bucket`` is its least value."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), metric_value(m).alias("x")) for m in METRICS])
    each = measured.filter(~base_failed()).select("lang", "source", F.explode(values).alias("v")).select("lang", "source", "v.*")
    shift = "CAST(greatest(length(bin(x)) - 6, 0) AS INT)"
    return each.withColumn("bucket", F.expr(f"shiftleft(shiftright(x, {shift}), {shift})")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def thresholds_of(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, docs, one threshold for each metric) from sketches merged to ``keys``."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    median = F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("bucket")))
    quarter = F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket")))
    by_metric = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("docs"), median.alias("q50"), quarter.alias("q75"))
    slack = F.create_map(*[F.lit(x) for m, spec in METRICS.items() for x in (m, spec[3])])[F.col("metric")]
    limits = by_metric.withColumn("limit", F.col("q50") + F.greatest(slack, SPREAD * (F.col("q75") - F.col("q50"))))
    return limits.groupBy(*keys).agg(F.max("docs").alias("docs"), *[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"max_{m}") for m in METRICS])


def adaptive_thresholds(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row (lang, source, max_<metric>...) for each pair of values that a passing document has, nulls included."""
    sketch = materialize(sketches(measured), "quality-sketches")
    limits = [f"max_{m}" for m in METRICS]
    pairs = thresholds_of(sketch, ["lang", "source"])
    langs = thresholds_of(sketch, ["lang"]).select(F.col("lang").alias("lang_2"), F.col("docs").alias("lang_docs"), *[F.col(m).alias(f"lang_{m}") for m in limits])
    everything = thresholds_of(sketch, []).select(*limits).first()  # one row of six numbers
    joined = pairs.join(langs, F.col("lang").eqNullSafe(F.col("lang_2")))
    whole = {m: everything[m] if everything else None for m in limits}
    chosen = [F.when(F.col("docs") >= min_group, F.col(m)).when(F.col("lang_docs") >= min_group, F.col(f"lang_{m}")).otherwise(F.lit(whole[m]).cast("long")).alias(m) for m in limits]
    return materialize(joined.select("lang", "source", *chosen), "quality-thresholds")


def judge(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``measured`` with ``_base_failed`` and ``_kept``: below every threshold of its language and source.

    The thresholds are broadcast only if their counted rows are few; otherwise both sides meet by key. Columns of those
    two names are replaced; others may have any names.
    """
    lang, source, *most = unused(measured, 2 + len(METRICS))
    limits = thresholds.select(F.col("lang").alias(lang), F.col("source").alias(source), *[F.col(f"max_{m}").alias(x) for m, x in zip(METRICS, most, strict=True)])
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, measured["lang"].eqNullSafe(F.col(lang)) & measured["source"].eqNullSafe(F.col(source)), "left")
    inside = F.lit(True)
    for m, x in zip(METRICS, most, strict=True):
        inside &= F.coalesce(metric_value(m) <= F.col(x), F.lit(True))
    judged = joined.withColumns({"_base_failed": base_failed(), "_kept": ~base_failed() & inside})
    return judged.drop(lang, source, *most)


def verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every row.

    A null text has no words and fails the base rules, like an empty one; a null language or source is a value of
    its own; repeated rows are judged alike; an empty table gives an empty result. A language and source with fewer
    than ``MIN_GROUP`` passing documents takes the thresholds of its language, or of all documents where that has few
    too. Texts are read once and do not cross the network.
    """
    measured = materialize(measure(docs.select(id_column, "lang", "source", text_column), text_column).drop(text_column), "quality-counts")
    judged = judge(measured, adaptive_thresholds(measured))
    return judged.select(id_column, *[F.col("_quality")[c].alias(c) for c in COUNTS[:5]], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: thresholds in one pass, the joined filter in another.

    Nulls, repeats and empty tables are as for ``verdicts``; columns of ``docs`` may have any names.
    """
    narrow = measure(docs.select("lang", "source", text_column), text_column).drop(text_column)
    thresholds = adaptive_thresholds(narrow)
    read = {"lang", "source", text_column}
    plain = {c: c if c in read else f"c{i}" for i, c in enumerate(docs.columns)}
    judged = judge(measure(docs.select(*[docs[c].alias(x) for c, x in plain.items()]), text_column), thresholds)
    return judged.filter("_kept").select(*[F.col(x).alias(c) for c, x in plain.items()])
