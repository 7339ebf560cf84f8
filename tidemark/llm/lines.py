"""Line deduplication that returns keep bitmaps instead of text.

A line is known by 128 bits of hash of its key. Occurrences are partitioned by ranges of (hash, document), sorted by
document and position inside, and streamed: a window passes over each range in that order and lets the first occurrence
of a line in a document through. Those first occurrences are counted by line, the largest document owns a line that
enough documents share, and the lines of all others are marked. What goes back to a document is one run-length bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_lower, unused
from tidemark.storage import materialize

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCUMENTS = 5


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def row_key(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(document, checksum of its text): tells rows apart, as far as it matters, that repeat an id."""
    return docs.select(F.col(id_column).alias("doc"), F.xxhash64(F.col(text_column)).alias("text_hash"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, pos, h1, h2) of every line whose key is long enough."""
    lines = rows.select("doc", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.filter(F.length("line") >= min_chars).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.length("key") >= min_chars).select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def drop_bitmaps(rows: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row for each (doc, text_hash) that loses lines, with ``bitmap``: array of (first line, lines) that go.

    Ranges of (hash, document) are dealt out, so a line in a third of all documents spans many ranges. The window's groups
    are what the ranges keep together, so it needs no shuffle of its own, only their order. Counts and largest documents
    of the first occurrences merge with partial sums, which leaves one row of a line for each task.
    """
    found = materialize(long_lines(rows, min_chars), "line-hashes")
    in_document = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    first = found.repartitionByRange("h1", "h2", "doc").withColumn("nth", F.row_number().over(in_document)).filter("nth = 1")
    shared = first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("owner")).filter(F.col("n_docs") >= min_documents)
    shared = materialize(shared, "shared-lines")  # so that the join below has two plain inputs, whose skewed keys Spark splits
    marked = found.join(shared, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("owner")))
    dropped = marked.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return dropped.select("doc", "text_hash", runs(F.col("gone")).alias("bitmap"))


def runs(positions: Column) -> Column:
    """Sorted positions as (first, count) runs: a run starts where the position before is not there, and ends likewise."""
    n = F.size(positions)
    first = F.filter(F.transform(positions, lambda p, i: F.when((i == 0) | (F.get(positions, i - 1) != p - 1), p)), lambda p: p.isNotNull())
    last = F.filter(F.transform(positions, lambda p, i: F.when((i == n - 1) | (F.get(positions, i + 1) != p + 1), p)), lambda p: p.isNotNull())
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("count")))


def deduplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``drop_bitmap``, ``n_lines`` and ``n_dropped``, and ``kept_text`` (the other lines, joined by \\n).

    Keys of at least ``min_chars`` code points that at least ``min_documents`` distinct ids hold lose all their lines
    except in the largest id. A null or empty text is one empty line. Rows with a null id count as one document
    that is smaller than any other; where only that one is left it owns the line. Rows that repeat an id are one
    document, each keeping or losing lines by that id. Columns of ``docs`` named like a result column are replaced, others
    may have any names.
    """
    docs = docs.drop("drop_bitmap", "n_lines", "n_dropped", "kept_text")
    bitmaps = drop_bitmaps(row_key(docs, id_column, text_column), min_chars, min_documents)
    doc, text_hash, lines = unused(docs, 3)
    bitmaps = bitmaps.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("bitmap").alias("drop_bitmap"))
    same = docs[id_column].eqNullSafe(F.col(doc)) & (F.xxhash64(docs[text_column]) == F.col(text_hash))
    joined = docs.join(bitmaps, same, "left").drop(doc, text_hash)
    joined = joined.withColumn(lines, F.split(F.coalesce(F.col(text_column), F.lit("")), "\n"))
    # what stays lies before the first run, between runs and after the last
    begin = F.concat(F.array(F.lit(0)), F.transform("drop_bitmap", lambda r: r["first"] + r["count"]))
    end = F.concat(F.transform("drop_bitmap", lambda r: r["first"]), F.array(F.size(lines)))
    stays = F.zip_with(begin, end, lambda a, b: F.slice(lines, a + 1, b - a))
    kept = F.when(F.col("drop_bitmap").isNull(), F.coalesce(F.col(text_column), F.lit(""))).otherwise(F.array_join(F.flatten(stays), "\n"))
    n_dropped = F.coalesce(F.aggregate("drop_bitmap", F.lit(0), lambda a, r: a + r["count"]), F.lit(0))
    return joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": n_dropped.cast("long"), "kept_text": kept}).drop(lines)
