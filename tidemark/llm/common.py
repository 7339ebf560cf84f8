"""Small helpers that several training-data operators share."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` lacks, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    names = (f"own_{i}" for i in range(len(taken) + n))
    return [name for name in names if name not in taken][:n]


def utf8_list(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text in an Arrow string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def numbered_in_groups(df: DataFrame, group: str, bucket: str, order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of (bucket, order).

    Rows meet only by (group, bucket), so a large group is numbered by as many tasks as it has buckets; what
    crosses buckets is one count for each of them.
    """
    sizes = df.groupBy(group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    joined = numbered.join(starts, numbered[group].eqNullSafe(starts["_g"]) & (numbered[bucket] == starts["_b"]))
    return joined.withColumn(out, F.col("_start") + F.col("_rn") - 1).drop("_g", "_b", "_start", "_rn")


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """Of (..., n): the rows with the largest n, at most ``most`` of them.

    A histogram over the leading bits of n says from which count on that holds, so rows with an equal n stay or go
    together. Only the histogram, a few hundred rows, reaches the driver.
    """
    shift = "CAST(greatest(length(bin(n)) - 6, 0) AS INT)"
    sized = counts.select(F.expr(f"shiftleft(shiftright(n, {shift}), {shift})").alias("least"))
    held, floor = 0, None
    for row in sized.groupBy("least").agg(F.count("*").alias("rows")).orderBy(F.desc("least")).collect():
        held += row["rows"]
        if held > most:
            break
        floor = row["least"]
    return counts.filter(F.lit(False) if floor is None else F.col("n") >= floor)
