"""Places inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.storage import materialize

RANGES = 256


def numbered(rows: DataFrame, group: str, position: str, out: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``out``: 1, 2, ... inside each group in the order of a numeric ``position``; ties in any order.

    Positions are cut into ranges of equal width. Rows meet by group and range, and one count of each goes before them, so
    a group that holds most rows is numbered by as many tasks as it has ranges.
    """
    ends = rows.agg(F.min(position).alias("low"), F.max(position).alias("high")).first()
    low, width = ends["low"] or 0, max(1, ((ends["high"] or 0) - (ends["low"] or 0)) // ranges + 1)
    cut = rows.withColumn("range_of", F.floor((F.col(position) - F.lit(low)) / F.lit(width)))
    before = Window.partitionBy("group_of").orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col(group).alias("group_of"), F.col("range_of").alias("range_at")).agg(F.count("*").alias("size"))
    starts = sizes.select("group_of", "range_at", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, "range_of").orderBy(position))
    met = cut.withColumn("nth_in_range", inside).join(starts, F.col(group).eqNullSafe(F.col("group_of")) & F.col("range_of").eqNullSafe(F.col("range_at")))
    return met.withColumn(out, F.col("start") + F.col("nth_in_range")).select(*rows.columns, out)


def ranked(rows: DataFrame, group: str, by: str, out: str) -> DataFrame:
    """Adds ``out``: 1, 2, ... inside each group in the order of ``by``, of any type that can be sorted; ties in any order.

    The rows are sorted into ranges of (group, by) once; a group's number of rows in the ranges before goes ahead, so no
    group has to fit into a task.
    """
    placed = materialize(rows.repartitionByRange(group, by).withColumn("range_of", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("group_of").orderBy("range_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(F.col(group).alias("group_of"), F.col("range_of").alias("range_at")).agg(F.count("*").alias("size"))
    starts = sizes.select("group_of", "range_at", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy(group, "range_of").orderBy(by))
    met = placed.withColumn("nth_in_range", inside).join(starts, F.col(group).eqNullSafe(F.col("group_of")) & (F.col("range_of") == F.col("range_at")))
    return met.withColumn(out, F.col("start") + F.col("nth_in_range")).select(*rows.columns, out)
