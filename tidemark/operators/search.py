"""Search over signals, concepts and sources by one needle, as one typed list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concept_texts(fields: DataFrame, labels: DataFrame, order: list[str]) -> DataFrame:
    """(slug, text): all that a concept says, field by field in ``order``, with the names of its themes in place of their ids.

    ``fields``: slug, field, value, a list's items one a line; ``labels``: theme, label, any number for a theme. A theme without
    a label is not searched, nor is a field that ``order`` lacks.
    """
    said = fields.filter(F.col("field").isin(*order) & (F.coalesce("value", F.lit("")) != ""))
    ids = said.filter("field = 'themes'").select("slug", "field", F.explode(F.split("value", "\n")).alias("theme"))
    named = ids.join(labels, "theme").select("slug", "field", F.col("label").alias("value"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("field"))
    rows = said.filter("field <> 'themes'").select("slug", "field", "value").unionByName(named).select("slug", place.alias("place"), "value")
    return rows.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda r: r["value"]), " ").alias("text"))


def search(kinds: dict[str, DataFrame], needle: str | Column) -> DataFrame:
    """(kind, id) of the rows (id, text) of each kind whose text contains the needle, whatever the case; an empty one finds nothing."""
    wanted = F.lower(F.trim(F.lit(needle) if isinstance(needle, str) else needle))
    found = [rows.filter((wanted != "") & F.contains(F.lower("text"), wanted)).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id")) for kind, rows in kinds.items()]
    return reduce(DataFrame.unionByName, found)
