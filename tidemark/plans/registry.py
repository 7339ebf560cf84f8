"""All registered queries of the library proper, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import article_queries, identity_queries, job_queries, ledger_queries, lifecycle_queries, page_queries, payload_queries, selection_queries, source_queries, stream_queries, view_queries

MODULES = [article_queries, job_queries, identity_queries, ledger_queries, lifecycle_queries, page_queries, payload_queries, selection_queries, source_queries, stream_queries, view_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
