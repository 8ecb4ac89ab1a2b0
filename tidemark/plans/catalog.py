"""All queries of the market-data library by operator id, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import clean_queries, context_queries, indicator_queries, join_queries, label_queries, model_queries, report_queries, stat_queries, store_queries

MODULES = [indicator_queries, join_queries, clean_queries, stat_queries, label_queries, context_queries, store_queries, model_queries, report_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
