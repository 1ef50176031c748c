"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans import change_queries, log_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return change_queries.QUERIES | log_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return change_queries.ORACLE | log_queries.ORACLE
