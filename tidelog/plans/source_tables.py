"""Facts about the source tables, and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns that make up row_key where it isn't ``id`` alone.
KEY_COLUMNS = {"region_orders": ["id", "region"], "indexed_users": ["email"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
