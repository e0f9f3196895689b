"""Readers for the input tables (parquet, one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; projections and filters applied later are pushed
    into the scan by Catalyst (ReadSchema / PushedFilters)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
