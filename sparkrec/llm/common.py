"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrec.session import ensure_checkpoint_dir, ship_package
from sparkrec.sources.io import materialize

__all__ = ["table", "ship", "ascii_lower", "crc_remainder", "materialize", "broadcast_if_under", "ensure_checkpoint_dir", "ship_texts"]

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package importable in its Python workers."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def ship_texts(df: DataFrame, most: str = "4m") -> SparkSession:
    """:func:`ship` for an operator that hands whole texts to Python workers: unless the
    session says otherwise, an Arrow batch ends at ``most`` bytes (a row is never cut).
    The JVM holds a batch of each task twice outside its heap, in buffers that double,
    and the worker as Arrow and as strings: at Spark's 64 MB, hundreds of MB an executor."""
    spark = ship(df)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, most)
    return spark


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. A string of as many bytes as characters is
    pure ASCII, where the fast built-in does the same."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def broadcast_if_under(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` are within ``limit``;
    beyond it Spark joins by shuffle (with adaptive skew splitting)."""
    return F.broadcast(df) if rows <= limit else df
