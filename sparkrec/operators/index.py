"""Index upkeep: contiguous row index, append with next index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialize


def contiguous_index(df: DataFrame, order: list[str], *, out: str = "faiss_idx", start=0) -> DataFrame:
    """Gap-free 0-based index in ``order`` (a total order), without a
    single-partition window: range-partition by ``order`` (materialised so the
    partition ids are stable), count rows per partition, prefix-sum the counts
    (one row per partition, broadcast), then number rows inside each partition.
    ``start`` may be a Column (e.g. the current index size)."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_p", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy("_p").orderBy(*order)
    start = start if not isinstance(start, (int, float)) else F.lit(start)
    r = ranged.join(F.broadcast(offs), "_p").withColumn(
        out, (start + F.col("_off") + F.row_number().over(inner) - 1).cast("long"))
    return r.drop("_p", "_off")


def index_metadata(plots: DataFrame, order: str = "movieId", drop: str = "plot_text") -> DataFrame:
    """Metadata table of the vector index: every column but the text, plus a
    contiguous ``faiss_idx`` in ``order``."""
    return contiguous_index(plots.drop(drop), [order])


def append_rows(base: DataFrame, new: DataFrame, *, order: list[str], idx: str = "faiss_idx") -> DataFrame:
    """Append ``new`` rows with indexes continuing after ``base`` (current
    size = max index + 1); columns missing on either side become null."""
    size = base.agg(F.coalesce(F.max(idx) + 1, F.lit(0)).alias("_n"))
    n = size.first()["_n"]
    added = contiguous_index(new, order, out=idx, start=n)
    return base.unionByName(added, allowMissingColumns=True)
