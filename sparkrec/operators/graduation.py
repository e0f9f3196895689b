"""Cold-start graduation: threshold crossing, counts, retrain signal, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import prefix as PX


def graduations(interactions: DataFrame, catalog: DataFrame, *, movie: str = "movie_id", order: list[str],
                threshold: int = DEFAULT.graduation_threshold, time_col: str = "ts", config: Config = DEFAULT) -> DataFrame:
    """Movies outside the behavioural catalogue that reached ``threshold``
    interactions: ``movie, graduated_at`` (date of the threshold-th event,
    ``yyyy-MM-dd``) and ``interaction_count`` (counting continues after).

    Where a movie has more than ``config.hot_key_rows`` interactions they are
    numbered by a prefix scan over ranges of (movie, order)."""
    x = interactions.join(catalog.select(movie), movie, "left_anti")
    if PX.is_hot(x, movie, config.hot_key_rows):
        slim = x.select(*dict.fromkeys([movie, time_col, *order]))
        nth = PX.numbered(PX.in_parts(slim, movie, order), "_k").rows.where(F.col("_k") == threshold)
    else:
        w = Window.partitionBy(movie).orderBy(*order)
        nth = x.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == threshold)
    grad = nth.select(movie, F.date_format(time_col, "yyyy-MM-dd").alias("graduated_at"))
    return grad.join(interaction_counts(x, movie=movie), movie)


def interaction_counts(interactions: DataFrame, *, movie: str = "movie_id") -> DataFrame:
    return interactions.groupBy(movie).agg(F.count("*").alias("interaction_count"))


def retrain_signal(pending: DataFrame, n: int = DEFAULT.retrain_on_graduation_count) -> DataFrame:
    """One row: pending count and whether it reached the retrain threshold."""
    return pending.agg(F.count("*").alias("pending_count")).withColumn(
        "should_retrain", F.col("pending_count") >= F.lit(n)
    )


def weekly_batches(pending: DataFrame, *, movie: str = "movie_id") -> DataFrame:
    """Retrain schedule: graduations are completed in the batch of their
    (Monday-start) week, ``retrained_at`` = the next Monday; the newest week is
    still open and stays pending. ``movie, status, batch, retrained_at``."""
    wk = F.date_trunc("week", F.to_timestamp("graduated_at"))
    p = pending.withColumn("_wk", wk)
    newest = p.agg(F.max("_wk").alias("_newest"))
    p = p.crossJoin(F.broadcast(newest))  # newest: one row
    done = F.col("_wk") < F.col("_newest")
    return p.select(
        movie,
        F.when(done, "completed").otherwise("pending").alias("status"),
        F.when(done, F.concat(F.lit("batch-"), F.date_format("_wk", "yyyy-MM-dd"))).alias("batch"),
        F.when(done, F.date_format(F.date_add(F.col("_wk").cast("date"), 7), "yyyy-MM-dd")).alias("retrained_at"),
    )


def mark_retrained(pending: DataFrame, retrained: DataFrame, completed: DataFrame | None = None, *,
                   movie: str = "movie_id", batch_id: str | Column, retrained_at: str | Column) -> tuple[DataFrame, DataFrame]:
    """Move the given movies from pending to completed (semi / anti split). Batch and
    date are the same for all, or columns of ``pending`` where several batches are done.
    Returns ``(pending, completed)``; completed movies join the catalogue."""
    moved = pending.join(retrained.select(movie), movie, "left_semi").withColumn(
        "retrained_at", F.lit(retrained_at)).withColumn("batch", F.lit(batch_id))
    still = pending.join(retrained.select(movie), movie, "left_anti")
    if completed is not None:
        moved = completed.unionByName(moved, allowMissingColumns=True)
    return still, moved
