"""Gap backfill in epochs: a checkpoint after every ``every`` responses.

Saved responses of resolved titles are classified epoch by epoch, each written as
one folder of the attempts table that counts only once it is complete. A run that
stops in the middle goes on with what has not been tried: titles that succeeded
and responses that were classified are taken out by anti joins, whatever their
epoch, and an epoch that was left half-written is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import io as IO
from . import bridge as B
from .index import contiguous_index

ATTEMPTS = "wiki_title string, imdbId string, plot_text string, failure_reason string, response_key string, epoch int"


def complete_epochs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the epochs whose folders are complete."""
    numbers = [int(n.split("=")[1]) for n in IO.list_folder(spark, path) if n.startswith("epoch=")]
    return sorted(n for n in numbers if IO._complete(spark, f"{path}/epoch={n}"))


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """All classified responses so far with their epoch."""
    done = [f"{path}/epoch={n}" for n in complete_epochs(spark, path)]
    if not done:
        return spark.createDataFrame([], ATTEMPTS)
    return spark.read.schema(ATTEMPTS).option("basePath", path).parquet(*done)


def run(resolved: DataFrame, responses: DataFrame, path: str, *, every: int = 100_000,
        progress: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Classify what has not been tried yet; ``(results, failures)`` over all runs.

    ``resolved`` is ``wiki_title, imdbId``; ``responses`` is ``wiki_title, status,
    body``. Results are the titles with a plot, failures the last reason of each
    title without one. A response is known by its title, status and body, so a failed
    title is tried again as soon as another response for it is saved. ``progress`` is
    called with the number of every epoch once it is written."""
    spark = resolved.sparkSession
    path = path.rstrip("/")
    tried = attempts(spark, path)
    key = F.md5(F.concat_ws("|", F.col("status").cast("string"), F.coalesce("body", F.lit("\0"))))
    todo = B.resume_pending(resolved.select("wiki_title", "imdbId"), tried.where(F.col("failure_reason").isNull()))
    todo = todo.join(responses, "wiki_title").withColumn("response_key", key)
    todo = todo.join(tried.select("wiki_title", "imdbId", "response_key"), ["wiki_title", "imdbId", "response_key"], "left_anti")
    todo = contiguous_index(todo, ["wiki_title", "imdbId", "response_key"], out="_i").withColumn("_epoch", (F.col("_i") / every).cast("int")).drop("_i")
    staged = f"{IO.stage_folder(spark)}/{IO.fresh_name()}"
    todo.write.partitionBy("_epoch").parquet(staged)  # an epoch reads its own files only
    epochs = sorted(int(n.split("=")[1]) for n in IO.list_folder(spark, staged) if n.startswith("_epoch="))
    first = max(complete_epochs(spark, path), default=-1) + 1
    schema = todo.drop("_epoch").schema
    for k in epochs:
        number = first + k
        out = B.classify_responses(spark.read.schema(schema).parquet(f"{staged}/_epoch={k}"))
        out.select("wiki_title", "imdbId", "plot_text", "failure_reason", "response_key").write.mode("overwrite").parquet(f"{path}/epoch={number}")
        if progress is not None:
            progress(number)
    every_try = attempts(spark, path)
    good = every_try.where(F.col("failure_reason").isNull())
    last = Window.partitionBy("wiki_title", "imdbId").orderBy(F.desc("epoch"), "response_key")
    results = good.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).select("wiki_title", "imdbId", "plot_text")
    bad = every_try.where(F.col("failure_reason").isNotNull()).join(good.select("wiki_title"), "wiki_title", "left_anti")
    failures = bad.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).select("wiki_title", "imdbId", "failure_reason")
    return results, failures
