"""Offline pipeline, stage 4: consolidate, reports, quantiles, genre coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.io import materialize
from .bridge import broadcast_if_small, normalized_links, side_by_side
from .quantiles import quantile_values

COMMON_COLS = ["movieId", "imdbId", "title", "year", "plot_text", "genres", "plot_source"]
SOURCE_DUMP, SOURCE_API = "wiki_dump", "wikipedia_api"  # fixed values
NO_GENRES = "(no genres listed)"  # fixed value


def _common(df: DataFrame, source: str, other: DataFrame) -> DataFrame:
    """The common columns of one source; a column it lacks is a null of the other's type."""
    def column(name):
        if name == "plot_source":
            return F.lit(source).alias(name)
        if name in df.columns:
            return F.col(name)
        return F.lit(None).cast(other.schema[name].dataType if name in other.columns else "string").alias(name)

    return df.select(*[column(c) for c in COMMON_COLS])


def consolidate(dump_matched: DataFrame, backfill: DataFrame) -> DataFrame:
    """Union (missing columns -> null, ints widened) and keep one row per
    movieId, preferring ``wiki_dump`` over ``wikipedia_api`` (source name order);
    ties inside a source are broken by imdbId, plot_text. Adds ``plot_length``
    (tokens split on a single space)."""
    u = _common(dump_matched, SOURCE_DUMP, backfill).unionByName(_common(backfill, SOURCE_API, dump_matched))
    w = Window.partitionBy("movieId").orderBy("plot_source", "imdbId", "plot_text")
    first = u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return first.withColumn("plot_length", T.space_token_count("plot_text"))


def coverage_report(final: DataFrame, links: DataFrame) -> DataFrame:
    t = links.agg(F.count("*").alias("total_movielens_movies"))
    f = final.agg(
        F.count("*").alias("movies_with_plot"),
        F.count_if(F.col("plot_source") == SOURCE_DUMP).alias("from_wiki_dump"),
        F.count_if(F.col("plot_source") == SOURCE_API).alias("from_wikipedia_api"),
    )
    r = side_by_side(t, f)
    den = F.greatest(F.col("total_movielens_movies"), F.lit(1))
    missing = F.col("total_movielens_movies") - F.col("movies_with_plot")
    return r.select(
        "total_movielens_movies", "movies_with_plot",
        (F.col("movies_with_plot") / den * 100).alias("coverage_pct"),
        "from_wiki_dump", "from_wikipedia_api",
        missing.alias("still_missing"), (missing / den * 100).alias("missing_pct"),
    )


def length_quantiles(final: DataFrame, col: str = "plot_length") -> DataFrame:
    """min / p25 / median / p75 / max of an integer column, truncated to int,
    0 when empty. Quantiles use the "nearest" rank ``round((n-1)q)``; the
    median averages the two middle values. Exact, by rank selection
    (:mod:`.quantiles`): no task sees all distinct values."""
    found = quantile_values(final, col) or (0,) * 6
    row = (int(found[0]), int(found[1]), int((found[2] + found[3]) / 2), int(found[4]), int(found[5]))
    return final.sparkSession.createDataFrame([row], "min long, p25 long, median long, p75 long, max long")


def genre_coverage(final: DataFrame, movies: DataFrame) -> DataFrame:
    """Per genre of the vocabulary (tokens of ``genres`` split on ``|``, minus the
    placeholder): movies whose genres *contain* the genre (regex), and how many
    of them have a plot. Genres with zero total are dropped.

    Both tables are counted by their genres string first, so the regex join meets
    distinct strings only, however many movies share them."""
    total = movies.where(F.col("genres").isNotNull()).groupBy("genres").agg(F.count("*").alias("t"))
    matched = final.where(F.col("genres").isNotNull()).groupBy("genres").agg(F.count("*").alias("m"))
    lists = materialize(total.join(matched, "genres", "full").select("genres", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("m", F.lit(0)).alias("m")))
    vocab = lists.where("t > 0").select(F.explode(F.split("genres", r"\|")).alias("genre")).where(F.col("genre") != NO_GENRES).distinct()
    vocab = broadcast_if_small(vocab)
    r = lists.join(vocab, F.expr("genres rlike genre")).groupBy("genre").agg(F.sum("m").alias("matched"), F.sum("t").alias("total"))
    return r.where(F.col("total") > 0).withColumn("match_pct", F.col("matched") / F.col("total") * 100)


def no_plot_movies(links: DataFrame, movies: DataFrame, final: DataFrame) -> DataFrame:
    """Catalogue movies without a plot: imdbId, parsed title, year, genres,
    sorted by year descending with nulls first."""
    ln = normalized_links(links).where(F.col("imdbId").isNotNull())
    done = final.select("imdbId").where(F.col("imdbId").isNotNull())
    j = ln.join(movies, "movieId", "left").join(done, "imdbId", "left_anti")
    return j.select(
        "imdbId", T.title_name("title").alias("title"), T.title_year("title").alias("year"), "genres"
    ).orderBy(F.col("year").desc_nulls_first())
