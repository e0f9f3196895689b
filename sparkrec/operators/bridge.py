"""Offline pipeline, stages 1-3: extraction, id bridge, gap backfill.

Every IN-list of the reference becomes a semi / anti join (never ``isin`` on a
collected list); small dimension tables are broadcast only behind a counted
size check (``broadcast_if_small``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T
from ..sources.io import materialize

# Knowledge-base classes counted as film / TV (instance-of).
FILM_TV_CLASSES = [
    "Q11424", "Q24856", "Q5398426",
    "Q21191270", "Q24862", "Q506240",
    "Q1261214", "Q63952888", "Q220898",
]
INSTANCE_OF = "P31"
IMDB_ID_PROP = "P345"
# End of fixed values.


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Columns of several single-row aggregates in one row (each input is a
    global ``agg``, so the product is 1 x 1)."""
    out = one_row[0]
    for other in one_row[1:]:
        out = out.crossJoin(other)
    return out


def broadcast_if_small(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Broadcast hint only when the counted bytes of a one-column string table are
    within the limit; otherwise let the planner shuffle (exact either way)."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(df.columns[0]) + 16), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= config.broadcast_limit_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over as many partitions as there are cores where the input lies in fewer (a
    file of few row groups); a table of more partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ------------------------------------------------------------------ stage 1

def tagged_articles(articles: DataFrame) -> DataFrame:
    """Every article (null text too) with its ``plot_text`` (null without a plot
    section) and that text's ``n_words``: what plots and report both come from."""
    a = T.with_plot_section(spread(articles), "wikitext", "plot_text").select("wiki_title", "plot_text")
    return a.withColumn("n_words", T.word_count("plot_text"))


def plots_of(tagged: DataFrame, min_words: int = 20) -> DataFrame:
    return tagged.where(F.col("n_words") >= min_words).select("wiki_title", "plot_text")


def report_of(tagged: DataFrame, min_words: int = 20) -> DataFrame:
    """articles_scanned (null text counted), plots_extracted, extraction_rate %."""
    r = tagged.agg(F.count("*").alias("articles_scanned"), F.count_if(F.col("n_words") >= min_words).alias("plots_extracted"))
    return r.withColumn(
        "extraction_rate", F.col("plots_extracted") / F.greatest(F.col("articles_scanned"), F.lit(1)) * 100
    )


def extract_plots(articles: DataFrame, min_words: int = 20) -> DataFrame:
    """(wiki_title, wikitext) -> (wiki_title, plot_text) for articles whose plot
    section has at least ``min_words`` words. No shuffle; plots are written once."""
    # materialised before any filter: a filter on the plot or its word count would be
    # pushed below the projections and repeat the extraction for each name it reads
    tagged = tagged_articles(articles.where(F.col("wikitext").isNotNull()))
    return plots_of(materialize(tagged), min_words)


def extract_report(articles: DataFrame, min_words: int = 20) -> DataFrame:
    """The report of articles that are not tagged yet."""
    return report_of(tagged_articles(articles), min_words)


# ------------------------------------------------------------------ stage 2

def bridge_plots(plots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Plots x title->imdb mapping on wiki_title (inner)."""
    return plots.join(mapping, "wiki_title", "inner")


def unmatched_plots(plots: DataFrame, mapping: DataFrame) -> DataFrame:
    return plots.join(mapping.select("wiki_title"), "wiki_title", "left_anti")


def normalized_links(links: DataFrame) -> DataFrame:
    return links.withColumn("imdbId", T.normalize_imdb_id(F.col("imdbId").cast("string")))


def parsed_movies(movies: DataFrame) -> DataFrame:
    return movies.select(
        "movieId", T.title_name("title").alias("parsed_title"), T.title_year("title").alias("year"), "genres"
    )


def join_with_catalog(plots_with_imdb: DataFrame, links: DataFrame, movies: DataFrame) -> DataFrame:
    """Normalised imdb id join with links, then left join with parsed movies.
    -> movieId, imdbId, title, year, plot_text, genres."""
    p = plots_with_imdb.withColumn("imdbId", T.normalize_imdb_id("imdbId"))
    j = p.join(normalized_links(links).select("movieId", "imdbId"), "imdbId", "inner")
    r = j.join(parsed_movies(movies), "movieId", "left")
    return r.select("movieId", "imdbId", F.col("parsed_title").alias("title"), "year", "plot_text", "genres")


def bridge_report(plots: DataFrame, with_imdb: DataFrame, links: DataFrame, matched: DataFrame) -> DataFrame:
    a = plots.agg(F.count("*").alias("total_wikiplots_extracted"))
    b = with_imdb.agg(F.count("*").alias("wikiplots_with_wikidata_match"))
    c = links.agg(F.count("*").alias("total_movielens_movies"))
    m = matched.agg(F.count("*").alias("wikiplots_in_movielens"))
    r = side_by_side(a, b, c, m)
    return r.select(
        "total_wikiplots_extracted", "wikiplots_with_wikidata_match",
        (F.col("wikiplots_with_wikidata_match") / F.greatest("total_wikiplots_extracted", F.lit(1)) * 100)
        .alias("wikidata_match_rate"),
        "total_movielens_movies", "wikiplots_in_movielens",
        (F.col("wikiplots_in_movielens") / F.greatest("total_movielens_movies", F.lit(1)) * 100)
        .alias("movielens_match_rate"),
    )


# ------------------------------------------------------------------ knowledge base

def kb_class_titles(sitelinks: DataFrame, statements: DataFrame, wiki: str = "enwiki",
                    classes=FILM_TV_CLASSES) -> DataFrame:
    """DISTINCT article titles whose item is an instance of a film/TV class."""
    cls = statements.where((F.col("prop") == INSTANCE_OF) & F.col("value").isin(*classes)).select("item")
    s = sitelinks.where(F.col("wiki") == wiki).select("item", F.col("title").alias("wiki_title"))
    return s.join(cls, "item", "left_semi").select("wiki_title").distinct()


def kb_id_bridge(sitelinks: DataFrame, statements: DataFrame, wiki: str = "enwiki") -> DataFrame:
    """(wiki_title, imdbId) for every article with an IMDb id; duplicates kept."""
    ids = statements.where(F.col("prop") == IMDB_ID_PROP).select("item", F.col("value").alias("imdbId"))
    s = sitelinks.where(F.col("wiki") == wiki).select("item", F.col("title").alias("wiki_title"))
    return s.join(ids, "item").select("wiki_title", "imdbId")


def kb_id_lookup(imdb_ids: DataFrame, bridge: DataFrame) -> DataFrame:
    """One title per requested id: the last one wins; 'last' = greatest title
    (a total order of our choosing, the reference's response order is open)."""
    hit = bridge.join(imdb_ids.select("imdbId").distinct(), "imdbId", "left_semi")
    return hit.groupBy("imdbId").agg(F.max_by("wiki_title", "wiki_title").alias("wiki_title"))


def title_semi_filter(plots: DataFrame, titles: DataFrame) -> DataFrame:
    return plots.join(titles.select("wiki_title"), "wiki_title", "left_semi")


def filter_report(raw: DataFrame, titles: DataFrame, kept: DataFrame) -> DataFrame:
    r = raw.agg(F.count("*").alias("raw_count"))
    t = titles.agg(F.count("*").alias("wikidata_titles"))
    k = kept.agg(F.count("*").alias("filtered_count"))
    return side_by_side(r, t, k).withColumn("removed_count", F.col("raw_count") - F.col("filtered_count"))


# ------------------------------------------------------------------ stage 3

def unmatched_movies(links: DataFrame, matched: DataFrame, movies: DataFrame) -> DataFrame:
    """Catalogue movies whose normalised imdb id was not matched. Null ids are
    dropped (a NOT IN filter drops them; a plain anti join would keep them) and
    null matched ids are ignored."""
    ln = normalized_links(links).where(F.col("imdbId").isNotNull())
    m = matched.select("imdbId").where(F.col("imdbId").isNotNull())
    un = ln.join(m, "imdbId", "left_anti")
    return un.join(movies, "movieId", "left")


RESPONSE_SCHEMA = "parse struct<wikitext: struct<`*`: string>>, error struct<code: string>"


def classify_responses(resp):
    """(title, plot, failure_reason) per saved fetch: ``network_error: <type>``
    when the request itself failed (optional ``error_type`` column),
    ``max_retries`` when still rate-limited (429) after the retries, ``http_N``
    for other non-200, the API error code (``api_error`` when it has none),
    ``no_plot_section``, ``unknown`` when a 200 response cannot be decoded, or
    null on success."""
    if "error_type" not in resp.columns:
        resp = resp.withColumn("error_type", F.lit(None).cast("string"))
    r = spread(resp).withColumn("_j", F.from_json("body", RESPONSE_SCHEMA))
    r = r.withColumn("_wt", F.coalesce(F.col("_j")["parse"]["wikitext"]["*"], F.lit("")))
    r = T.with_plot_section(r, "_wt", "plot_text", from_api=True)
    j, plot = F.col("_j"), F.col("plot_text")
    reason = (
        F.when(F.col("error_type").isNotNull(), F.concat(F.lit("network_error: "), F.col("error_type")))
        .when(F.col("status") == 429, F.lit("max_retries"))
        .when(F.col("status") != 200, F.concat(F.lit("http_"), F.col("status").cast("string")))
        .when(j.isNull() | (j["error"].isNull() & j["parse"].isNull()), F.lit("unknown"))
        .when(j["error"].isNotNull(), F.coalesce(j["error"]["code"], F.lit("api_error")))
        .when(plot.isNull(), F.lit("no_plot_section"))
    )
    keep = [c for c in resp.columns if c not in ("status", "body", "error_type")]
    return r.select(*keep, "plot_text", reason.alias("failure_reason"))


def resume_pending(resolved: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Titles still to fetch: resolved titles not in the checkpoint (failures
    are not checkpointed, so they are retried)."""
    return resolved.join(checkpoint.select("wiki_title"), "wiki_title", "left_anti")


def backfilled(results: DataFrame, unmatched: DataFrame) -> DataFrame:
    """Successful fetches (checkpointed + new) x unmatched movies on imdbId."""
    return results.join(unmatched.select("movieId", "imdbId"), "imdbId", "inner")


def backfill_report(unmatched: DataFrame, resolved: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    a = unmatched.agg(F.count("*").alias("total_unmatched"))
    b = resolved.agg(F.count("*").alias("wikidata_resolved"))
    c = results.agg(F.count("*").alias("plots_fetched"))
    d = failures.agg(F.count("*").alias("fetch_failures"))
    return side_by_side(a, b, c, d)
