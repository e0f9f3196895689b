"""The offline catalogue pipeline as one function: dump to index, with reports.

Every stage is a table under ``out`` that is reused where it is complete and was
made from the same inputs (materialise-or-load by fingerprint), so an interrupted run
goes on where it stopped and a changed input rebuilds its stage and all behind it.
Fetched responses are classified in epochs, each a checkpoint; failures are retried
with the next saved responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io as IO
from . import backfill as BF
from . import bridge as B
from . import consolidate as C
from . import index as IX
from .encode import encode_distinct, encode_report

LINKS = "movieId long, imdbId string, tmdbId long"
MOVIES = "movieId long, title string, genres string"
RESPONSES = "wiki_title string, status int, body string"
SHORT_PLOT_WORDS = 50


def build_catalogue(spark: SparkSession, out: str, *, dump: str, links: str, movies: str, mapping: str, responses: str,
                    model: str = "hashed-words", checkpoint_every: int = 100_000) -> dict[str, DataFrame]:
    """Run the stages and return their tables.

    ``dump`` is a wiki XML dump, ``links`` and ``movies`` are CSV files, ``mapping``
    a folder of saved SPARQL results (one JSON document a file, variables
    ``articleTitle`` and ``imdbId``), ``responses`` a JSON-lines table of saved
    article-API responses (``wiki_title, status, body``)."""
    out = out.rstrip("/")

    def stage(name: str, df: DataFrame, files: list[str], after: list[str] = ()) -> DataFrame:
        return IO.materialize_to(df, f"{out}/{name}", inputs=[*files, *(f"{out}/{n}" for n in after)], params={"stage": name})

    def report(name: str, df: DataFrame) -> None:
        IO.write_report(df, f"{out}/reports/{name}")

    # 1 extract
    pages = IO.first_revision_pages(IO.read_wiki_dump(spark, dump))
    tagged = stage("articles", B.tagged_articles(pages), [dump])
    plots = B.plots_of(tagged)
    report("extract", B.report_of(tagged))
    # 2 bridge
    link_rows, movie_rows = IO.read_csv(spark, links, LINKS), IO.read_csv(spark, movies, MOVIES)
    saved = spark.read.text(mapping, wholetext=True)
    titles = stage("mapping", IO.sparql_bindings(saved, "value", ["articleTitle", "imdbId"]).withColumnRenamed("articleTitle", "wiki_title"), [mapping])
    with_id = B.bridge_plots(plots, titles)
    matched = stage("matched", B.join_with_catalog(with_id, link_rows, movie_rows), [links, movies], ["articles", "mapping"])
    IO.write_parquet(B.unmatched_plots(plots, titles), f"{out}/unmatched_plots")
    report("bridge", B.bridge_report(plots, with_id, link_rows, matched))
    # 3 backfill
    missing = B.unmatched_movies(link_rows, matched, movie_rows)
    resolved = stage("resolved", B.kb_id_lookup(missing, titles), [links, movies], ["matched", "mapping"])
    results, failures = BF.run(resolved, spark.read.schema(RESPONSES).json(responses), f"{out}/backfill", every=checkpoint_every)
    IO.write_csv(failures.select("wiki_title", "imdbId", "failure_reason"), f"{out}/failed_lookups")
    IO.write_csv(results.where(T.word_count("plot_text") < SHORT_PLOT_WORDS), f"{out}/short_plots")
    report("failures", failures.groupBy("failure_reason").agg(F.count("*").alias("n")))
    report("backfill", B.backfill_report(missing, resolved, results, failures))
    backfill = B.backfilled(results, missing).join(B.parsed_movies(movie_rows), "movieId", "left").select(
        "movieId", "imdbId", F.col("parsed_title").alias("title"), "year", "plot_text", "genres")
    # 4 consolidate
    IO.write_parquet(C.consolidate(matched, backfill), f"{out}/movie_plots", sort_by=["movieId"])
    final = spark.read.parquet(f"{out}/movie_plots")
    report("coverage", C.coverage_report(final, link_rows))
    report("plot_length", C.length_quantiles(final))
    report("genres", C.genre_coverage(final, movie_rows))
    IO.write_csv(C.no_plot_movies(link_rows, movie_rows, final), f"{out}/no_plot_movies")
    # 5 encode and index
    texts = final.select("movieId", T.prepend_metadata("plot_text", T.media_type("genres"), "genres", "year", "title").alias("text"))
    vectors = encode_distinct(texts, "text").select("movieId", "embedding")
    index = stage("index", IX.index_metadata(final).join(vectors, "movieId"), [links, movies], ["matched", "backfill"])
    report("encode", encode_report(index, model=model, index_path=f"{out}/index", metadata_path=f"{out}/index"))
    return {"plots": plots, "matched": matched, "backfill": results, "failures": failures, "movie_plots": final, "index": index}
