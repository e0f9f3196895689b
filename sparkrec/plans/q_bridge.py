"""Offline-pipeline queries (stages 1-4) over stand-in tables.

Stand-ins: articles <- documents (``Doc_<id>``, heading by language, see
``q_text.wiki_articles``); knowledge base <- labels (item ``Q<id>``, IMDb id
``tt<id*7919>`` normalised, class film when quality = 1, TV series when toxic =
1, else human); links <- part (raw id spellings of ``q_text.raw_imdb``);
movies <- part (``standins.movies``); API responses <- documents
(``q_text.api_responses``); earlier backfill checkpoint = successful responses
of low-quality (quality = 0) documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bridge as B
from ..operators import consolidate as C
from ..operators.quantiles import quantile_report
from ..sources.tables import table
from . import standins as S
from .q_text import PLOT_BODY, PLOT_WORDS, RAW_IMDB_SQL, api_responses, raw_imdb, wiki_articles
from ..sources.io import materialize
from .registry import query, stage

# ------------------------------------------------------------------ Spark stand-ins


def articles(spark, d):
    a = wiki_articles(spark, d)
    return a.select(F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("wiki_title"), "wikitext")


def plots_raw(spark, d):
    """Stage-1 output, materialised once per query (regex-heavy)."""
    return stage(("plots_raw", d), lambda: B.extract_plots(articles(spark, d)))


def sitelinks(spark, d):
    lb = table(spark, d, "labels")
    return lb.select(
        F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("item"),
        F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("title"),
        F.lit("enwiki").alias("wiki"),
    )


def statements(spark, d):
    lb = table(spark, d, "labels")
    item = F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("item")
    ids = lb.select(item, F.lit(B.IMDB_ID_PROP).alias("prop"),
                    T.normalize_imdb_id((F.col("doc_id") * 7919).cast("string")).alias("value"))
    cls = F.when(F.col("quality") == 1, "Q11424").when(F.col("toxic") == 1, "Q5398426").otherwise("Q5")
    inst = lb.select(item, F.lit(B.INSTANCE_OF).alias("prop"), cls.alias("value"))
    return ids.unionByName(inst)


def mapping(spark, d):
    return B.kb_id_bridge(sitelinks(spark, d), statements(spark, d))


def links(spark, d):
    r = raw_imdb(spark, d)
    return r.select(F.col("movie_id").alias("movieId"), F.col("raw_id").alias("imdbId"),
                    (F.col("movie_id") + 100000).alias("tmdbId"))


def movies_ml(spark, d):
    return S.movies(spark, d).select(F.col("movie_id").alias("movieId"), "title", "genres")


def matched(spark, d):
    return stage(("matched", d), lambda: materialize(B.join_with_catalog(
        B.bridge_plots(plots_raw(spark, d), mapping(spark, d)), links(spark, d), movies_ml(spark, d))))


def unmatched(spark, d):
    return B.unmatched_movies(links(spark, d), matched(spark, d), movies_ml(spark, d))


def backfill_parts(spark, d):
    """resolved ids, checkpointed successes, new successes, new failures."""
    un = unmatched(spark, d)
    resolved = B.kb_id_lookup(un, mapping(spark, d))
    # only resolved titles are fetched: join first, classify those responses
    fetched = stage(("fetched", d), lambda: materialize(
        B.classify_responses(resolved.join(api_responses(spark, d), "wiki_title"))))
    lb = table(spark, d, "labels").select(
        F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("wiki_title"), "quality")
    ok = F.col("failure_reason").isNull()
    ckpt = fetched.join(lb.where(F.col("quality") == 0), "wiki_title", "left_semi").where(ok)
    pending = B.resume_pending(fetched, ckpt)
    new_ok = pending.where(ok)
    new_fail = pending.where(~ok)
    return un, resolved, ckpt, new_ok, new_fail


def backfill(spark, d):
    un, resolved, ckpt, new_ok, _ = backfill_parts(spark, d)
    results = ckpt.unionByName(new_ok).select("wiki_title", "imdbId", "plot_text")
    return B.backfilled(results, un)


def final_plots(spark, d):
    bf = backfill(spark, d).join(B.parsed_movies(movies_ml(spark, d)), "movieId", "left").select(
        "movieId", "imdbId", F.col("parsed_title").alias("title"), "year", "plot_text", "genres", "wiki_title")
    return C.consolidate(matched(spark, d), bf)


# ------------------------------------------------------------------ oracle SQL

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
NORM_ID = ("('tt' || CASE WHEN length(regexp_replace({0}, '^t+', '')) < 7 "
           "THEN lpad(regexp_replace({0}, '^t+', ''), 7, '0') ELSE regexp_replace({0}, '^t+', '') END)")
TY = r"^(.+?)\s*\((\d{4})\)\s*$"


def NAME_SQL(x: str) -> str:
    strip = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN regexp_matches({x}, '{TY}') THEN " + strip.replace("{0}", f"regexp_extract({x}, '{TY}', 1)")
            + " ELSE " + strip.replace("{0}", x) + " END")


def YEAR_SQL(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{TY}', 2), '') AS INTEGER)"


BASE = f"""
art AS (SELECT doc_id, 'Doc_' || doc_id AS wiki_title, lang, text, source FROM documents),
plots AS (SELECT wiki_title, {PLOT_BODY} AS plot_text FROM art WHERE lang IN ('en', 'de', 'fr') AND {PLOT_WORDS} >= 20),
sl AS (SELECT 'Q' || doc_id AS item, 'Doc_' || doc_id AS title, 'enwiki' AS wiki FROM labels),
st AS (SELECT 'Q' || doc_id AS item, 'P345' AS prop, {NORM_ID.format('CAST(doc_id * 7919 AS VARCHAR)')} AS value FROM labels
       UNION ALL
       SELECT 'Q' || doc_id, 'P31', CASE WHEN quality = 1 THEN 'Q11424' WHEN toxic = 1 THEN 'Q5398426' ELSE 'Q5' END FROM labels),
mp AS (SELECT sl.title AS wiki_title, st.value AS imdbId FROM sl JOIN st ON sl.item = st.item
       WHERE st.prop = 'P345' AND sl.wiki = 'enwiki'),
lk AS (SELECT movie_id AS movieId, raw_id AS imdbId FROM ({RAW_IMDB_SQL})),
lkn AS (SELECT movieId, {NORM_ID.format('imdbId')} AS imdbId FROM lk),
mv AS (SELECT movie_id AS movieId, title, genres FROM ({S.MOVIES_SQL})),
mvp AS (SELECT movieId, {NAME_SQL('title')} AS parsed_title, {YEAR_SQL('title')} AS year, genres FROM mv),
wi AS (SELECT p.wiki_title, p.plot_text, m.imdbId FROM plots p JOIN mp m USING (wiki_title)),
win AS (SELECT wiki_title, plot_text, {NORM_ID.format('imdbId')} AS imdbId FROM wi),
matched AS (SELECT l.movieId, w.imdbId, m.parsed_title AS title, m.year, w.plot_text, m.genres
            FROM win w JOIN lkn l USING (imdbId) LEFT JOIN mvp m USING (movieId)),
unm AS (SELECT l.movieId, l.imdbId, mv.title, mv.genres FROM lkn l LEFT JOIN mv USING (movieId)
        WHERE l.imdbId IS NOT NULL AND l.imdbId NOT IN (SELECT imdbId FROM matched WHERE imdbId IS NOT NULL)),
resolved AS (SELECT imdbId, max(wiki_title) AS wiki_title FROM mp WHERE imdbId IN (SELECT imdbId FROM unm) GROUP BY imdbId),
resp AS (SELECT 'Doc_' || doc_id AS wiki_title, lang,
           CASE lang WHEN 'es' THEN 'http_503' WHEN 'de' THEN 'missingtitle' WHEN 'fr' THEN 'no_plot_section'
           ELSE CASE WHEN {STRIP.format('text')} = '' THEN 'no_plot_section' END END AS failure_reason,
           CASE WHEN lang = 'en' AND {STRIP.format('text')} <> '' THEN {STRIP.format('text')} END AS plot_text
         FROM documents),
fetched AS (SELECT r.imdbId, r.wiki_title, s.failure_reason, s.plot_text FROM resolved r JOIN resp s USING (wiki_title)),
ckpt AS (SELECT * FROM fetched WHERE failure_reason IS NULL
         AND wiki_title IN (SELECT 'Doc_' || doc_id FROM labels WHERE quality = 0)),
pending AS (SELECT * FROM fetched WHERE wiki_title NOT IN (SELECT wiki_title FROM ckpt)),
results AS (SELECT wiki_title, imdbId, plot_text FROM ckpt
            UNION ALL SELECT wiki_title, imdbId, plot_text FROM pending WHERE failure_reason IS NULL),
bf AS (SELECT r.imdbId, r.wiki_title, r.plot_text, u.movieId FROM results r JOIN unm u USING (imdbId)),
bft AS (SELECT bf.movieId, bf.imdbId, m.parsed_title AS title, m.year, bf.plot_text, m.genres
        FROM bf LEFT JOIN mvp m USING (movieId)),
un AS (SELECT *, 'wiki_dump' AS plot_source FROM matched UNION ALL SELECT *, 'wikipedia_api' FROM bft),
final AS (SELECT * EXCLUDE (rn), len(string_split(plot_text, ' ')) AS plot_length FROM (
            SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY plot_source, imdbId, plot_text) AS rn FROM un)
          WHERE rn = 1)
"""


def _w(body: str) -> str:
    return "WITH " + BASE.strip() + "\n" + body


# ------------------------------------------------------------------ queries


@query("extract_report", oracle=_w(
    "SELECT count(*) AS articles_scanned, count(*) FILTER (WHERE wiki_title IN (SELECT wiki_title FROM plots)) AS plots_extracted, "
    "round(count(*) FILTER (WHERE wiki_title IN (SELECT wiki_title FROM plots)) / greatest(count(*), 1) * 100, 6) AS extraction_rate FROM art"))
def extract_report(spark, d):
    r = B.extract_report(articles(spark, d))
    return r.select("articles_scanned", "plots_extracted", F.round("extraction_rate", 6).alias("extraction_rate"))


@query("bridge_join", oracle=_w("SELECT movieId, imdbId, title, year, genres, md5(plot_text) AS plot_md5 FROM matched"))
def bridge_join(spark, d):
    """Stage 2: plots -> knowledge-base IMDb id -> catalogue movie (title, year)."""
    m = matched(spark, d)
    return m.select("movieId", "imdbId", "title", "year", "genres", F.md5("plot_text").alias("plot_md5"))


@query("bridge_report", oracle=_w(
    "SELECT (SELECT count(*) FROM plots) AS total_wikiplots_extracted, (SELECT count(*) FROM wi) AS wikiplots_with_wikidata_match, "
    "round((SELECT count(*) FROM wi) / greatest((SELECT count(*) FROM plots), 1) * 100, 6) AS wikidata_match_rate, "
    "(SELECT count(*) FROM lk) AS total_movielens_movies, (SELECT count(*) FROM matched) AS wikiplots_in_movielens, "
    "round((SELECT count(*) FROM matched) / greatest((SELECT count(*) FROM lk), 1) * 100, 6) AS movielens_match_rate"))
def bridge_report(spark, d):
    p = plots_raw(spark, d)
    wi = B.bridge_plots(p, mapping(spark, d))
    r = B.bridge_report(p, wi, links(spark, d), matched(spark, d))
    return r.select(
        "total_wikiplots_extracted", "wikiplots_with_wikidata_match", F.round("wikidata_match_rate", 6).alias("wikidata_match_rate"),
        "total_movielens_movies", "wikiplots_in_movielens", F.round("movielens_match_rate", 6).alias("movielens_match_rate"))


@query("unmatched_plots", oracle=_w("SELECT wiki_title FROM plots WHERE wiki_title NOT IN (SELECT wiki_title FROM mp)"))
def unmatched_plots(spark, d):
    return B.unmatched_plots(plots_raw(spark, d), mapping(spark, d)).select("wiki_title")


@query("unmatched_movies", oracle=_w("SELECT movieId, imdbId, title, genres FROM unm"))
def unmatched_movies(spark, d):
    return unmatched(spark, d).select("movieId", "imdbId", "title", "genres")


@query("kb_class_titles", oracle=_w(
    "SELECT DISTINCT sl.title AS wiki_title FROM sl JOIN st ON sl.item = st.item WHERE sl.wiki = 'enwiki' AND st.prop = 'P31' "
    "AND st.value IN ('Q11424','Q24856','Q5398426','Q21191270','Q24862','Q506240','Q1261214','Q63952888','Q220898')"))
def kb_class_titles(spark, d):
    return B.kb_class_titles(sitelinks(spark, d), statements(spark, d))


@query("kb_id_bridge", oracle=_w("SELECT wiki_title, imdbId FROM mp"))
def kb_id_bridge(spark, d):
    return mapping(spark, d)


@query("kb_id_lookup", oracle=_w("SELECT imdbId, wiki_title FROM resolved"))
def kb_id_lookup(spark, d):
    """Resolve every unmatched movie's IMDb id to one article title."""
    return B.kb_id_lookup(unmatched(spark, d), mapping(spark, d)).select("imdbId", "wiki_title")


_CLS = "('Q11424','Q24856','Q5398426','Q21191270','Q24862','Q506240','Q1261214','Q63952888','Q220898')"
_TITLES = f"(SELECT DISTINCT sl.title FROM sl JOIN st ON sl.item = st.item WHERE st.prop = 'P31' AND st.value IN {_CLS})"


@query("title_semi_filter", oracle=_w(f"SELECT wiki_title FROM plots WHERE wiki_title IN {_TITLES}"))
def title_semi_filter(spark, d):
    titles = B.kb_class_titles(sitelinks(spark, d), statements(spark, d))
    return B.title_semi_filter(plots_raw(spark, d), titles).select("wiki_title")


@query("filter_report", oracle=_w(
    f"SELECT (SELECT count(*) FROM plots) AS raw_count, (SELECT count(*) FROM {_TITLES}) AS wikidata_titles, "
    f"(SELECT count(*) FROM plots WHERE wiki_title IN {_TITLES}) AS filtered_count, "
    f"(SELECT count(*) FROM plots) - (SELECT count(*) FROM plots WHERE wiki_title IN {_TITLES}) AS removed_count"))
def filter_report(spark, d):
    raw = plots_raw(spark, d)
    titles = B.kb_class_titles(sitelinks(spark, d), statements(spark, d))
    return B.filter_report(raw, titles, B.title_semi_filter(raw, titles))


@query("backfill_resume", oracle=_w("SELECT movieId, imdbId, wiki_title, md5(plot_text) AS plot_md5 FROM bf"))
def backfill_resume(spark, d):
    """Stage 3 with resume: checkpointed titles are skipped, the rest fetched."""
    return backfill(spark, d).select("movieId", "imdbId", "wiki_title", F.md5("plot_text").alias("plot_md5"))


@query("backfill_report", oracle=_w(
    "SELECT (SELECT count(*) FROM unm) AS total_unmatched, (SELECT count(*) FROM resolved) AS wikidata_resolved, "
    "(SELECT count(*) FROM results) AS plots_fetched, (SELECT count(*) FROM pending WHERE failure_reason IS NOT NULL) AS fetch_failures"))
def backfill_report(spark, d):
    un, resolved, ckpt, new_ok, new_fail = backfill_parts(spark, d)
    return B.backfill_report(un, resolved, ckpt.unionByName(new_ok), new_fail)


@query("consolidate", oracle=_w(
    "SELECT movieId, imdbId, title, year, genres, plot_source, CAST(plot_length AS INTEGER) AS plot_length, "
    "md5(plot_text) AS plot_md5 FROM final"))
def consolidate(spark, d):
    f = final_plots(spark, d)
    return f.select("movieId", "imdbId", "title", "year", "genres", "plot_source", "plot_length",
                    F.md5("plot_text").alias("plot_md5"))


@query("coverage_report", oracle=_w(
    "SELECT (SELECT count(*) FROM lk) AS total_movielens_movies, count(*) AS movies_with_plot, "
    "round(count(*) / greatest((SELECT count(*) FROM lk), 1) * 100, 6) AS coverage_pct, "
    "count(*) FILTER (WHERE plot_source = 'wiki_dump') AS from_wiki_dump, "
    "count(*) FILTER (WHERE plot_source = 'wikipedia_api') AS from_wikipedia_api, "
    "(SELECT count(*) FROM lk) - count(*) AS still_missing, "
    "round(((SELECT count(*) FROM lk) - count(*)) / greatest((SELECT count(*) FROM lk), 1) * 100, 6) AS missing_pct FROM final"))
def coverage_report(spark, d):
    r = C.coverage_report(final_plots(spark, d), links(spark, d))
    return r.select("total_movielens_movies", "movies_with_plot", F.round("coverage_pct", 6).alias("coverage_pct"),
                    "from_wiki_dump", "from_wikipedia_api", "still_missing", F.round("missing_pct", 6).alias("missing_pct"))


@query("length_quantiles", oracle=_w(
    "SELECT CAST(coalesce(min(plot_length), 0) AS BIGINT) AS min, "
    "CAST(coalesce(max(plot_length) FILTER (WHERE rk = round((n - 1) * 0.25)), 0) AS BIGINT) AS p25, "
    "CAST(coalesce(trunc((max(plot_length) FILTER (WHERE rk = floor((n - 1) / 2)) + max(plot_length) FILTER (WHERE rk = ceil((n - 1) / 2))) / 2), 0) AS BIGINT) AS median, "
    "CAST(coalesce(max(plot_length) FILTER (WHERE rk = round((n - 1) * 0.75)), 0) AS BIGINT) AS p75, "
    "CAST(coalesce(max(plot_length), 0) AS BIGINT) AS max "
    "FROM (SELECT plot_length, row_number() OVER (ORDER BY plot_length) - 1 AS rk, count(*) OVER () AS n FROM final)"))
def length_quantiles(spark, d):
    return C.length_quantiles(materialize(final_plots(spark, d).select("plot_length")))


@query("value_quantiles", oracle="""
SELECT max(v) FILTER (WHERE rk = 0) AS min, max(v) FILTER (WHERE rk = floor((n - 1) * 0.25 + 0.5)) AS p25,
       (max(v) FILTER (WHERE rk = (n - 1) // 2) + max(v) FILTER (WHERE rk = n // 2)) / 2 AS median,
       max(v) FILTER (WHERE rk = floor((n - 1) * 0.75 + 0.5)) AS p75, max(v) FILTER (WHERE rk = n - 1) AS max
FROM (SELECT CAST(l_extendedprice AS DOUBLE) / (1 + l_orderkey % 1000) AS v, row_number() OVER (ORDER BY CAST(l_extendedprice AS DOUBLE) / (1 + l_orderkey % 1000)) - 1 AS rk,
      count(*) OVER () AS n FROM lineitem)""")
def value_quantiles(spark, d):
    """Exact quantiles of a column of doubles that are nearly all different."""
    v = table(spark, d, "lineitem").select((F.col("l_extendedprice").cast("double") / (F.lit(1) + F.col("l_orderkey") % 1000)).alias("v"))
    return quantile_report(v, "v")


@query("genre_coverage", oracle=_w(
    "SELECT genre, CAST(coalesce((SELECT count(*) FROM final f WHERE regexp_matches(f.genres, v.genre)), 0) AS BIGINT) AS matched, "
    "(SELECT count(*) FROM mv m WHERE regexp_matches(m.genres, v.genre)) AS total, "
    "round(coalesce((SELECT count(*) FROM final f WHERE regexp_matches(f.genres, v.genre)), 0) / "
    "(SELECT count(*) FROM mv m WHERE regexp_matches(m.genres, v.genre)) * 100, 6) AS match_pct "
    "FROM (SELECT DISTINCT unnest(string_split(genres, '|')) AS genre FROM mv WHERE genres IS NOT NULL) v "
    "WHERE genre <> '(no genres listed)' AND (SELECT count(*) FROM mv m WHERE regexp_matches(m.genres, v.genre)) > 0"))
def genre_coverage(spark, d):
    r = C.genre_coverage(final_plots(spark, d), movies_ml(spark, d))
    return r.select("genre", "matched", "total", F.round("match_pct", 6).alias("match_pct"))


@query("no_plot_movies", oracle=_w(
    f"SELECT l.imdbId, {NAME_SQL('mv.title')} AS title, {YEAR_SQL('mv.title')} AS year, mv.genres "
    "FROM lkn l LEFT JOIN mv USING (movieId) WHERE l.imdbId IS NOT NULL AND l.imdbId NOT IN (SELECT imdbId FROM final)"))
def no_plot_movies(spark, d):
    return C.no_plot_movies(links(spark, d), movies_ml(spark, d), final_plots(spark, d))
