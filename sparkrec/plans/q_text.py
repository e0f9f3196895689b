"""Text queries: ids, titles, word counts, wikitext, intent, API responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.bridge import classify_responses
from ..operators.dictionary import dictionary_table, match_dictionary
from ..sources.tables import table
from . import standins as S
from .registry import query

# Raw id forms of the links table: four spellings over growing numbers.
RAW_IMDB_SQL = (
    "SELECT p_partkey AS movie_id, CASE p_type "
    "WHEN 'ECONOMY' THEN 'tt' || CAST(p_partkey * 7919 AS VARCHAR) "
    "WHEN 'STANDARD' THEN 't' || CAST(p_partkey * 7919 AS VARCHAR) "
    "WHEN 'SMALL' THEN lpad(CAST(p_partkey * 7919 AS VARCHAR), 7, '0') "
    "ELSE CAST(p_partkey * 7919 AS VARCHAR) END AS raw_id FROM part"
)


def raw_imdb(spark, d):
    p = table(spark, d, "part")
    n = (F.col("p_partkey") * 7919).cast("string")
    raw = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("tt"), n))
        .when(F.col("p_type") == "STANDARD", F.concat(F.lit("t"), n))
        .when(F.col("p_type") == "SMALL", F.lpad(n, 7, "0"))
        .otherwise(n)
    )
    return p.select(F.col("p_partkey").alias("movie_id"), raw.alias("raw_id"))


@query(
    "imdb_normalize",
    oracle=f"""
WITH r AS ({RAW_IMDB_SQL}), x AS (SELECT movie_id, raw_id, regexp_replace(raw_id, '^t+', '') AS n FROM r)
SELECT movie_id, raw_id, 'tt' || CASE WHEN length(n) < 7 THEN lpad(n, 7, '0') ELSE n END AS imdb_id FROM x
""",
)
def imdb_normalize(spark, d):
    return raw_imdb(spark, d).select("movie_id", "raw_id", T.normalize_imdb_id("raw_id").alias("imdb_id"))


_TY = r"^(.+?)\s*\((\d{4})\)\s*$"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    "title_year_parse",
    oracle=f"""
WITH m AS ({S.MOVIES_SQL})
SELECT movie_id, title,
  CASE WHEN regexp_matches(title, '{_TY}') THEN {_STRIP.format(f"regexp_extract(title, '{_TY}', 1)")}
       ELSE {_STRIP.format('title')} END AS name,
  TRY_CAST(nullif(regexp_extract(title, '{_TY}', 2), '') AS INTEGER) AS year
FROM m
""",
)
def title_year_parse(spark, d):
    m = S.movies(spark, d)
    return m.select("movie_id", "title", T.title_name("title").alias("name"), T.title_year("title").alias("year"))


_WC = "CAST(len(regexp_extract_all(text, '[^\\s]+')) AS INTEGER)"


@query("plot_min_words", oracle=f"SELECT doc_id, {_WC} AS n_words FROM documents WHERE {_WC} >= 20")
def plot_min_words(spark, d):
    """Plots with at least 20 whitespace-separated words."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.word_count("text").alias("n_words")).where(F.col("n_words") >= 20)


@query("short_plots", oracle=f"SELECT doc_id, {_WC} AS n_words FROM documents WHERE {_WC} < 50")
def short_plots(spark, d):
    """Short-plot report: fewer than 50 words."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.word_count("text").alias("n_words")).where(F.col("n_words") < 50)


@query(
    "prepend_metadata",
    oracle=f"""
WITH m AS ({S.MOVIES_SQL}),
p AS (SELECT m.movie_id, m.genres,
        CASE WHEN regexp_matches(title, '{_TY}') THEN {_STRIP.format(f"regexp_extract(title, '{_TY}', 1)")}
             ELSE {_STRIP.format('title')} END AS name,
        TRY_CAST(nullif(regexp_extract(title, '{_TY}', 2), '') AS INTEGER) AS year, d.text
      FROM m JOIN documents d ON d.doc_id = m.movie_id)
SELECT movie_id,
  concat_ws('. ', CASE WHEN contains(genres, 'Animation') THEN 'Animated Film' ELSE 'Film' END,
            nullif(genres, ''), CAST(year AS VARCHAR), nullif(name, '')) || '. ' || text AS encoder_text
FROM p
""",
)
def prepend_metadata(spark, d):
    """Encoder input text ``type. genres. year. title. plot`` for every movie
    with a plot (documents stand in for plots, doc_id = movie_id)."""
    m = S.movies(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("movie_id"), "text")
    p = m.join(docs, "movie_id").select(
        "movie_id", "genres", T.title_name("title").alias("name"), T.title_year("title").alias("year"), "text"
    )
    enc = T.prepend_metadata("text", T.media_type("genres"), "genres", "year", "name")
    return p.select("movie_id", enc.alias("encoder_text"))


def _cat_sql(kw: dict) -> str:
    parts = []
    for cat, words in kw.items():
        cond = " OR ".join(f"contains(t, '{w}')" for w in words)
        parts.append(f"CASE WHEN {cond} THEN '{cat}' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


def _any_sql(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query(
    "intent_parse",
    oracle=f"""
WITH u AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn,
  {_cat_sql(T.MOOD_KEYWORDS)} AS mood,
  {_cat_sql(T.GENRE_KEYWORDS)} AS genre,
  {_cat_sql(T.ERA_KEYWORDS)} AS era,
  CASE WHEN {_any_sql(T.MAX_DURATION_WORDS)} THEN 90 END AS max_duration,
  CASE WHEN {_any_sql(T.MIN_DURATION_WORDS)} THEN 120 END AS min_duration,
  CASE WHEN {_any_sql(T.FAMILY_WORDS)} THEN true END AS family_friendly,
  CASE WHEN {_any_sql(T.MATURE_WORDS)} THEN true END AS mature_only
FROM u
""",
)
def intent_parse(spark, d):
    """Intent of every user chat turn (categories as comma lists)."""
    conv = table(spark, d, "conversations").where(F.col("role") == "user")
    p = conv.select("conv_id", "turn", T.parse_intent("text").alias("i"))
    return p.select(
        "conv_id",
        "turn",
        F.array_join("i.mood", ",").alias("mood"),
        F.array_join("i.genre", ",").alias("genre"),
        F.array_join("i.era", ",").alias("era"),
        F.col("i.constraints.max_duration").alias("max_duration"),
        F.col("i.constraints.min_duration").alias("min_duration"),
        F.col("i.constraints.family_friendly").alias("family_friendly"),
        F.col("i.constraints.mature_only").alias("mature_only"),
    )


@query("intent_dictionary", oracle=f"""
WITH u AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_cat_sql(T.MOOD_KEYWORDS)} AS mood, {_cat_sql(T.GENRE_KEYWORDS)} AS genre, {_cat_sql(T.ERA_KEYWORDS)} AS era FROM u""")
def intent_dictionary(spark, d):
    """Categories of every user chat turn with the dictionaries as tables (gram join)."""
    conv = table(spark, d, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    kinds = {"mood": T.MOOD_KEYWORDS, "genre": T.GENRE_KEYWORDS, "era": T.ERA_KEYWORDS}
    tables_ = [dictionary_table(spark, k, v) for k, v in kinds.items()]
    found = match_dictionary(conv, tables_[0].unionByName(tables_[1]).unionByName(tables_[2]))
    wide = found.groupBy("text").agg(*[F.max(F.when(F.col("kind") == k, F.array_join("categories", ","))).alias(k) for k in kinds])
    joined = conv.join(wide, "text", "left")
    return joined.select("conv_id", "turn", *[F.when(F.col("text").isNotNull(), F.coalesce(k, F.lit(""))).alias(k) for k in kinds])


_CLEAN_SQL = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "regexp_replace(regexp_replace(html, '(?s)<ref[^>]*>.*?</ref>', '', 'g'), '<ref[^/]*/\\s*>', '', 'g'),"
    " '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g'),"
    " '\\[\\[[^\\[\\]|]*\\|([^\\[\\]]+)\\]\\]', '\\1', 'g'), '\\[\\[([^\\[\\]|]*)\\|?\\]\\]', '\\1', 'g'),"
    " '<[^>]+>', '', 'g'), '''''''', '', 'g'), '''''', '', 'g')"
)


@query(
    "clean_markup",
    oracle=f"SELECT page_id, md5(c) AS text_md5, CAST(length(c) AS INTEGER) AS n_chars FROM "
    f"(SELECT page_id, {_CLEAN_SQL.format()} AS c FROM pages)",
)
def clean_markup(spark, d):
    """Markup cleaning over every raw page (tags, refs, templates, links, quotes)."""
    pages = table(spark, d, "pages")
    c = T.clean_wikitext("html")
    return pages.select("page_id", c.alias("c")).select(
        "page_id", F.md5("c").alias("text_md5"), F.length("c").alias("n_chars")
    )


# What is left of a plot body of :func:`wiki_articles`: its "{{open ... }}" is a
# template over the sub-section, whose heading line goes first; "{ ]]" stays.
PLOT_BODY = "'Lead ' || source || ' ' || text || ' { ]]'"
PLOT_WORDS = f"CAST(len(regexp_extract_all({PLOT_BODY}, '[^\\s]+')) AS INTEGER)"


def wiki_articles(spark, d):
    """Documents as article wikitext: several sections, the plot heading by
    language (en Plot with a comment behind it, de Plot summary, fr Synopsis, es
    none), and in every body references, templates and links nested to a depth
    that grows with the document id, quotes, tags and a sub-section."""
    docs = table(spark, d, "documents")
    heading = (
        F.when(F.col("lang") == "en", "== Plot == <!-- checked -->\n")
        .when(F.col("lang") == "de", "==Plot summary==\n")
        .when(F.col("lang") == "fr", "== SYNOPSIS ==\t\n")
        .otherwise("== Reception ==\n")
    )
    depth = (F.pmod("doc_id", F.lit(20)) + 1).cast("int")
    nested = F.concat(F.repeat(F.lit("{{t|"), depth), "source", F.repeat(F.lit("}}"), depth))
    links = F.concat(F.repeat(F.lit("[[p|"), depth), "source", F.repeat(F.lit("]]"), depth))
    body = F.concat(F.lit("'''Lead''' "), nested, links, F.lit("<ref name=\"r\">note {{x}}</ref> <ref name=r /><br>"), "text",
                    F.lit(" {{open [[Page]] [[Page|]] ''end''\n=== Sub ===\nmore }}{ ]]\n"))
    return docs.select(
        "doc_id", F.concat(F.lit("Intro {{Infobox|a={{b}}}}.\n\n== Cast ==\n* [[A|B]]\n\n"), heading, body, F.lit("\n== Production ==\nNot plot.\n")).alias("wikitext"), "lang"
    )


@query(
    "plot_section",
    oracle=f"""SELECT doc_id,
  CASE WHEN lang IN ('en', 'de', 'fr') THEN md5({PLOT_BODY}) END AS plot_md5,
  CASE WHEN lang IN ('en', 'de', 'fr') THEN {PLOT_WORDS} END AS n_words
FROM documents""",
)
def plot_section(spark, d):
    """Plot section of every article; rows without one are kept with null."""
    a = T.with_plot_section(wiki_articles(spark, d), "wikitext", "p", from_api=True)
    return a.select("doc_id", F.md5("p").alias("plot_md5"), T.word_count("p").alias("n_words"))


def api_responses(spark, d):
    """Saved article-API responses, one per document: en -> wikitext with a plot
    section, fr -> wikitext without one, de -> API error, es -> HTTP 503."""
    docs = table(spark, d, "documents")
    ok_body = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.concat(
                        F.when(F.col("lang") == "en", F.lit("== Plot ==<!-- x -->\n{{a|{{b}}}}")).otherwise(F.lit("== Reception ==\n")),
                        F.col("text"),
                    ).alias("*")
                ).alias("wikitext")
            ).alias("parse")
        )
    )
    err_body = F.to_json(F.struct(F.struct(F.lit("missingtitle").alias("code")).alias("error")))
    status = F.when(F.col("lang") == "es", F.lit(503)).otherwise(F.lit(200))
    body = F.when(F.col("lang") == "es", F.lit(None)).when(F.col("lang") == "de", err_body).otherwise(ok_body)
    return docs.select(
        F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("wiki_title"),
        status.alias("status"),
        body.alias("body"),
    )


@query(
    "api_response_classify",
    oracle="""
SELECT failure_reason, count(*) AS n FROM (
  SELECT CASE lang WHEN 'es' THEN 'http_503' WHEN 'de' THEN 'missingtitle'
         WHEN 'fr' THEN 'no_plot_section'
         ELSE CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'no_plot_section' END END
         AS failure_reason
  FROM documents) WHERE failure_reason IS NOT NULL GROUP BY failure_reason
""",
)
def api_response_classify(spark, d):
    """Failure-reason histogram of the saved API responses."""
    c = classify_responses(api_responses(spark, d))
    return c.where(F.col("failure_reason").isNotNull()).groupBy("failure_reason").agg(F.count("*").alias("n"))
