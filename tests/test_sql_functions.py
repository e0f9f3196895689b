from sparkrec.functions.sql import register_sql_functions


def test_sql_functions_match_column_api(spark):
    register_sql_functions(spark)
    r = spark.sql(
        "SELECT normalize_imdb_id('114709') AS a, title_year('Toy Story (1995)') AS b, title_name(' Jumanji ') AS c, "
        "title_year('Jumanji') AS d, word_count('a b  c') AS e, space_token_count('a  b ') AS f, "
        "compute_alpha(NULL, true) AS g, compute_alpha('', false) AS h, vec_dot(array(1D, 2D), array(3D, 4D)) AS i"
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == ("tt0114709", 1995, "Jumanji", None, 3, 4, 0.2, 0.3, 11.0)


def test_failure_reasons(spark):
    from sparkrec.plans.q_text import classify_responses

    df = spark.createDataFrame(
        [("a", 200, None, "ClientConnectorError"), ("b", 429, None, None), ("c", 500, None, None),
         ("d", 200, '{"error": {"info": "x"}}', None), ("e", 200, '{"error": {"code": "missingtitle"}}', None),
         ("f", 200, '{"parse": {"wikitext": {"*": "== Cast ==\\nx"}}}', None),
         ("g", 200, '{"parse": {"wikitext": {"*": "== Plot ==\\nA plot."}}}', None)],
        "wiki_title string, status int, body string, error_type string")
    got = {r.wiki_title: (r.failure_reason, r.plot_text) for r in classify_responses(df).collect()}
    assert got == {"a": ("network_error: ClientConnectorError", None), "b": ("max_retries", None),
                   "c": ("http_500", None), "d": ("api_error", None), "e": ("missingtitle", None),
                   "f": ("no_plot_section", None), "g": (None, "A plot.")}


def test_plots_metadata_intent_and_failures_equal_the_columns(spark):
    import json

    from sparkrec.functions import text as T
    from sparkrec.operators.bridge import classify_responses

    register_sql_functions(spark)
    articles = ["Intro\n== Plot ==\nA [[hero|brave [[x|man]]]] {{t|{{u}}}} goes ''home''.<ref name=a>r</ref>\n== Cast ==\nz", "== Synopsis ==\n\n== Plot ==\nlater", "no section", "", None,
                "== plot summary == <!-- c -->\n=== Act ===\nText [[a]] {{b", "== Plot ==\n[[" * 3 + "]]" + "\x01 {{x}}"]
    df = spark.createDataFrame([(a,) for a in articles], "x string")
    df.createOrReplaceTempView("sql_articles")
    want = df.select("x", T.plot_section("x").alias("a"), T.plot_from_api("x").alias("b"), T.clean_wikitext("x").alias("c")).collect()
    assert spark.sql("SELECT x, plot_section(x) AS a, plot_from_api(x) AS b, clean_wikitext(x) AS c FROM sql_articles").collect() == want
    assert want[0]["a"] == "A brave man  goes home."
    ok = json.dumps({"parse": {"wikitext": {"*": "== Plot ==\nA plot"}}})
    bodies = [(200, ok, None), (200, json.dumps({"parse": {"wikitext": {"*": "none"}}}), None), (503, None, None), (429, None, None), (200, "no json", None), (None, None, "Timeout"),
              (200, json.dumps({"error": {"code": "missingtitle"}}), None), (200, json.dumps({"error": {}}), None), (200, "{}", None)]
    r = spark.createDataFrame([(str(i), *b) for i, b in enumerate(bodies)], "wiki_title string, status int, body string, error_type string")
    r.createOrReplaceTempView("sql_responses")
    want = {x["wiki_title"]: x["failure_reason"] for x in classify_responses(r).collect()}
    assert {x[0]: x[1] for x in spark.sql("SELECT wiki_title, response_failure(status, body, error_type) FROM sql_responses").collect()} == want
    meta = spark.createDataFrame([("p", "Drama|Animation", 1999, "T"), ("p", "", None, ""), ("p", None, 5, None)], "plot string, genres string, year int, title string")
    meta.createOrReplaceTempView("sql_meta")
    want = [x[0] for x in meta.select(T.prepend_metadata("plot", T.media_type("genres"), "genres", "year", "title")).collect()]
    assert [x[0] for x in spark.sql("SELECT prepend_metadata(plot, media_type(genres), genres, year, title) FROM sql_meta").collect()] == want
    asked = spark.createDataFrame([("A cozy old love story under 90 for kids",), ("epic R-rated sci-fi",), ("",), (None,)], "x string")
    asked.createOrReplaceTempView("sql_asked")
    want = [x[0] for x in asked.select(T.parse_intent("x")).collect()]
    assert [x[0] for x in spark.sql("SELECT parse_intent(x) FROM sql_asked").collect()] == want
