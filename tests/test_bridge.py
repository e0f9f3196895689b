from pyspark.sql import functions as F

from sparkrec.operators import bridge as B
from sparkrec.operators import consolidate as C


def test_bridge_join_fixture(spark):
    plots = spark.createDataFrame([("Toy Story", "tt0114709", "plot a"), ("Unknown Film", "tt9999999", "plot b")],
                                  "wiki_title string, imdbId string, plot_text string")
    links = spark.createDataFrame([(1, "tt0114709", 862), (2, "tt0113497", 680)], "movieId long, imdbId string, tmdbId long")
    movies = spark.createDataFrame([(1, "Toy Story (1995)", "A|B|C"), (2, "Jumanji (1995)", "A|B")],
                                   "movieId long, title string, genres string")
    got = B.join_with_catalog(plots, links, movies).collect()
    assert [(r.movieId, r.imdbId, r.title, r.year) for r in got] == [(1, "tt0114709", "Toy Story", 1995)]


def test_unmatched_drops_null_ids(spark):
    links = spark.createDataFrame([(1, "1"), (2, None), (3, "3")], "movieId long, imdbId string")
    matched = spark.createDataFrame([("tt0000001",), (None,)], "imdbId string")
    movies = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "movieId long, title string, genres string")
    got = sorted(r.movieId for r in B.unmatched_movies(links, matched, movies).collect())
    assert got == [3]


def test_consolidate_prefers_dump(spark):
    cols = "movieId long, imdbId string, title string, year int, plot_text string, genres string"
    dump = spark.createDataFrame([(1, "tt1", "A", 2000, "dump plot", "G"), (2, "tt2", "B", 2001, "b  c ", "G")], cols)
    back = spark.createDataFrame([(1, "tt1", "A", None, "api plot", "G"), (3, "tt3", "C", None, "x", "G")], cols)
    got = {r.movieId: r for r in C.consolidate(dump, back).collect()}
    assert got[1].plot_source == "wiki_dump" and got[1].plot_text == "dump plot"
    assert got[3].plot_source == "wikipedia_api"
    assert got[2].plot_length == 4  # single-space tokens, empties counted


def test_length_quantiles_nearest_and_median(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4]], "plot_length int")
    r = C.length_quantiles(df).first()
    # n=4: p25 -> rank round(0.75)=1 -> 2; median (2+3)/2 -> 2 (truncated); p75 -> round(2.25)=2 -> 3
    assert (r["min"], r["p25"], r["median"], r["p75"], r["max"]) == (1, 2, 2, 3, 4)
    empty = C.length_quantiles(df.where("plot_length > 10")).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)


def test_no_plot_sorted_year_desc_nulls_first(spark):
    links = spark.createDataFrame([(1, "1"), (2, "2"), (3, "3")], "movieId long, imdbId string")
    movies = spark.createDataFrame([(1, "A (1990)", "x"), (2, "B", "y"), (3, "C (2000)", "z")],
                                   "movieId long, title string, genres string")
    final = spark.createDataFrame([("tt9999999",)], "imdbId string")
    got = [r.year for r in C.no_plot_movies(links, movies, final).collect()]
    assert got == [None, 2000, 1990]


def test_extraction_is_written_before_any_filter(spark, monkeypatch):
    """The section regex stands once in the plan of the stage, however often its parts are read."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(B, "materialize", seen)
    body = " ".join(f"w{i}" for i in range(25))
    rows = [("a", f"x\n== Plot ==\n{body} {{{{t|{{{{u}}}}}}}} [[p|[[q|z]]]]\n"), ("b", "== Plot ==\nshort\n"), ("c", f"== Cast ==\n{body}\n"), ("d", None)]
    got = B.extract_plots(spark.createDataFrame(rows, "wiki_title string, wikitext string")).collect()
    assert [(r.wiki_title, r.plot_text) for r in got] == [("a", body + "  z")]
    assert len(plans) == 1 and plans[0].count("plot summary") == 1
