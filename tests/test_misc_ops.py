from pyspark.sql import functions as F

from sparkrec.functions.vectors import dot
from sparkrec.operators import bridge as B
from sparkrec.operators import graduation as G


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([0.5, -1.0, 2.0], [2.0, 2.0, 2.0])],
                               "a array<double>, b array<double>")
    assert [r.j for r in df.select(dot("a", "b").alias("j")).collect()] == [32.0, 3.0]


def test_alpha_modes(spark):
    from sparkrec.config import Config
    from sparkrec.functions.scoring import compute_alpha

    df = spark.createDataFrame([("a b", True), (None, True)], "q string, p boolean")
    fixed = compute_alpha("q", "p", Config(alpha_mode="fixed", alpha_fixed=0.4))
    assert [r[0] for r in df.select(fixed).collect()] == [0.4, 0.2]


def test_mark_retrained_moves_rows(spark):
    pending = spark.createDataFrame([("a", "2024-01-01", 5), ("b", "2024-01-02", 7)],
                                    "movie_id string, graduated_at string, interaction_count long")
    done = spark.createDataFrame([("a",), ("zzz",)], "movie_id string")
    still, completed = G.mark_retrained(pending, done, batch_id="b1", retrained_at="2024-02-01")
    assert [r.movie_id for r in still.collect()] == ["b"]
    c = completed.collect()
    assert [(r.movie_id, r.batch, r.retrained_at) for r in c] == [("a", "b1", "2024-02-01")]


def test_knowledge_base_lookups(spark):
    sitelinks = spark.createDataFrame(
        [("Q1", "Film A", "enwiki"), ("Q2", "Person B", "enwiki"), ("Q3", "Film C", "dewiki"), ("Q4", "Film D", "enwiki")],
        "item string, title string, wiki string")
    statements = spark.createDataFrame(
        [("Q1", "P31", "Q11424"), ("Q1", "P31", "Q24856"), ("Q2", "P31", "Q5"), ("Q3", "P31", "Q11424"),
         ("Q1", "P345", "tt0000001"), ("Q4", "P345", "tt0000001"), ("Q2", "P345", "nm0000002")],
        "item string, prop string, value string")
    titles = {r.wiki_title for r in B.kb_class_titles(sitelinks, statements).collect()}
    assert titles == {"Film A"}  # distinct, enwiki only, film/TV classes only
    bridge = B.kb_id_bridge(sitelinks, statements)
    assert bridge.count() == 3  # duplicates kept
    ids = spark.createDataFrame([("tt0000001",), ("tt0000001",), ("tt9",)], "imdbId string")
    got = {r.imdbId: r.wiki_title for r in B.kb_id_lookup(ids, bridge).collect()}
    assert got == {"tt0000001": "Film D"}  # one title per id ("last" = greatest)
    plots = spark.createDataFrame([("Film A", "x"), ("Film D", "y")], "wiki_title string, plot_text string")
    assert [r.wiki_title for r in B.title_semi_filter(plots, B.kb_class_titles(sitelinks, statements)).collect()] == ["Film A"]


def test_mark_retrained_does_every_closed_week(spark, monkeypatch):
    from sparkrec.plans import q_state, registry

    rows = [(4, "2024-01-02", 50), (5, "2024-01-07", 51), (6, "2024-01-10", 52), (8, "2024-01-16", 60)]
    monkeypatch.setattr(q_state, "pending", lambda s, d: s.createDataFrame(rows, "movie_id long, graduated_at string, interaction_count long"))
    registry.load_all()
    got = {r.movie_id: (r.status, r.batch, r.retrained_at, r.interaction_count) for r in registry.QUERIES["mark_retrained"](spark, "").collect()}
    assert got == {4: ("completed", "batch-2024-01-01", "2024-01-08", 50), 5: ("completed", "batch-2024-01-01", "2024-01-08", 51),
                   6: ("completed", "batch-2024-01-08", "2024-01-15", 52), 8: ("pending", None, None, 60)}
