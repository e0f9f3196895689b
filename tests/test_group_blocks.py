import numpy as np

from sparkrec.config import Config
from sparkrec.operators.group_score import group_fairness_scores
from sparkrec.operators.search import ItemTable


def _group(spark, groups=6, n_m=4, n_c=40, dim=6):
    rng = np.random.default_rng(4)
    it = rng.normal(size=(120, dim)).astype(np.float32)
    items = spark.createDataFrame([(i, i, [float(x) for x in v] if i % 9 else None) for i, v in enumerate(it)], "faiss_idx long, movie_id long, embedding array<float>")
    members = [(g, u, 0.4, rng.normal(size=dim).tolist() if u else None, [(int(c), float(rng.normal())) for c in rng.choice(120, 3, False)]) for g in range(groups) for u in range(n_m)]
    cands = [(g, int(c)) for g in range(groups) for c in rng.permutation(130)[:n_c]]
    return (spark.createDataFrame(members, "group_id long, user_id long, alpha double, v array<double>, top array<struct<movie_id: long, score: double>>"),
            spark.createDataFrame(cands, "group_id long, movie_id long"), items)


def _rows(df):
    return sorted((r.group_id, r["rank"], r.movie_id, round(r.score, 9), round(r["std"], 9)) for r in df.collect())


def test_vectors_are_looked_up_where_groups_are_scored(spark):
    """candidates are ids; they gave the same rows when each carried its vector."""
    members, cands, items = _group(spark)
    joined = cands.join(items.selectExpr("movie_id", "embedding AS e"), "movie_id", "left")
    want = _rows(group_fairness_scores(members, joined, 7, fairness_lambda=0.5))
    assert len(want) == 42
    for cfg in (Config(), Config(broadcast_limit_bytes=512, search_send_bytes=512), Config(search_block_bytes=128, search_min_block_rows=4)):
        table = ItemTable(items, ids=["faiss_idx", "movie_id"], config=cfg)
        assert _rows(group_fairness_scores(members, cands, 7, fairness_lambda=0.5, config=cfg, items=table)) == want


def test_small_groups_are_ranked_where_they_are_scored(spark, monkeypatch):
    """of a group of one block only the best leave the task, not a row for each candidate."""
    from sparkrec.operators import group_score

    written = []
    monkeypatch.setattr(group_score, "materialize", lambda df: written.append(df.count()) or df)
    members, cands, items = _group(spark)
    joined = cands.join(items.selectExpr("movie_id", "embedding AS e"), "movie_id", "left")
    assert group_fairness_scores(members, joined, 7, fairness_lambda=0.5).count() == 42
    assert written == [42]
