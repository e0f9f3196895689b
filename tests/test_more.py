import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from sparkrec.config import Config
from sparkrec.operators import consolidate as C
from sparkrec.operators import graduation as G
from sparkrec.operators import index as IX
from sparkrec.operators import sequence as Q


def test_contiguous_index_many_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("movie_id")).repartition(13)
    got = sorted((r.faiss_idx, r.movie_id) for r in IX.contiguous_index(df, ["movie_id"]).collect())
    assert got == [(i, i) for i in range(1000)]


def test_append_rows_continues_index(spark):
    base = spark.createDataFrame([(0, 10), (1, 11)], "faiss_idx long, movie_id long")
    new = spark.createDataFrame([(30,), (20,)], "movie_id long")
    got = sorted((r.faiss_idx, r.movie_id) for r in IX.append_rows(base, new, order=["movie_id"]).collect())
    assert got == [(0, 10), (1, 11), (2, 20), (3, 30)]


def test_genre_coverage_regex_contains(spark):
    movies = spark.createDataFrame(
        [(1, "Brand#2|ECONOMY"), (2, "Brand#23|SMALL"), (3, "(no genres listed)"), (4, None)],
        "movieId long, genres string")
    final = spark.createDataFrame([(2, "Brand#23|SMALL")], "movieId long, genres string")
    got = {r.genre: (r.matched, r.total) for r in C.genre_coverage(final, movies).collect()}
    # substring semantics: Brand#2 also counts Brand#23
    assert got == {"Brand#2": (1, 2), "Brand#23": (1, 1), "ECONOMY": (0, 1), "SMALL": (1, 1)}


def test_weekly_batches(spark):
    p = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-09"), ("c", "2024-01-10")],
                              "movie_id string, graduated_at string")
    got = {r.movie_id: (r.status, r.batch, r.retrained_at) for r in G.weekly_batches(p).collect()}
    assert got["a"] == ("completed", "batch-2024-01-01", "2024-01-08")
    assert got["b"][0] == got["c"][0] == "pending"


def test_training_sequences_window_and_negatives(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(days=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp")
    seqs = {r.pos: r for r in Q.training_sequences(df, order=["ts"], max_len=50).collect()}
    assert seqs[2].item_seq == [0] and seqs[60].item_seq == list(range(9, 59)) and seqs[60].item_seq_len == 50
    neg = Q.sample_negatives(Q.training_sequences(df, order=["ts"]), df, 100).collect()
    assert all(60 <= r.neg_item < 100 for r in neg) and len(neg) == 59


def test_negatives_are_exact(spark):
    # the user owns the first eight candidates of every row, and all items but one
    t0 = dt.datetime(2024, 1, 1)
    have = spark.createDataFrame([(1, i, t0) for i in range(50) if i != 33] + [(2, i, t0) for i in range(50)], "user_id long, item_id long, ts timestamp")
    rows = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "user_id long, pos long")
    got = {(r.user_id, r.pos): r.neg_item for r in Q.sample_negatives(rows, have, 50).collect()}
    assert got == {(1, 2): 33, (1, 3): 33, (2, 2): None}


def test_ranking_metrics_values(spark):
    topk = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 8, 2)], "user_id long, movie_id long, rank int")
    tgt = spark.createDataFrame([(1, 6), (2, 9)], "user_id long, movie_id long")
    r = Q.ranking_metrics(topk, tgt, 10).first()
    assert r.n_users == 2 and r.hit_at_10 == 0.5
    assert math.isclose(r.ndcg_at_10, 0.5 / math.log2(3)) and math.isclose(r.mrr_at_10, 0.25)


def test_logsumexp_matches_numpy(spark):
    rng = np.random.default_rng(4)
    q, it = rng.normal(size=(9, 5)), rng.normal(size=(23, 5)) * 3
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(9)], "user_id long, user_vec array<double>")
    idf = spark.createDataFrame([(j, it[j].tolist()) for j in range(23)], "movie_id long, embedding array<double>")
    cfg = Config(search_block_bytes=5 * 8 * 4, broadcast_limit_bytes=0)  # several blocks per side
    got = {r.user_id: r.lse for r in Q.logsumexp_scores(qdf, idf, config=cfg).collect()}
    assert got.keys() == {r.user_id for r in Q.logsumexp_scores(qdf, idf).collect()}
    s = q @ it.T
    want = s.max(1) + np.log(np.exp(s - s.max(1, keepdims=True)).sum(1))
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(9))
