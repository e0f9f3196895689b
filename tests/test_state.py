import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sparkrec.operators import fold as FO
from sparkrec.operators import graduation as G
from sparkrec.operators.profile import mood_asof

T0 = dt.datetime(2024, 1, 1)


def _ref_profile(events, decay=0.95, lr0=0.1):
    v, n = None, 0
    for w, e in events:
        x = w * np.asarray(e, dtype=np.float64)
        if v is None:
            nr = np.linalg.norm(x)
            v = x / nr if nr > 0 else x
        else:
            v = decay * v + lr0 / (1 + 0.01 * n) * x
            nr = np.linalg.norm(v)
            v = v / nr if nr > 0 else v
        n += 1
    return v, n


def test_profile_fold_matches_loop(spark):
    rng = np.random.default_rng(1)
    rows, per_user = [], {}
    for u in range(3):
        for i in range(7):
            e = rng.normal(size=4).tolist()
            w = float(rng.integers(-2, 3))
            rows.append((u, i, T0 + dt.timedelta(minutes=i), w, e))
            per_user.setdefault(u, []).append((w, e))
    df = spark.createDataFrame(rows, "user_id long, k long, ts timestamp, weight double, embedding array<double>")
    got = {r.user_id: r for r in FO.profile_from_ratings(df, order=["ts", "k"]).collect()}
    for u, evs in per_user.items():
        v, n = _ref_profile(evs)
        assert got[u].interaction_count == n
        assert np.allclose(got[u].profile_vec, v, atol=1e-12)


def test_profile_direction(spark):
    # e0 w=2, e1 w=1, e0 w=-2 -> component 0 falls
    e0, e1 = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, 0, T0, 2.0, e0), (1, 1, T0 + dt.timedelta(seconds=1), 1.0, e1)],
                               "user_id long, k long, ts timestamp, weight double, embedding array<double>")
    before = FO.profile_from_ratings(df, order=["ts", "k"]).first().profile_vec
    df2 = df.unionByName(spark.createDataFrame([(1, 2, T0 + dt.timedelta(seconds=2), -2.0, e0)], df.schema))
    after = FO.profile_from_ratings(df2, order=["ts", "k"]).first().profile_vec
    assert after[0] < before[0] and before[0] > 0 and before[1] > 0


def test_mood_ttl_boundary_and_asof(spark):
    m = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    rows = [(7, 1, T0, m[0]), (7, 2, T0 + dt.timedelta(seconds=1799), m[1]),
            (7, 3, T0 + dt.timedelta(seconds=1799 + 1800), m[2])]  # exactly 1800 s later: expired
    msgs = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, mood_vec array<double>")
    st = {r.event_id: r for r in FO.mood_states(msgs, order=["ts", "event_id"]).collect()}
    assert st[2].chain_len == 2 and np.allclose(st[2].mood_vec, [0.7 * 0 + 0.3 * 1, 0.7])
    assert st[3].chain_len == 1 and st[3].mood_vec == [1.0, 1.0]
    moods = FO.mood_states(msgs, order=["ts", "event_id"])
    fb = spark.createDataFrame(
        [(7, 10, T0 + dt.timedelta(seconds=1799)),  # same instant as mood 2 -> sees it
         (7, 11, T0 + dt.timedelta(seconds=1799 + 1799)),  # 1799 s after mood 2, before mood 3 -> live
         (7, 12, T0 + dt.timedelta(hours=5))],  # long after -> none
        "session_id long, event_id long, ts timestamp")
    got = {r.event_id: r.mood_event_id for r in mood_asof(fb, moods).collect()}
    assert got == {10: 2, 11: 2, 12: None}


def test_graduation_threshold_and_catalog(spark):
    rows = [("m1", T0 + dt.timedelta(days=i)) for i in range(5)] + [("cat", T0)] * 5
    df = spark.createDataFrame(rows, "movie_id string, ts timestamp")
    catalog = spark.createDataFrame([("cat",)], "movie_id string")
    got = G.graduations(df, catalog, order=["ts"], threshold=3).collect()
    assert [(r.movie_id, r.graduated_at, r.interaction_count) for r in got] == [("m1", "2024-01-03", 5)]
    sig = G.retrain_signal(G.graduations(df, catalog, order=["ts"], threshold=1), 1).first()
    assert sig.pending_count == 1 and sig.should_retrain


def test_asof_does_not_depend_on_input_order(spark):
    moods = [(7, 5, T0, [1.0, 0.0]), (7, 6, T0, [0.0, 1.0])]
    fb = spark.createDataFrame([(7, 10, T0)], "session_id long, event_id long, ts timestamp")
    for rows in (moods, moods[::-1]):
        m = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, mood_vec array<double>")
        assert mood_asof(fb, m).first().mood_event_id == 6


def test_long_mood_chain_equals_the_loop(spark):
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(200, 3))
    rows = [(1, i, T0 + dt.timedelta(seconds=60 * i), vecs[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, mood_vec array<double>")
    got = {r.event_id: r for r in FO.mood_states(df, order=["ts", "event_id"]).collect()}
    v = None
    for i in range(200):
        v = vecs[i] if v is None else 0.7 * vecs[i] + 0.3 * v
        assert got[i].chain_len == i + 1 and np.allclose(got[i].mood_vec, v, atol=1e-14)
