"""Batch and stream forms must agree (input split over several files, one
file per micro-batch, ``availableNow`` trigger, bounded waits)."""

import datetime as dt
import tempfile

import numpy as np
from pyspark.sql import functions as F

from sparkrec.operators import fold as FO
from sparkrec.operators import graduation as G
from sparkrec.operators.profile import mood_asof
from sparkrec.streaming import stateful as ST

T0 = dt.datetime(2024, 1, 1)


def _write_chunks(df, order_col, n_chunks, base):
    rows = df.orderBy(order_col).collect()
    size = max(1, len(rows) // n_chunks + 1)
    for i in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(base)


def _run(spark, sdf, name):
    q = (sdf.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", ST.checkpoint_location(spark, name + "_" + str(id(sdf))))
         .trigger(availableNow=True).start())
    assert q.awaitTermination(240), "stream did not finish in time"
    return spark.table(name)


def test_graduation_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="sr-grad-")
    rows = [(f"m{i % 4}", T0 + dt.timedelta(hours=i), i) for i in range(40)]
    df = spark.createDataFrame(rows, "movie_id string, ts timestamp, k long")
    _write_chunks(df, "ts", 4, base + "/in")
    catalog = spark.createDataFrame([("m3",)], "movie_id string")
    stream = ST.graduation_stream(ST.read_interactions(spark, base + "/in", "movie_id string, ts timestamp, k long",
                                                       max_files_per_trigger=1), catalog, order=["ts", "k"], threshold=4)
    got = {(r.movie_id, r.graduated_at) for r in _run(spark, stream, "grad_s").collect()}
    want = {(r.movie_id, r.graduated_at) for r in G.graduations(df, catalog, order=["ts", "k"], threshold=4).collect()}
    assert got == want and len(want) == 3


def test_mood_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="sr-mood-")
    rng = np.random.default_rng(0)
    rows, t = [], T0
    for i in range(30):
        t = t + dt.timedelta(seconds=int(rng.choice([600, 1799, 1800, 4000])))
        rows.append((i % 2, i, t, rng.normal(size=3).tolist()))
    df = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, mood_vec array<double>")
    _write_chunks(df, "ts", 3, base + "/in")
    src = ST.read_interactions(spark, base + "/in", "session_id long, event_id long, ts timestamp, mood_vec array<double>",
                               max_files_per_trigger=1)
    got = {r.event_id: r for r in _run(spark, ST.mood_stream(src, watermark="1 day"), "mood_s").collect()}
    want = {r.event_id: r for r in FO.mood_states(df, order=["ts", "event_id"]).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k].chain_len == want[k].chain_len
        assert np.allclose(got[k].mood_vec, want[k].mood_vec)


def test_profile_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="sr-prof-")
    rng = np.random.default_rng(2)
    rows = [(i % 3, i, T0 + dt.timedelta(minutes=i), float(rng.integers(-2, 3)), rng.normal(size=4).tolist())
            for i in range(36)]
    schema = "user_id long, k long, ts timestamp, weight double, embedding array<double>"
    df = spark.createDataFrame(rows, schema)
    _write_chunks(df, "ts", 3, base + "/in")
    src = ST.read_interactions(spark, base + "/in", schema, max_files_per_trigger=1)
    out = _run(spark, ST.profile_stream(src, order=["ts", "k"]), "prof_s")
    last = {r.user_id: r for r in out.collect() if True}
    latest = {}
    for r in out.collect():
        if r.user_id not in latest or r.interaction_count > latest[r.user_id].interaction_count:
            latest[r.user_id] = r
    want = {r.user_id: r for r in FO.profile_from_ratings(df, order=["ts", "k"]).collect()}
    assert set(latest) == set(want) == set(last)
    for u in want:
        assert latest[u].interaction_count == want[u].interaction_count
        assert np.allclose(latest[u].profile_vec, want[u].profile_vec, atol=1e-12)


def test_retrain_monitor_foreach_batch(spark):
    base = tempfile.mkdtemp(prefix="sr-retrain-")
    rows = [(f"m{i % 5}", T0 + dt.timedelta(hours=i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "movie_id string, ts timestamp, k long")
    _write_chunks(df, "ts", 3, base + "/in")
    catalog = spark.createDataFrame([("none",)], "movie_id string")
    grads = ST.graduation_stream(ST.read_interactions(spark, base + "/in", "movie_id string, ts timestamp, k long",
                                                      max_files_per_trigger=1), catalog, order=["ts", "k"], threshold=3)
    sink = ST.retrain_monitor(grads, base + "/pending", base + "/signal", n=4)
    q = (grads.writeStream.foreachBatch(sink).option("checkpointLocation", ST.checkpoint_location(spark, "retrain_" + base[-6:]))
         .trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    pending = {r.movie_id for r in spark.read.parquet(base + "/pending").collect()}
    assert pending == {f"m{i}" for i in range(5)}
    sig = spark.read.parquet(base + "/signal").first()
    assert sig.pending_count == 5 and sig.should_retrain
    # a replayed epoch changes nothing; completed movies no longer count
    rows = [r.asDict() for r in spark.read.parquet(base + "/pending/epoch=0").collect()]
    one = spark.createDataFrame([tuple(r.values()) for r in rows], "movie_id string, graduated_at string, interaction_count long")
    sink(one, 0)
    assert spark.read.parquet(base + "/signal").first().pending_count == 5
    spark.createDataFrame([("m0",)], "movie_id string").write.parquet(base + "/completed")
    ST.retrain_monitor(grads, base + "/pending", base + "/signal", n=5, completed_path=base + "/completed")(one, 0)
    sig = spark.read.parquet(base + "/signal").first()
    assert sig.pending_count == 4 and not sig.should_retrain


EVENTS = "user_id long, session_id string, event_id long, ts timestamp, mood_vec array<double>, feedback double"


def _two_kinds(n=400, users=2):
    rng, rows, t = np.random.default_rng(6), [], T0
    for i in range(n):
        t = t + dt.timedelta(seconds=int(rng.choice([1, 5, 20, 60, 300, 900])))
        user = int(rng.integers(0, users))
        session = None if rng.random() < 0.1 else f"{user}-{int(rng.integers(0, 2))}"
        if rng.random() < 0.5:
            rows.append((user, session, i, t, rng.normal(size=3).tolist(), None))
        else:
            rows.append((user, session, i, t, None, float(rng.integers(-1, 3))))
    return rows


def test_feedback_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="sr-fb-")
    df = spark.createDataFrame(_two_kinds(), EVENTS)
    _write_chunks(df, "ts", 5, base + "/in")
    src = ST.read_interactions(spark, base + "/in", EVENTS, max_files_per_trigger=1)
    latest = {}
    for r in _run(spark, ST.feedback_stream(src), "fb_s").collect():
        if r.user_id not in latest or r.interaction_count > latest[r.user_id].interaction_count:
            latest[r.user_id] = r
    # a null session belongs to its user in the stream, so it gets a name of its own here
    own = df.withColumn("session_id", F.coalesce("session_id", F.concat(F.lit("none-"), F.col("user_id").cast("string"))))
    moods = FO.mood_states(own.where("mood_vec IS NOT NULL"), order=["ts", "event_id"])
    live = mood_asof(own.where("feedback IS NOT NULL").drop("mood_vec"), moods).where("mood_vec IS NOT NULL")
    want = {r.user_id: r for r in FO.profile_from_feedback(live, order=["ts", "event_id"]).collect()}
    assert set(latest) == set(want) and sum(r.interaction_count for r in want.values()) > 40
    for u, r in want.items():
        assert latest[u].interaction_count == r.interaction_count and np.allclose(latest[u].profile_vec, r.profile_vec, atol=1e-12)


def test_late_rows_are_split_off_and_counted(spark):
    base = tempfile.mkdtemp(prefix="sr-late-")
    schema = "session_id long, event_id long, ts timestamp, mood_vec array<double>"

    def row(i, minutes):
        return (i % 2, i, T0 + dt.timedelta(minutes=minutes), [float(i), 1.0])

    epochs = [[row(i, 10 * i) for i in range(20)],  # up to 190 minutes: the bound is 130
              [row(20, 130), row(21, 131), row(22, 200), row(23, 5), (0, 24, None, [1.0, 1.0])],  # 130 and 5 are late
              [row(30, 260), row(31, 140), row(32, 141)]]  # the bound is 140
    for rows in epochs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
    src = ST.read_interactions(spark, base + "/in", schema, max_files_per_trigger=1)
    sink = ST.late_splitter(base + "/out", delay_seconds=3600)
    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", base + "/cp").trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    late = {r.event_id for r in spark.read.parquet(base + "/out/late").collect()}
    assert late == {20, 23, 31}
    counts = [tuple(r) for r in spark.read.parquet(base + "/out/counts").orderBy("epoch").select("n_read", "n_accepted", "n_late").collect()]
    assert counts == [(20, 20, 0), (5, 3, 2), (3, 2, 1)]
    # the mood stream over the accepted rows drops none of them: in + late = read
    moods = _run(spark, ST.mood_stream(ST.read_accepted(spark, base + "/out", schema).where("ts IS NOT NULL"), watermark="1 hour"), "late_s")
    assert moods.count() + len(late) + 1 == sum(map(len, epochs))
    # a replayed epoch gives the same tables
    sink(spark.createDataFrame(epochs[1], schema), 1)
    assert {r.event_id for r in spark.read.parquet(base + "/out/late").collect()} == late
    again = [tuple(r) for r in spark.read.parquet(base + "/out/counts").orderBy("epoch").select("n_read", "n_accepted", "n_late").collect()]
    assert again == counts


def test_feedback_stream_frees_moods(spark):
    """Days apart: the first mood has long expired when the later batches come, and the profile stays."""
    base = tempfile.mkdtemp(prefix="sr-fbttl-")
    day = dt.timedelta(days=1)
    batches = [[(1, "s", 1, T0, [1.0, 0.0], None), (1, "s", 2, T0 + dt.timedelta(minutes=1), None, 1.0)],
               [(2, "z", 3, T0 + day, [0.0, 1.0], None)],
               [(1, "s", 4, T0 + 2 * day, None, 1.0), (1, "s", 5, T0 + 2 * day, [0.0, 1.0], None), (1, "s", 6, T0 + 2 * day, None, -1.0)]]
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(base + "/in")
    src = ST.read_interactions(spark, base + "/in", EVENTS, max_files_per_trigger=1)
    rows = _run(spark, ST.feedback_stream(src), "fbttl_s").collect()
    assert sorted((r.user_id, r.interaction_count) for r in rows) == [(1, 1), (1, 3)]
    v = np.array([1.0, 0.0])
    for n, f in ((1, 1.0), (2, -1.0)):  # events 4 and 6 see the mood of event 5, which comes first at that instant
        v = 0.95 * v + 0.1 / (1 + 0.01 * n) * f * np.array([0.0, 1.0])
        v = v / np.linalg.norm(v)
    last = max(rows, key=lambda r: r.interaction_count)
    assert np.allclose(last.profile_vec, v, atol=1e-12)
