import datetime as dt
import json

import pytest

from sparkrec.operators.lifecycle import GraduationStore

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "movie_id string, ts timestamp, k long"


def batch(spark, first, n, movies=("a", "b", "c", "cat")):
    rows = [(movies[i % len(movies)], T0 + dt.timedelta(hours=12 * i), i) for i in range(first, first + n)]
    return spark.createDataFrame(rows, SCHEMA)


def store(spark, path):
    return GraduationStore(spark, str(path), movie_type="string", order=["ts", "k"], threshold=4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tables(s):
    st = s.state()
    return rows(st.counts), rows(st.pending), rows(st.completed), st.epoch


@pytest.fixture()
def catalogue(spark, tmp_path):
    spark.createDataFrame([("cat",)], "movie_id string").write.parquet(f"{tmp_path}/catalogue")
    return f"{tmp_path}/catalogue"


def test_counts_below_the_threshold_last_over_epochs(spark, tmp_path, catalogue):
    s, cat = store(spark, tmp_path / "s"), spark.read.parquet(catalogue)
    assert s.record(batch(spark, 0, 8), 0, cat)  # a, b, c twice each
    assert tables(s) == ([("a", 2), ("b", 2), ("c", 2)], [], [], 0)
    s.record(batch(spark, 8, 7), 1, cat)  # a, b, c twice more: the fourth at rows 12, 13, 14
    assert tables(s)[1] == [("a", "2024-01-07", 4), ("b", "2024-01-07", 4), ("c", "2024-01-08", 4)]
    assert not s.record(batch(spark, 8, 7), 1, cat)  # the same epoch again
    assert tables(s)[0] == [("a", 4), ("b", 4), ("c", 4)]
    s.record(batch(spark, 16, 4), 2, cat)
    assert [r[2] for r in tables(s)[1]] == [5, 5, 5]
    s.mark_retrained(s.state().pending.where("movie_id = 'a'"), batch_id="b1", retrained_at="2024-02-01")
    assert tables(s)[2] == [("a", "2024-01-07", 5, "2024-02-01", "b1")]
    s.record(batch(spark, 20, 4), 3, cat)  # a belongs to the catalogue now
    assert [r[0:3:2] for r in tables(s)[1]] == [("b", 6), ("c", 6)] and tables(s)[2][0][2] == 5
    assert s.retrain_signal(2).first().should_retrain and not s.retrain_signal(3).first().should_retrain


def test_crash_before_the_swap_and_replay(spark, tmp_path, catalogue, monkeypatch):
    cat, whole, broken = spark.read.parquet(catalogue), store(spark, tmp_path / "w"), store(spark, tmp_path / "b")
    for s in (whole, broken):
        s.record(batch(spark, 0, 14), 0, cat)
    before = tables(broken)
    with monkeypatch.context() as m:
        m.setattr(GraduationStore, "_swap", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            broken.record(batch(spark, 14, 20), 1, cat)
        with pytest.raises(OSError):
            broken.mark_retrained(broken.state().pending, batch_id="x", retrained_at="2024-01-01")
    assert tables(broken) == before
    for s in (whole, broken):
        s.record(batch(spark, 14, 20), 1, cat)
    assert tables(broken) == tables(whole)


def test_two_writers_of_one_version(spark, tmp_path, catalogue):
    a = store(spark, tmp_path / "s")
    m = a.manifest()
    a.record(batch(spark, 0, 8), 0, spark.read.parquet(catalogue))
    with pytest.raises(RuntimeError):
        a._swap({**m, "version": 1})


def test_stream_reads_a_growing_catalogue(spark, tmp_path, catalogue):
    for i, part in enumerate((batch(spark, 0, 8), batch(spark, 8, 8))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    s = store(spark, tmp_path / "s")
    sink = s.sink(catalogue)

    def grow(df, epoch):
        if epoch == 1:
            spark.createDataFrame([("b",)], "movie_id string").write.mode("append").parquet(catalogue)
        sink(df, epoch)

    q = (spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(grow)
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    counts = dict(tables(s)[0])
    assert counts == {"a": 4, "b": 2, "c": 4} and [r[0] for r in tables(s)[1]] == ["a", "c"]


def test_queue_files(spark, tmp_path, catalogue):
    s = store(spark, tmp_path / "s")
    s.record(batch(spark, 0, 15), 0, spark.read.parquet(catalogue))
    s.mark_retrained(s.state().pending.where("movie_id = 'b'"), batch_id="b1", retrained_at="2024-02-01")
    s.save_queue(f"{tmp_path}/queue")
    other = store(spark, tmp_path / "o")
    other.load_queue(f"{tmp_path}/queue")
    assert tables(other)[1:3] == tables(s)[1:3]
    doc = {"pending": [{"movie_id": "m1", "graduated_at": "2024-01-01", "interaction_count": 7}, {"movie_id": "m2", "graduated_at": "2024-01-02"}],
           "completed": [{"movie_id": "m3", "graduated_at": "2023-01-01", "interaction_count": 9, "retrained_at": "2023-02-01", "batch": "b0"}]}
    (tmp_path / "q.json").write_text(json.dumps(doc, indent=2))
    third = store(spark, tmp_path / "t")
    third.load_queue(f"{tmp_path}/q.json")
    assert tables(third)[:3] == ([("m1", 7), ("m2", 4)], [("m1", "2024-01-01", 7), ("m2", "2024-01-02", 4)], [("m3", "2023-01-01", 9, "2023-02-01", "b0")])
    assert third.record(batch(spark, 0, 4, ("m1", "m2", "m3", "cat")), 0, spark.read.parquet(catalogue))
    assert dict(tables(third)[0]) == {"m1": 8, "m2": 5}
