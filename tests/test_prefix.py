"""Prefix scans over hot keys: same rows as the plain windows, spread over parts."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkrec.config import DEFAULT
from sparkrec.operators import fold as FO
from sparkrec.operators import graduation as G
from sparkrec.operators import prefix as PX
from sparkrec.operators.profile import mood_asof

T0 = dt.datetime(2024, 1, 1)
HOT = replace(DEFAULT, hot_key_rows=10)


@pytest.fixture(scope="module")
def events(spark):
    """Session 0 holds a third of the rows, one session is null, many have a row or two."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        session = 0 if i % 3 == 0 else None if i % 50 == 7 else int(rng.integers(1, 300))
        t = T0 + dt.timedelta(seconds=int(rng.integers(0, 40_000)) if i % 5 else 20_000)
        rows.append((i, t, session, [float(x) for x in rng.normal(size=3)]))
    return spark.createDataFrame(rows, "event_id long, ts timestamp, session_id long, mood_vec array<double>").repartition(5).cache()


def test_hot_key_spreads_and_small_table_stays_small(spark, events):
    p = PX.in_parts(events, "session_id", ["ts", "event_id"], parts=24)
    sizes = {r["_part"]: r["count"] for r in p.rows.groupBy("_part").count().collect()}
    hot = [r["_part"] for r in p.rows.where("session_id = 0").select("_part").distinct().collect()]
    assert len(hot) >= 6 and max(sizes.values()) <= 4 * sum(sizes.values()) / len(sizes)
    assert p.spans.count() <= 2 * len(sizes)


def test_numbers_and_last_values_equal_windows(spark, events):
    order = ["ts", "event_id"]
    p = PX.in_parts(events, "session_id", order, parts=24)
    w = Window.partitionBy("session_id").orderBy(*order)
    value = F.when(F.col("event_id") % 7 == 0, F.struct("event_id", "mood_vec"))
    for inclusive in (True, False):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = events.select("event_id", F.last(value, ignorenulls=True).over(frame).alias("v"))
        got = PX.last_value(p, value, "v", inclusive).select("event_id", "v")
        assert {r[0]: r[1] for r in got.collect()} == {r[0]: r[1] for r in want.collect()}
    want = events.select("event_id", F.row_number().over(w).alias("n"))
    assert sorted(map(tuple, PX.numbered(p, "n").rows.select("event_id", "n").collect())) == sorted(map(tuple, want.collect()))


def test_halo_holds_the_rows_before_a_part(spark, events):
    p = PX.numbered(PX.in_parts(events, "session_id", ["ts", "event_id"], parts=300))  # parts of a few rows
    first = {r["_part"]: r["n"] for r in p.rows.where("session_id = 0").groupBy("_part").agg(F.min("_n").alias("n")).collect()}
    halo = {}
    for r in PX.with_halo(p, 9).where("session_id = 0 AND _halo").collect():
        halo.setdefault(r["_part"], []).append(r["_n"])
    for part, n in first.items():
        assert sorted(halo.get(part, [])) == list(range(max(1, n - 9), n))


def test_moods_and_asof_equal_the_plain_windows(spark, events):
    order = ["ts", "event_id"]
    plain = {r["event_id"]: r for r in FO.mood_states(events, order=order).collect()}
    split = {r["event_id"]: r for r in FO.mood_states(events, order=order, config=HOT).collect()}
    assert set(plain) == set(split) and max(r["chain_len"] for r in plain.values()) > 200
    for i, r in plain.items():
        assert r["chain_len"] == split[i]["chain_len"] and np.allclose(r["mood_vec"], split[i]["mood_vec"], atol=1e-14)
    moods = FO.mood_states(events.where("event_id % 4 = 0"), order=order)
    feedback = events.where("event_id % 4 <> 0").drop("mood_vec")
    got = [{r["event_id"]: (r["mood_event_id"], r["mood_vec"]) for r in mood_asof(feedback, moods, config=c).collect()} for c in (DEFAULT, HOT)]
    assert got[0] == got[1] and sum(m is not None for m, _ in got[0].values()) > 300


def test_graduations_equal_the_plain_window(spark, events):
    x = events.where("session_id IS NOT NULL").withColumnRenamed("session_id", "movie_id")
    catalog = spark.createDataFrame([(3,)], "movie_id long")
    got = [sorted(map(tuple, G.graduations(x, catalog, order=["ts", "event_id"], threshold=k, config=c).collect())) for k in (4, 333) for c in (DEFAULT, HOT)]
    assert got[0] == got[1] and got[2] == got[3] and len(got[0]) > 50 and [r[0] for r in got[2]] == [0]


def test_empty_table(spark, events):
    none = events.where(F.lit(False))
    assert PX.numbered(PX.in_parts(none, "session_id", ["ts", "event_id"], parts=4)).rows.count() == 0
