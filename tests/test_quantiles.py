import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrec.functions import text as T
from sparkrec.functions import vectors as V
from sparkrec.operators import dictionary as D
from sparkrec.operators import quantiles as Q
from sparkrec.operators.consolidate import length_quantiles


def test_a_million_different_doubles(spark):
    x = np.random.default_rng(3).lognormal(0, 40, 1_000_000)  # over a hundred orders of magnitude
    df = spark.createDataFrame([(0,)], "a int").select(F.explode(F.sequence(F.lit(0), F.lit(999_999))).alias("i"))
    import pandas as pd

    def put(batches):
        for pdf in batches:
            yield pd.DataFrame({"v": x[pdf["i"].to_numpy()]})

    v = df.repartition(8).mapInPandas(put, "v double").cache()
    ranks = [0, 1, 249_999, 499_999, 500_000, 777_777, 999_999]
    assert Q.values_at(v, "v", ranks) == np.sort(x)[ranks].tolist()
    assert Q.values_at(v, "v", [-1, 1_000_000]) == [None, None]


@pytest.mark.parametrize("kind", ["ties", "two values", "one row", "mixed"])
def test_ties_and_few_rows(spark, kind):
    rng = np.random.default_rng(4)
    x = {"ties": rng.integers(0, 50, 30_000), "two values": np.repeat([5, 9], 20_000), "one row": np.array([7]),
         "mixed": np.concatenate([np.full(20_000, 1_000), rng.integers(-10**12, 10**12, 20_000)])}[kind]
    v = spark.createDataFrame([(int(i),) for i in x] + [(None,)] * 5, "v long").repartition(5)
    ranks = sorted({0, len(x) // 4, len(x) // 2 - 1 if len(x) > 1 else 0, len(x) // 2, len(x) - 1})
    assert Q.values_at(v, "v", ranks) == np.sort(x)[ranks].tolist()


def test_reports(spark):
    none = spark.createDataFrame([], "plot_length int")
    assert tuple(length_quantiles(none).first()) == (0, 0, 0, 0, 0) and tuple(Q.quantile_report(none, "plot_length").first()) == (None,) * 5
    some = spark.createDataFrame([(i,) for i in (4, 1, 9, 2)], "plot_length int")
    assert tuple(length_quantiles(some).first()) == (1, 2, 3, 4, 9)
    assert tuple(Q.quantile_report(some, "plot_length").first()) == (1.0, 2.0, 3.0, 4.0, 9.0)


def test_counter_normals(spark):
    rows = spark.range(3000).select("id", V.counter_normals("id", 8, 0.02, seed=7).alias("v"))
    a = {r["id"]: r["v"] for r in rows.repartition(1).collect()}
    b = {r["id"]: r["v"] for r in rows.repartition(16).collect()}
    assert a == b
    x = np.array(list(a.values()))
    assert abs(x.mean()) < 5e-4 and abs(x.std() - 0.02) < 5e-4 and np.abs(np.corrcoef(x.T) - np.eye(8)).max() < 0.08
    assert abs((np.abs(x) < 0.02).mean() - 0.6827) < 0.01  # normal, not only of that width
    assert a != {r["id"]: r["v"] for r in spark.range(3000).select("id", V.counter_normals("id", 8, 0.02, seed=8).alias("v")).collect()}


def test_dictionary_equals_the_literal_parser(spark):
    texts = ["A COZY heartwarming love story", "sci-fi space, old 80s", "nothing here", "", None, "funny funny", "feelgood? twenty-tens!", "new", "ab"]
    df = spark.createDataFrame([(t,) for t in texts] * 2, "text string")
    kinds = {"mood": T.MOOD_KEYWORDS, "genre": T.GENRE_KEYWORDS, "era": T.ERA_KEYWORDS}
    table = None
    for k, words in kinds.items():
        part = D.dictionary_table(spark, k, words)
        table = part if table is None else table.unionByName(part)
    got = {(r["text"], r["kind"]): r["categories"] for r in D.match_dictionary(df, table).collect()}
    for r in df.select("text", T.parse_intent("text").alias("i")).distinct().collect():
        for k in kinds:
            assert got.get((r["text"], k), []) == (r["i"][k] if r["text"] is not None else [])


def test_ten_thousand_keywords_without_a_nested_loop(spark):
    rng = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = sorted({"".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(10_000)})
    table = spark.createDataFrame([("k", i, f"c{i % 700}", w) for i, w in enumerate(words)], "kind string, place int, category string, keyword string")
    texts = ["".join(rng.choice(letters + [" "] * 5, 60)) for _ in range(120)]
    found = D.match_dictionary(spark.createDataFrame([(t,) for t in texts], "text string"), table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r["text"]: set(r["categories"]) for r in found.collect()}
    for t in texts:
        assert got.get(t, set()) == {f"c{i % 700}" for i, w in enumerate(words) if w in t}
    assert math.isfinite(len(got))
