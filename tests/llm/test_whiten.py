import math

import numpy as np
import pytest

from sparkrec.llm import whiten
from sparkrec.llm.q_whiten import op13_embedding_whitening


def direct(rows, most=32):
    ok = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in ok], dtype=object)
    n, s = len(ok), x.sum(axis=0)
    apart = n * x - s
    deviation = (apart * apart).sum(axis=1)
    c = apart.astype(float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    keep = e > 1e-9 * e[0]
    return [i for i, _ in ok], n, deviation, e[keep], c @ u[:, keep] / np.sqrt(e[keep]), np.trace(v)


def check(df, rows):
    ids, n, deviation, e, want, trace = direct(rows)
    got = df.orderBy("vec_id", "component").collect()
    assert len(got) == len(ids) * len(e)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    order = np.argsort(ids, kind="stable")
    table = np.array([[r["whitened"] for r in sorted(by[ids[i]], key=lambda r: r["component"])] for i in order])
    w = want[order]
    sign = np.sign((table * w).sum(axis=0))
    assert np.abs(table - w * sign).max() < 1e-8
    for i in order:
        for r in by[ids[i]]:
            assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-10
            assert abs(r["explained"] - e[r["component"] - 1] / trace) <= 1e-10


def test_all_embeddings_as_a_direct_solution(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(op13_embedding_whitening(spark, sf), rows)


def test_odd_rows_and_low_rank(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [nan, 1.0, 2.0]), (3, [inf, 1.0, 1.0]), (4, [None, 1.0, 1.0]), (6, [0.0, 0.0, 0.0])]
    rows += [(10 + i, [0.1 * i, -0.05 * i * i, 0.5]) for i in range(9)]  # the last dimension is constant but for row 6
    path = tables(embeddings=("vec_id long, embedding array<float>, n int, x string", [(*r, 1, "x") for r in rows]))
    check(op13_embedding_whitening(spark, path), rows)


def test_equal_rows_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whiten.whiten(same).collect() == [] and whiten.whiten(same.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (5, [1.0])], schema)
    got = whiten.whiten(twice).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]


class Dense:
    def __init__(self, a):
        self.a, self.products = a, 0

    def __matmul__(self, b):
        self.products += 1
        return self.a @ b


@pytest.mark.parametrize("dim, decay", [(300, 0.97), (300, 0.8), (90, 1.0), (40, 0.9), (20, 0.5)])
def test_solver_on_larger_spaces(dim, decay):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    e = decay ** np.arange(dim) + 0.001 * np.arange(dim)[::-1]
    a = Dense((q * e) @ q.T)
    values, vectors = whiten.jacobi_davidson(a, dim, 32)
    k = min(32, dim)
    assert np.abs(values - np.sort(e)[::-1][:k]).max() < 1e-12
    assert np.linalg.norm(a.a @ vectors - vectors * values, axis=0).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert a.products < 120


def test_sums_in_a_tree(spark):
    rows = spark.createDataFrame([(i, [i, 2 * i]) for i in range(500)], "vec_id long, x array<bigint>").repartition(100)
    assert whiten.summed(rows, lambda x: x.sum(axis=0), (2,), "int64").tolist() == [124750, 249500]
