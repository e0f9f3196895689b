import numpy as np
from pyspark.sql import functions as F

from sparkrec.llm import ann
from sparkrec.llm.q_ann import op3_nearest_neighbours


def brute(rows, k=20):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in ok:
        if q % 20 == 0:
            near = sorted((-float(ok[q] @ ok[i]), i) for i in ok if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def run(spark, path):
    out = {}
    for r in op3_nearest_neighbours(spark, path).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows), run(spark, sf)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vec = dict(rows)
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(np.array(vec[q], float) @ np.array(vec[i], float))) < 1e-9 for i, s in near)


def test_few_odd_and_equal_rows(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (20, [3.0, 4.0]), (21, [-1.0, 2.0])]
    rows += [(i, [0.5, 0.25]) for i in range(40, 140)] + [(40, [0.5, 0.25])]
    path = tables(embeddings=("vec_id long, embedding array<float>, label int, vec string, did int", [(*r, 1, "x", 2) for r in rows]))
    got, want = run(spark, path), brute(rows)
    assert {q: [i for i, _ in n] for q, n in got.items()} == {q: [i for i, _ in n] for q, n in want.items()}


def test_empty_and_single(spark, tables, tmp_path):
    assert run(spark, tables(embeddings=("vec_id long, embedding array<float>", []))) == {}
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/one/embeddings.parquet")
    assert run(spark, f"{tmp_path}/one") == {}


def test_walk_reaches_what_a_scan_reaches():
    rng = np.random.default_rng(4)
    c = rng.normal(size=(200, 9))
    index = ann.Index(8, 1.0, c, ann.link_centroids(c))
    for q in rng.normal(size=(20, 9)):
        d = np.linalg.norm(c - q, axis=1)
        want = set(np.nonzero(d <= d.min() * 1.2)[0].tolist())
        got = set(ann.walk(q, index, 1.2)[0])
        assert got <= want or d.min() > 0 and len(got & want) >= 0.9 * len(want)


def clustered(n=6000, clusters=60, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim))
    share = np.concatenate([np.zeros(n // 3, dtype=int), rng.integers(0, clusters, n - n // 3)])  # one cluster holds a third
    return middles[share] + 0.25 * rng.normal(size=(n, dim))


def test_clustered_vectors_are_read_selectively(spark, monkeypatch):
    x = clustered().astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    monkeypatch.setattr(ann, "REGION_ROWS", 500)
    found = ann.search(df, F.col("query_id") % 20 == 0, 20, list_rows=64)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows)
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    # lists are balanced, few vectors are replicated, and a query reads a small share of the rows
    items = ann.materialize(ann.distinct_vectors(df, "vec_id", "embedding", 21))
    index, sizes = ann.split_lists(items, ann.fit(items, len(rows), 64, sample_rows=100), 64)
    assert sizes.sum() == len(rows) and sizes.max() <= 256 and np.median(sizes[sizes > 0]) >= 16
    a = ann.augment(x.astype(float), index.top)
    placed = ann.homes(a, index, 3, 1.03)
    assert 1.0 <= sum(map(len, placed)) / len(x) < 1.3
    ratio = ann.fit_ratio(items, ann.by_hash(items, len(rows), 64), index, 20, 3, 1.03, 0.93)
    read = [sizes[ann.walk(np.append(v, 0.0), index, ratio)[0]].sum() for v in x[::100].astype(float)]
    assert np.mean(read) < 0.25 * len(x)


def test_regions_and_sets():
    cut = ann.Regions.cut(np.array([ann.REGION_ROWS // 2] * 3 + [3 * ann.REGION_ROWS] + [1] * 130))
    assert cut.of[:5].tolist() == [0, 0, 1, 2, 5] and cut.blocks == {2: 3}
    assert max(np.bincount(cut.of[4:])) == ann.REGION_LISTS
    assert sorted(cut.sets([0, 1, 3])) == [(0, 3), (2, 1), (3, 1), (4, 1)]
    (region, bits), = cut.sets([3], did=17)
    assert region in (2, 3, 4) and bits == 1
    assert cut.sets([4 + 63]) == [(5, -(1 << 63))]


def test_no_pair_is_lost_where_all_lists_are_read(spark, monkeypatch):
    """Ratio without a limit: the search is exact, with replicas and blocks."""
    monkeypatch.setattr(ann, "REGION_ROWS", 40)
    monkeypatch.setattr(ann, "fit_ratio", lambda *a: 1e9)
    x = clustered(900, 12, 5, seed=9)
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("query_id") % 20 == 0, 20, replica_ratio=1.5, list_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i, _ in near] for q, near in brute(rows).items()}
