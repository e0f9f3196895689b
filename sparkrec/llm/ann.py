"""Approximate nearest neighbours by largest inner product over balanced posting lists.

* **Reduction**: with one more component ``sqrt(M^2 - |x|^2)`` (``M`` the largest
  norm; queries get 0), the largest inner product is the smallest distance.
* **Balanced lists**: a bounded sample is split in two again and again at the
  median of its main axis, so every leaf holds as many sample rows; the leaf
  means are the centroids. All rows are then counted, and a list that came out
  over twice as long as meant is split again by a sample of its own rows.
* **Boundary vectors** also go to other lists whose centroid is at most
  ``replica_ratio`` times as far as the nearest, ``replicas`` lists at most, unless
  a nearer chosen centroid covers that one (lies nearer to it than the vector does).
* **In-memory graph**: the centroids are linked to their nearest ones, and a
  query walks that graph best-first from a few spread centroids.
* **Distance-ratio pruning**: a query reads the lists within ``ratio`` times its
  nearest centroid's distance, and as many more as hold enough rows. The ratio is
  fitted: for a bounded sample of queries the exact neighbours are found by a scan of
  all rows, and the ratio is the one that reaches ``target`` of them.

Neighbouring lists of the tree make up a *region* of bounded size, which one task
holds; any number of queries streams past it and leaves ``k + 1`` rows each, the
best of all its lists there. A vector is stored once a region, with the set of its
lists as bits, so replicas are neither sent nor scored twice.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids (no more can be
among a query's ``k`` nearest), so a vector that a third of all rows share is
stored and searched once.
"""

from __future__ import annotations

import heapq
from binascii import crc32
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import broadcast_if_under, materialize, ship

REGION_ROWS, REGION_LISTS = 16_384, 64  # of a region: postings, and lists (bits of a set)
QUERY_ROWS = 256  # queries scored at a time


@dataclass(frozen=True)
class Index:
    dim: int
    top: float  # largest squared norm
    centroids: np.ndarray  # lists x (dim + 1)
    near: np.ndarray  # graph: each centroid's neighbours


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str, keep: int) -> DataFrame:
    """``(did, vec, ids)``: each different usable vector of the commonest length
    (the greater on a tie), its smallest id and its ``keep`` smallest ids."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vec")).filter(usable(F.col("vec")) & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.filter(F.size("vec") == (dims["d"] if dims else 0)).distinct()
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= keep)
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("did"), "vec", "ids")


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def augment(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.clip(top - (x * x).sum(axis=1), 0, None))[:, None]])


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    parts = [np.arange(len(x))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        out = []
        for p in parts:
            if len(p) < 2:
                out.append(p)
                continue
            y = x[p] - x[p].mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            order = np.argsort(y @ axis, kind="stable")
            out += [p[order[:len(p) // 2]], p[order[len(p) // 2:]]]
        parts = out
    return np.array([x[p].mean(axis=0) for p in parts])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0, None))


def link_centroids(c: np.ndarray, links: int = 16) -> np.ndarray:
    """Each centroid's nearest ones and its successor (so that all are reachable)."""
    out = np.zeros((len(c), min(links, len(c) - 1) + 1), dtype=np.int32)
    for at in range(0, len(c), 1024):
        d = distances(c[at:at + 1024], c)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at:at + len(d), :-1] = np.argsort(d, axis=1, kind="stable")[:, :out.shape[1] - 1]
    out[:, -1] = (np.arange(len(c)) + 1) % len(c)
    return out


def walk(q: np.ndarray, index: Index, ratio: float, slack: float = 1.05, entries: int = 8) -> tuple[list[int], list[float]]:
    """Lists within ``ratio`` of the nearest centroid, nearest first, by best-first
    search of the graph: it goes on while the frontier is within ``slack`` of that reach."""
    c = index.centroids
    found = np.unique(np.linspace(0, len(c) - 1, min(entries, len(c))).astype(int)).tolist()
    dist = np.linalg.norm(c[found] - q, axis=1).tolist()
    seen = np.zeros(len(c), dtype=bool)
    seen[found] = True
    heap, best = list(zip(dist, found)), min(dist)
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best * ratio * slack:
            break
        new = np.unique(index.near[i][~seen[index.near[i]]])
        if len(new):
            seen[new] = True
            ds = np.linalg.norm(c[new] - q, axis=1).tolist()
            best = min(best, *ds)
            found += new.tolist()
            dist += ds
            for x in zip(ds, new.tolist()):
                heapq.heappush(heap, x)
    keep = sorted((d, i) for d, i in zip(dist, found) if d <= best * ratio)
    return [i for _, i in keep], [d for d, _ in keep]


def homes(x: np.ndarray, index: Index, replicas: int, replica_ratio: float) -> list[list[int]]:
    """Lists of each (augmented) vector, its nearest first."""
    d = distances(x, index.centroids)
    near = np.argsort(d, axis=1, kind="stable")[:, :replicas]
    own = np.take_along_axis(d, near, axis=1)
    out = []
    for n, o in zip(near, own):
        chosen = [int(n[0])]
        for j, dj in zip(n[1:], o[1:]):
            if dj <= max(o[0], 1e-12) * replica_ratio and all(np.linalg.norm(index.centroids[i] - index.centroids[j]) > dj for i in chosen):
                chosen.append(int(j))
        out.append(chosen)
    return out


def split_lists(items: DataFrame, index: Index, list_rows: int, rounds: int = 3, sample_rows: int = 2_000) -> tuple[Index, np.ndarray]:
    """The index with every list of over ``2 * list_rows`` rows split by the tree over
    a sample of its rows (again where needed, up to ``rounds`` times), and the rows
    whose nearest centroid is that of each list."""
    for round_ in range(rounds + 1):
        shared = items.sparkSession.sparkContext.broadcast(index)  # most_lists centroids and their links

        def nearest(batches):
            for pdf in batches:
                if len(pdf):
                    own = distances(augment(matrix(pdf["vec"]), shared.value.top), shared.value.centroids).argmin(axis=1)
                    yield pd.DataFrame({"list": own, "did": pdf["did"], "vec": pdf["vec"]})

        placed = items.select("did", "vec").mapInPandas(nearest, "list int, did long, vec array<float>")
        sizes = np.zeros(len(index.centroids), dtype=np.int64)
        for r in placed.groupBy("list").count().collect():
            sizes[r["list"]] = r["count"]
        long = np.nonzero(sizes > 2 * list_rows)[0].tolist()
        if not long or round_ == rounds:
            return index, sizes
        share = {i: min(1.0, sample_rows / sizes[i]) for i in long}
        cut = F.element_at(F.create_map(*[F.lit(v) for i in long for v in (i, int(share[i] * (1 << 30)))]), F.col("list"))
        rows = placed.filter(F.col("list").isin(long)).filter(F.pmod(F.xxhash64("did", F.lit(round_)), F.lit(1 << 30)) <= cut).collect()
        parts = [[c] for c in index.centroids]
        for i in long:
            x = [r["vec"] for r in sorted(rows, key=lambda r: r["did"]) if r["list"] == i]
            want = 1 << int(np.ceil(np.log2(sizes[i] / list_rows)))
            if len(x) >= 2:
                parts[i] = list(balanced_centroids(augment(matrix(x), index.top), min(want, len(x))))
        c = np.array([x for p in parts for x in p])
        index = Index(index.dim, index.top, c, link_centroids(c))


def by_hash(rows: DataFrame, n: int, want: int) -> list:
    """About ``want`` of ``n`` rows of distinct ``did``, picked by hash: all if they
    are no more, twice ``want`` at most."""
    some = rows if n <= want else rows.filter(F.pmod(F.xxhash64("did"), F.lit(1 << 30)) < int((1 << 30) * want / n))
    return sorted(some.limit(2 * want).collect(), key=lambda r: r["did"])


def fit(items: DataFrame, n: int, list_rows: int = 256, sample_rows: int = 20_000, most_lists: int = 4096) -> Index:
    """Centroids from a sample of about ``sample_rows`` vectors."""
    top = items.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v))).first()[0]
    sample = by_hash(items.select("did", "vec"), n, sample_rows)
    x = augment(matrix(r["vec"] for r in sample), top)
    c = balanced_centroids(x, max(1, min(most_lists, n // list_rows, len(x) // 4)))
    return Index(x.shape[1] - 1, top, c, link_centroids(c))


def exact(items: DataFrame, queries: list, k: int) -> dict[int, list]:
    """The ``k`` nearest (did, vec) of a few queries by a scan of all items."""
    ids, q = [r["did"] for r in queries], matrix(r["vec"] for r in queries)

    def scan(batches):
        for pdf in batches:
            s = q @ matrix(pdf["vec"]).T
            did = pdf["did"].to_numpy()
            for i, row in enumerate(s):
                row[did == ids[i]] = -np.inf
                at = np.argsort(-row, kind="stable")[:k]
                yield pd.DataFrame({"query": ids[i], "did": did[at], "score": row[at], "vec": pdf["vec"].to_numpy()[at]})

    found = items.select("did", "vec").mapInPandas(scan, "query long, did long, score double, vec array<float>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "did")
    out: dict[int, list] = {}
    for r in found.filter("score > double('-infinity')").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).collect():
        out.setdefault(r["query"], []).append((r["did"], r["vec"]))
    return out


def fit_ratio(items: DataFrame, queries: list, index: Index, k: int, replicas: int, replica_ratio: float, target: float) -> float:
    """Smallest pruning ratio that reaches ``target`` of the sampled queries' neighbours."""
    truth, need = exact(items, queries, k), []
    for r in queries:
        if r["did"] in truth:
            q = np.append(np.asarray(r["vec"], dtype=np.float64), 0.0)[None]
            d = distances(q, index.centroids)[0]
            for h in homes(augment(matrix(v for _, v in truth[r["did"]]), index.top), index, replicas, replica_ratio):
                need.append(d[h].min() / max(d.min(), 1e-12))
    return float(np.quantile(need, target, method="higher")) + 1e-9 if need else 1.0


@dataclass(frozen=True)
class Regions:
    of: np.ndarray  # region of each list
    bit: np.ndarray  # its bit there
    blocks: dict[int, int]  # regions of one list beyond REGION_ROWS: that many numbers from its own on

    @staticmethod
    def cut(postings: np.ndarray) -> Regions:
        """Runs of neighbouring lists of up to REGION_ROWS postings and REGION_LISTS
        lists. A longer list is a region of several blocks, its vectors dealt by hash."""
        of, bit, blocks, region, rows, lists = [], [], {}, 0, 0, 0
        for n in postings.tolist():
            if lists and (rows + n > REGION_ROWS or lists == REGION_LISTS):
                region, rows, lists = region + blocks.get(region, 1), 0, 0
            of.append(region)
            bit.append(lists)
            rows, lists = rows + n, lists + 1
            if n > REGION_ROWS:
                blocks[region] = -(-n // REGION_ROWS)
        return Regions(np.array(of), np.array(bit), blocks)

    def sets(self, lists: list[int], did: int | None = None) -> list[tuple[int, int]]:
        """(region, set of the lists there as a signed 64-bit number): of the vector
        ``did``, or of a query, which goes to all blocks."""
        out: dict[int, int] = {}
        for i in lists:
            out[int(self.of[i])] = out.get(int(self.of[i]), 0) | 1 << int(self.bit[i])
        found = []
        for r, m in out.items():
            m, n = m - (1 << 64) if m >> 63 else m, self.blocks.get(r, 1)
            found += [(r + j, m) for j in range(n)] if did is None else [(r + crc32(b"%d" % did) % n, m)]
        return found


class Region:
    """A region's vectors, by id, with the sets of their lists."""

    def __init__(self, did: list, sets: list, vec: list):
        order = np.argsort(np.concatenate(did), kind="stable")
        self.did, self.sets, self.vec = np.concatenate(did)[order], np.concatenate(sets)[order], np.concatenate(vec)[order]

    def nearest(self, did: np.ndarray, sets: np.ndarray, vec: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, did, score) of each query's ``keep`` best among the lists it reads."""
        use = np.nonzero(self.sets & np.bitwise_or.reduce(sets))[0]
        score = vec @ self.vec[use].T
        score[(sets[:, None] & self.sets[use]) == 0] = -np.inf
        keep = min(keep, score.shape[1])
        at = _top(score, keep)
        best = np.take_along_axis(score, at, axis=1)
        ok = best > -np.inf
        return np.repeat(did, keep).reshape(ok.shape)[ok], self.did[use][at][ok], best[ok]


def score_regions(keep: int):
    """mapInArrow function over rows sorted by region, its vectors before its queries."""
    found = pa.schema([("query", pa.int64()), ("did", pa.int64()), ("score", pa.float64())])

    def run(batches):
        current, held, region = None, ([], [], []), None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, kind, sets, did = (np.asarray(batch.column(i)) for i in range(4))
            vec = np.asarray(batch.column(4).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            ends = np.nonzero((np.diff(number) != 0) | (np.diff(kind) != 0))[0] + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows]):
                if number[a] != current:
                    current, held, region = number[a], ([], [], []), None
                if kind[a] == 0:
                    for h, x in zip(held, (did, sets, vec)):
                        h.append(x[a:b])
                    continue
                if region is None and held[0]:
                    region, held = Region(*held), ([], [], [])
                for at in range(a, b if region is not None else a, QUERY_ROWS):
                    part = slice(at, min(at + QUERY_ROWS, b))
                    rows = region.nearest(did[part], sets[part], vec[part], keep)
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(rows, found)], schema=found)

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", replicas: int = 3,
           replica_ratio: float = 1.03, target: float = 0.93, sample_queries: int = 128, list_rows: int = 256,
           most_lists: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each usable row of ``vectors`` that
    ``queries`` (a condition on the id) picks, its ``k`` nearest found among the
    other ids, by inner product in double precision, ties to the smaller id.

    Rows with a null id or an unusable vector take no part; repeated rows count
    once; fewer candidates give fewer rows, an empty table none. Only the id and the
    vector are read, whatever other columns there are.
    """
    spark = ship(vectors)
    items = materialize(distinct_vectors(vectors, vec_id, vector, k + 1))
    n = items.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n == 0:
        return empty
    asked = vectors.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).alias("vec")).filter(
        queries & F.col("query_id").isNotNull() & usable(F.col("vec"))).distinct()
    asked = materialize(asked.join(items.select("did", "vec"), "vec").select("query_id", "did"))  # a query and its entry
    entries = materialize(items.join(asked.select("did").distinct(), "did", "left_semi").select("did", "vec"))
    list_rows = max(list_rows, -(-n // most_lists))
    index, sizes = split_lists(items, fit(items, n, list_rows, most_lists=most_lists), list_rows)
    sample = by_hash(entries, entries.count(), sample_queries)
    ratio = fit_ratio(items, sample, index, k, replicas, replica_ratio, target)
    shared = spark.sparkContext.broadcast(index)  # bounded: most_lists centroids and their links

    def place(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(lists=homes(augment(matrix(pdf["vec"]), shared.value.top), shared.value, replicas, replica_ratio))

    def enough(lists: list[int], q: np.ndarray) -> list[int]:
        """The lists, and the next nearest ones until they hold over ``k`` vectors."""
        if sizes[lists].sum() > k:
            return lists
        order = np.argsort(distances(q[None], shared.value.centroids)[0], kind="stable")
        return order[:np.searchsorted(np.cumsum(sizes[order]), k, side="right") + 1].tolist()

    def choose(batches):
        for pdf in batches:
            if len(pdf):
                q = np.hstack([matrix(pdf["vec"]), np.zeros((len(pdf), 1))])
                yield pdf.assign(lists=[enough(walk(x, shared.value, ratio)[0], x) for x in q])

    schema = "did long, vec array<float>, lists array<int>"
    placed = materialize(items.select("did", "vec").mapInPandas(place, schema))
    chosen = materialize(entries.select("did", "vec").mapInPandas(choose, schema))
    postings = np.zeros(len(index.centroids), dtype=np.int64)
    for r in placed.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # most_lists rows
        postings[r["list"]] = r["count"]
    regions = Regions.cut(postings)

    def by_region(kind):
        def run(batches):
            for pdf in batches:
                sets = [regions.sets(x, did if kind == 0 else None) for x, did in zip(pdf["lists"], pdf["did"])]
                at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                flat = [x for s in sets for x in s]
                yield pd.DataFrame({"region": [r for r, _ in flat], "kind": kind, "sets": [m for _, m in flat], "did": pdf["did"].to_numpy()[at], "vec": pdf["vec"].to_numpy()[at]})

        return run

    parts = "region int, kind int, sets long, did long, vec array<float>"
    rows = placed.mapInPandas(by_region(0), parts).unionByName(chosen.mapInPandas(by_region(1), parts))
    rows = rows.repartition("region").sortWithinPartitions("region", "kind", "sets")  # queries that read the same lists together
    found = rows.mapInArrow(score_regions(k + 1), "query long, did long, score double")
    found = found.groupBy("query", "did").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "did")
    near = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    near = near.join(items.select("did", "ids"), "did").select("query", "score", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = materialize(near.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k + 1).drop("r"))
    each = broadcast_if_under(near, near.count(), 100_000).join(asked.withColumnRenamed("did", "query"), "query").filter("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top(s: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` largest of each row, ties to the left, without sorting whole rows."""
    least = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
    out = np.zeros((len(s), keep), dtype=np.int64)
    for i, row in enumerate(s):
        at = np.nonzero(row >= least[i])[0]
        out[i] = at[np.argsort(-row[at], kind="stable")[:keep]]
    return out
