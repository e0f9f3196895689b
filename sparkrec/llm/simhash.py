"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct 64-bit fingerprints are split into ``m`` groups of bits. If each group
``i`` gets a threshold ``t_i >= -1`` (-1: not probed) with ``sum(t_i) =
max_bits - m + 1``, two fingerprints at most ``max_bits`` apart differ by at
most ``t_i`` bits in some group. So each fingerprint may choose its own cheapest
thresholds:

1. **Bit groups**: bits are grouped by their correlation over all distinct
   fingerprints, so that a group's values carry little mutual surprise and the
   other groups stay selective.
2. **Thresholds**: dynamic programming over the groups minimises the probed keys
   plus the estimated candidates. The estimate convolves two half-group
   histograms of all fingerprints (at most ``2**16`` counts each).
3. **Probe and verify**: each fingerprint is indexed under its value of every
   group and probes all values within ``t_i``; an equi-join finds candidates and
   the bit distance decides.

A bucket of more than ``bucket_limit`` fingerprints is not paired off: its
members and all that probe it are linked through shared midpoints instead. Two
fingerprints within two bits have a common neighbour at distance one or less
each, and a midpoint has at most 65 distinct neighbours, so this is exact and
linear. (It holds for ``max_bits`` 2; for other values buckets are paired off.)
Components come from star contraction on distinct fingerprints only, so copies
cost one row each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import broadcast_if_under, materialize, ship, ship_texts
from sparkrec.llm.graph import components

BITS = 64
BROADCAST_ROWS = 500_000  # of two numbers each
_CHUNK = 65_536  # shingles whose bits are unpacked at once


def fingerprint_text(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint: bit set where over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = (np.cumsum(size + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = len(words) - k + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:to], ends[at + k - 1:to + k - 1])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3) -> Column:
    """Column (long: the 64 bits as two's complement) over whole texts.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle, a null text or one without words is 0.
    """
    ship_texts(docs)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint_text(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return run(F.col(text))


def bit_groups(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of correlated bits from the co-occurrence counts of set bits."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        rest = sorted(free)
        seed = max(rest, key=lambda b: (corr[b, rest].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            b = max(sorted(free), key=lambda x: corr[x, group].sum())
            group.append(b)
            free.discard(b)
        out.append(sorted(group))
    return out


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as a small integer."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out.astype(np.int64)


def _halves(group: list[int]) -> tuple[list[int], list[int]]:
    h = len(group) // 2
    return group[:h], group[h:]


def within(hist: np.ndarray, most: int) -> np.ndarray:
    """[d, v]: share of the counted values exactly ``d`` bits away from ``v``."""
    width = int(len(hist)).bit_length() - 1
    share = hist / max(hist.sum(), 1)
    v = np.arange(len(hist))
    rows = []
    for d in range(most + 1):
        total = np.zeros(len(hist))
        for flips in combinations(range(width), d):
            total += share[v ^ sum(1 << f for f in flips)]
        rows.append(total)
    return np.array(rows)


def allocate(est: list[np.ndarray], widths: list[int], max_bits: int) -> np.ndarray:
    """Thresholds (rows x groups) of least cost, by dynamic programming.

    ``est[i][r, t]`` estimates the candidates of row ``r`` in group ``i`` within
    ``t`` bits; the probed keys are added to it."""
    m, n = len(est), len(est[0])
    total = max_bits - m + 1
    keys = [[sum(_choose(w, d) for d in range(t + 1)) for t in range(max_bits + 1)] for w in widths]
    # best[s]: least cost so far with thresholds summing to s - m (each at least -1)
    states = total + m + 1
    best = np.full((states, n), np.inf)
    best[0] = 0
    picks = []
    for i in range(m):
        new = np.full((states, n), np.inf)
        pick = np.zeros((states, n), dtype=np.int8)
        for t in range(-1, max_bits + 1):
            cost = 0 if t < 0 else est[i][:, t] + keys[i][t]
            for s in range(t + 1, states):
                c = best[s - t - 1] + cost
                better = c < new[s]
                new[s][better] = c[better]
                pick[s][better] = t
        best = new
        picks.append(pick)
    out = np.zeros((n, m), dtype=np.int8)
    s = np.full(n, states - 1)
    for i in range(m - 1, -1, -1):
        out[:, i] = picks[i][s, np.arange(n)]
        s = s - out[:, i] - 1
    return out


def _choose(n: int, k: int) -> int:
    return len(list(combinations(range(n), k)))


def _statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 co-occurrence counts of set bits."""

    def partial(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(pdf)
        if n:
            cell = np.append(np.arange(BITS * BITS), -1)  # cell -1: the number of fingerprints
            yield pd.DataFrame({"cell": cell, "n": np.append(both.astype(np.int64).ravel(), n)})

    flat = np.zeros(BITS * BITS)
    n = 0
    for r in fps.mapInPandas(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4097 rows
        if r["cell"] < 0:
            n = r["n"]
        else:
            flat[r["cell"]] = r["n"]
    return n, flat.reshape(BITS, BITS)


def _histograms(fps: DataFrame, halves: list[list[int]]) -> list[np.ndarray]:
    """Counts of every value of each half group; at most 2**16 values each."""

    def partial(batches):
        sums = [np.zeros(1 << len(h), dtype=np.int64) for h in halves]
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for s, h in zip(sums, halves):
                s += np.bincount(gather(fp, h), minlength=len(s))
        for i, s in enumerate(sums):
            at = np.nonzero(s)[0]
            if len(at):
                yield pd.DataFrame({"half": i, "value": at, "n": s[at]})

    out = [np.zeros(1 << len(h)) for h in halves]
    for r in fps.mapInPandas(partial, "half int, value long, n long").groupBy("half", "value").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["half"]][r["value"]] = r["n"]
    return out


def _keys(fps: DataFrame, groups: list[list[int]], hists: list[np.ndarray], n: int, max_bits: int) -> DataFrame:
    """``(fp, part, key, member, probe)``: the keys a fingerprint is indexed
    under (member) and the keys it looks up (probe)."""
    tables = [within(h, max_bits) for h in hists]
    widths = [len(g) for g in groups]

    def run(batches):
        for pdf in batches:
            signed = pdf["fp"].to_numpy(dtype=np.int64)
            fp = signed.view(np.uint64)
            est = []
            for i, g in enumerate(groups):
                a, b = (gather(fp, h) for h in _halves(g))
                pa, pb = tables[2 * i][:, a], tables[2 * i + 1][:, b]
                exact = [sum(pa[x] * pb[d - x] for x in range(d + 1)) for d in range(max_bits + 1)]
                est.append(np.cumsum(exact, axis=0).T * n)
            chosen = allocate(est, widths, max_bits)
            parts = []
            for i, g in enumerate(groups):
                value = gather(fp, g)
                parts.append((signed, i, value, True, chosen[:, i] >= 0))
                for d in range(1, max_bits + 1):
                    rows = np.nonzero(chosen[:, i] >= d)[0]
                    if len(rows):
                        for flips in combinations(range(len(g)), d):
                            parts.append((signed[rows], i, value[rows] ^ sum(1 << f for f in flips), False, np.ones(len(rows), dtype=bool)))
            for f, i, k, member, probe in parts:
                yield pd.DataFrame({"fp": f, "part": i, "key": k, "member": member, "probe": probe})

    return fps.mapInPandas(run, "fp long, part int, key long, member boolean, probe boolean")


def links(fps: DataFrame, max_bits: int = 2, bucket_limit: int = 32) -> DataFrame:
    """``(u, v)`` between the distinct fingerprints ``fps(fp)`` that connect all
    pairs at most ``max_bits`` apart: every such pair is linked, directly or
    through a third fingerprint that is itself within ``max_bits`` of both."""
    ship(fps)
    n, both = _statistics(fps)
    if n == 0:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    m = max_bits + 1 if n < 1 << 24 else max(1, max_bits)  # narrow groups while they are selective; the result is the same
    groups = bit_groups(both, n, m)
    hists = _histograms(fps, [h for g in groups for h in _halves(g)])
    keys = materialize(_keys(fps, groups, hists, n, max_bits))
    members, probes = keys.filter("member").select("fp", "part", "key"), keys.filter("probe").select("fp", "part", "key")
    hot = materialize(members.groupBy("part", "key").count().filter(F.col("count") > (bucket_limit if max_bits == 2 else 1 << 62)).select("part", "key"))
    left, right = probes.alias("l"), members.join(hot, ["part", "key"], "left_anti").alias("r")
    near = F.expr(f"l.fp <> r.fp and bit_count(l.fp ^ r.fp) <= {max_bits}")
    same = (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key"))
    paired = left.join(right, same & near).select(F.col("l.fp").alias("u"), F.col("r.fp").alias("v"))
    crowded = keys.join(hot, ["part", "key"], "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(BITS)])
    middle = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    star = middle.groupBy("mid").agg(F.sort_array(F.collect_set("fp")).alias("near")).filter(F.size("near") > 1)  # 65 at most
    hubs = star.select(F.col("near")[0].alias("v"), F.explode(F.slice("near", 2, BITS)).alias("u")).select("u", "v")
    return paired.union(hubs)


def classes(prints: DataFrame, doc: str = "doc_id", fp: str = "fp", max_bits: int = 2) -> DataFrame:
    """``(fp, root, component_id)``, one row for each different fingerprint:
    ``root`` is the smallest fingerprint reachable over links of at most
    ``max_bits`` bits, ``component_id`` the smallest non-null id of its rows."""
    distinct = materialize(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc).alias("low")))
    roots = components(links(distinct.select("fp"), max_bits))
    joined = materialize(distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return joined.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(prints: DataFrame, doc: str = "doc_id", fp: str = "fp", max_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``prints(doc_id, fp)``.

    ``component_id`` is the smallest non-null id reachable over links of at most
    ``max_bits`` bits, itself included (null where none has an id). Equal
    fingerprints are linked, and so is the zero fingerprint of empty texts.
    Repeated rows stay; an empty table gives an empty result.
    """
    of = classes(prints, doc, fp, max_bits)
    return prints.select(F.col(doc).alias("doc_id"), F.col(fp).alias("fp")).join(of, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each class of near-duplicates: that of the
    smallest id (null ids last, then the smallest hash of the text). Of repeated
    rows one stays. Columns are those of ``docs``."""
    own = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("k"), fingerprint(docs, text, shingle).alias("fp"))
    prints = materialize(own)
    rows = prints.join(classes(prints, "d", "fp", max_bits).select("fp", "root"), "fp").groupBy("root", "d", "k").agg(F.count("*").alias("n"))
    rows = materialize(rows)
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("last"), "d", "k")).alias("w"))
    judged = rows.join(first, "root").select("d", "k", "n", (F.col("d").eqNullSafe(F.col("w.d")) & (F.col("k") == F.col("w.k"))).alias("stays"))
    judged = materialize(judged)
    size = judged.agg(F.count_if(~F.col("stays")).alias("out"), F.count_if(F.col("stays") & (F.col("n") > 1)).alias("twice")).first()
    key = F.xxhash64(text)

    def at(side: DataFrame):
        return docs[doc].eqNullSafe(side["d"]) & (key == side["k"])

    out = judged.filter(~F.col("stays"))
    kept = docs.join(broadcast_if_under(out, size["out"], BROADCAST_ROWS), at(out), "left_anti")
    if not size["twice"]:
        return kept
    twice = judged.filter(F.col("stays") & (F.col("n") > 1)).select(F.col("d").alias("_d"), F.col("k").alias("_k"))
    same = F.col(doc).eqNullSafe(F.col("_d")) & (key == F.col("_k"))
    again = kept.join(twice, same, "left_semi").withColumn("_k", key).dropDuplicates([doc, "_k"]).drop("_k")
    return kept.join(twice, same, "left_anti").unionByName(again)
