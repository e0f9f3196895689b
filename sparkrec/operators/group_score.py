"""Fairness scoring of group candidates without (member, candidate) rows.

Every candidate needs the mean and the population std, over the group's
members, of ``a_u * (e_m . v_u) + (1 - a_u) * b_u(m)``, where ``b_u`` is sparse
(only the member's behavioural top-N). Members and candidates are cut into
blocks *within* their group; each (member block, candidate block) pair of the
same group is scored in one numpy task, which emits per candidate the partial
``(n, mean, M2)``. The partials are merged per (group, candidate) with Chan's
parallel formula, which is exact and numerically stable, so a group of any
size never produces members x candidates rows. A group of one block on each side is
ranked where it is scored, and only its best leave the task.

Candidates come with their vectors, or as ids alone and the items as an
:class:`ItemTable`, whose blocks the tasks look them up in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import ship_package
from ..sources.io import materialize
from .search import ItemTable, item_blocks


def _within_group_blocks(df: DataFrame, group: str, key: str, rows: int, payload: list[str], prefix: str) -> DataFrame:
    """Blocks of at most ~``rows`` rows inside each group, shipped as parallel
    flat arrays (cheap Arrow -> numpy conversion)."""
    b = df.join(_blocks_of(df, group, rows, f"_{prefix}n"), group).withColumn(f"_{prefix}blk", F.pmod(F.xxhash64(key), F.col(f"_{prefix}n")))
    g = b.groupBy(group, f"_{prefix}n", f"_{prefix}blk").agg(F.collect_list(F.struct(key, *payload)).alias("_r"))
    return g.select(group, f"_{prefix}n", f"_{prefix}blk", *[F.col("_r")[c].alias(f"{prefix}_{c}") for c in [key, *payload]])


def _blocks_of(df: DataFrame, group: str, rows: int, out: str) -> DataFrame:
    """Number of blocks of each group."""
    return df.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(rows))).cast("long").alias(out))


class _Rows:
    """One Arrow column of arrays of arrays (inner ones nullable), read by row without
    a Python object for each inner array."""

    def __init__(self, column):
        inner, self.outer = column.flatten(), np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        self.valid = inner.is_valid().to_numpy(zero_copy_only=False)
        self.ends = np.concatenate(([0], np.cumsum(inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        self.values = inner.flatten().to_numpy(zero_copy_only=False)

    def of(self, row: int) -> slice:
        return slice(self.outer[row], self.outer[row + 1])

    def matrix(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Which inner arrays of the row there are, and those as a matrix of doubles."""
        at = self.of(row)
        have, ends = self.valid[at], self.ends[at.start:at.stop + 1]
        sizes = np.unique(np.diff(ends)[have])
        if len(sizes) > 1:
            raise ValueError("vectors differ in length")
        return have, self.values[ends[0]:ends[-1]].astype(np.float64).reshape(int(have.sum()), -1) if have.any() else np.zeros((0, 0))

    def lists(self, row: int) -> list[np.ndarray]:
        at = self.of(row)
        return [self.values[self.ends[i]:self.ends[i + 1]] for i in range(at.start, at.stop)]


class _Found:
    """Vectors of the candidates of some rows, looked up in blocks of items."""

    def __init__(self, cids: np.ndarray, blocks):
        self.ids, self.matrix, self.valid = np.unique(cids), None, None
        self.valid = np.zeros(len(self.ids), bool)
        for iids, imat, _ in blocks():
            at = np.searchsorted(self.ids, iids)
            hit = np.nonzero((at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == iids))[0]
            if self.matrix is None:
                self.matrix = np.zeros((len(self.ids), imat.shape[1]), imat.dtype)
            self.matrix[at[hit]], self.valid[at[hit]] = imat[hit], True

    def of(self, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.ids, cid)
        have = self.valid[at]
        return have, self.matrix[at[have]].astype(np.float64) if have.any() else np.zeros((0, 0))


def _parts(ends: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` elements, a row at least."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _score_blocks(batches, k: int, lam: float, held: int, blocks=None):
    for b in batches:
        if not b.num_rows:
            continue
        col = {n: b.column(n) for n in b.schema.names}
        mv, tops, top_scores = (_Rows(col[n]) for n in ("m_v", "m_top_ids", "m_top_scores"))
        alphas, cids = col["m_alpha"].flatten().to_numpy(zero_copy_only=False).astype(np.float64), col["c_movie_id"].flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(col["c_movie_id"].value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        ce = _Rows(col["c_e"]) if blocks is None else None
        alone = (col["_mn"].to_numpy(zero_copy_only=False) == 1) & (col["_cn"].to_numpy(zero_copy_only=False) == 1)
        out = []
        for a, z in _parts(ends, held) if blocks is not None else [(0, b.num_rows)]:
            found = _Found(cids[ends[a]:ends[z]], blocks) if blocks is not None and ends[z] > ends[a] else None
            for g in range(a, z):
                alpha, cid = alphas[mv.of(g)], cids[ends[g]:ends[g + 1]].astype(np.int64)
                if len(alpha) == 0 or len(cid) == 0:
                    continue
                (has_v, v), (has_e, e) = mv.matrix(g), ce.matrix(g) if found is None else found.of(cid)
                order = np.argsort(cid)
                cid = cid[order]
                s = np.zeros((len(alpha), len(cid)))
                if has_v.any() and has_e.any():
                    s[np.ix_(has_v, has_e)] = alpha[has_v][:, None] * (v @ e.T)
                s = s[:, order]
                for r, (ids, sc) in enumerate(zip(tops.lists(g), top_scores.lists(g))):
                    if len(ids) == 0:
                        continue
                    ids = ids.astype(np.int64)
                    pos = np.searchsorted(cid, ids)
                    hit = (pos < len(cid)) & (cid[np.minimum(pos, len(cid) - 1)] == ids)
                    s[r, pos[hit]] += (1.0 - alpha[r]) * sc[hit].astype(np.float64)
                mean = s.mean(axis=0)
                m2, n = ((s - mean) ** 2).sum(axis=0), s.shape[0]
                whole = bool(alone[g]) and not (cid[1:] == cid[:-1]).any()
                if whole and k < len(cid):  # NaN first, as Spark sorts it
                    score = mean - lam * np.sqrt(np.maximum(m2, 0.0) / n)
                    best = np.lexsort((cid, np.where(np.isnan(score), -np.inf, -score)))[:k]
                    cid, mean, m2 = cid[best], mean[best], m2[best]
                out.append((np.full(len(cid), g), cid, np.full(len(cid), n), mean, m2, np.full(len(cid), whole)))
        if out:
            row, *rest = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([col["group_id"].take(pa.array(row)), *(pa.array(x) for x in rest)], names=["group_id", "movie_id", "n", "mean", "m2", "whole"])


def group_fairness_scores(members: DataFrame, candidates: DataFrame, k: int, *, fairness_lambda: float,
                          config: Config = DEFAULT, items: ItemTable | None = None) -> DataFrame:
    """members: ``group_id`` (any type)``, user_id, alpha double, v array<double> (nullable),
    top array<struct<movie_id long, score double>> (nullable)``; candidates:
    ``group_id, movie_id, e array (nullable)``, or without ``e`` and with ``items`` that
    have it by ``movie_id``. Returns ``group_id, movie_id, mean, std, score, rank`` for
    the top ``k`` per group."""
    # member x candidate block matrix of doubles within the byte budget
    rows = max(config.search_min_block_rows, int(math.sqrt(config.search_block_bytes / 8)))
    members = members.select("group_id", "user_id", "alpha", "v", F.col("top.movie_id").alias("top_ids"),
                              F.col("top.score").alias("top_scores"))
    mb = _within_group_blocks(members, "group_id", "user_id", rows, ["alpha", "v", "top_ids", "top_scores"], "m")
    cb = _within_group_blocks(candidates, "group_id", "movie_id", rows, ["e"] if items is None else [], "c")
    # the blocks of a large group are dealt by block as well, so that one group is
    # not one task: the member blocks meet every candidate block's number
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_meet")
    meet = _blocks_of(candidates.select("group_id"), "group_id", rows, "_n").select("group_id", numbers)
    pairs = mb.drop("_mblk").join(meet, "group_id").join(cb.withColumnRenamed("_cblk", "_meet"), ["group_id", "_meet"])
    ship_package(members.sparkSession)
    blocks = item_blocks(items, "movie_id") if items is not None else None
    held = config.search_block_bytes // (8 * config.embedding_dim)

    def scored(batches):
        yield from _score_blocks(batches, k, fairness_lambda, held, blocks)

    parts = pairs.mapInArrow(
        scored, f"group_id {members.schema['group_id'].dataType.simpleString()}, movie_id long, n long, mean double, m2 double, whole boolean")
    parts = materialize(parts)  # read by both sides of the merge
    whole, parts = parts.where("whole"), parts.where("NOT whole")
    # Chan merge of (n, mean, M2) partials per (group, candidate)
    tot = parts.groupBy("group_id", "movie_id").agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    merged = parts.join(tot, ["group_id", "movie_id"]).groupBy("group_id", "movie_id", "_n", "_mean").agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2).alias("_m2"))
    merged = merged.unionByName(whole.select("group_id", "movie_id", F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2")))
    ranked = merged.select("group_id", "movie_id", F.col("_mean").alias("mean"),
                           F.sqrt(F.greatest(F.col("_m2"), F.lit(0.0)) / F.col("_n")).alias("std"))
    ranked = ranked.withColumn("score", F.col("mean") - F.lit(fairness_lambda) * F.col("std"))
    from .rank import top_k_per

    return top_k_per(ranked, "group_id", k, [F.col("score").desc(), F.col("movie_id").asc()])
