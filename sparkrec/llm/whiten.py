"""Whitening of embeddings by a block Jacobi-Davidson eigensolver over Spark.

Vectors become integers ``x = floor(64 c) + 1000000``, so their number and sums
are exact and rows are centred exactly as ``(n x - S) / n``. The covariance is
never formed: the solver sees it through **products** with a block of vectors,
one scan of the rows each, where a task adds up ``Xc' (Xc B)`` of its rows and
the tasks' small matrices are summed in a tree.

* **Rayleigh-Ritz** on the search space gives Ritz pairs and residuals.
* Leading pairs whose residual has reached double precision are **locked**: they
  leave the search, which stays orthogonal to them.
* All other wanted pairs extend the space by approximate solutions of their
  **projected correction equations** ``(I - ZZ')(V - t I)(I - ZZ') d = -r``, with
  ``Z`` the locked vectors and the wanted Ritz vectors. **MINRES** solves them side by
  side, so an inner step is one product for all of them.
* A full space restarts from its best Ritz vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import materialize, ship

SCALE, SHIFT = 64, 1_000_000
SLOTS = 32  # partial sums that reach the driver, where there are more tasks than twice as many
RESIDUAL = 256 * np.finfo(float).eps  # of the largest eigenvalue
LEAST = 1e-9  # of the largest eigenvalue: smaller ones are no component
_ROWS = 8192  # rows of one matrix


@dataclass(frozen=True)
class Fit:
    n: int
    sums: np.ndarray  # exact sums of x
    trace: float
    values: np.ndarray  # falling
    vectors: np.ndarray  # dimensions x components


def usable(v: Column) -> Column:
    """Not null and not empty, no null or non-finite entry."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """``(vec_id, x)`` of the usable vectors of the commonest length (the greater
    on a tie), as a stage table, and that length."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c")).filter(usable(F.col("c")))
    dims = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = dims["d"] if dims else 0
    x = F.transform("c", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    return materialize(rows.filter(F.size("c") == d).select("vec_id", x.alias("x"))), d


def matrices(batches, column: int = 0):
    """``(slice of the batch, integer matrix)`` of at most _ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, np.asarray(part.column(column).flatten()).reshape(part.num_rows, -1)


def summed(rows: DataFrame, partial, shape: tuple, dtype: str) -> np.ndarray:
    """Sum over all rows of ``partial(integer matrix)``, an array of ``shape``."""

    def run(batches):
        total = np.zeros(shape, dtype=dtype)
        for _, x in matrices(batches):
            total += partial(x)
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = sum(np.frombuffer(b, dtype=dtype) for b in pdf["data"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "data": [total.tobytes()]})

    schema, x = "part int, data binary", rows.select("x")
    found = x.mapInArrow(run, schema)
    if x.rdd.getNumPartitions() > 2 * SLOTS:
        found = found.groupBy(F.pmod("part", F.lit(SLOTS))).applyInPandas(add, schema)
    total = np.zeros(int(np.prod(shape)), dtype=dtype)
    for r in sorted(found.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(r["data"], dtype=dtype)
    return total.reshape(shape)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


class Covariance:
    """The covariance (divisor n) as a product with blocks of vectors."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums, self.dim, self.products = rows, n, sums, len(sums), 0

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums
        shared = self.rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(block))  # dimensions x block

        def partial(x):
            c = centred(x, n, sums)
            return c.T @ (c @ shared.value)

        self.products += 1
        out = summed(self.rows, partial, block.shape, "float64") / n
        shared.destroy()
        return out


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Basis of the block's part orthogonal to the given orthonormal columns;
    directions that vanish are left out."""
    out = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(2):
        for a in against:
            out = out - a @ (a.T @ out)
        u, s, _ = np.linalg.svd(out, full_matrices=False)
        out = u[:, s > 1e-10]
    return out


def minres(apply, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``A x = b``, column by column, after ``steps`` products."""

    def dot(x, y):
        return (x * y).sum(axis=0)

    def ratio(x, y):
        return np.divide(x, y, out=np.zeros_like(x), where=y > 1e-300)

    x, r, p = np.zeros_like(b), b.copy(), b.copy()
    s = apply(p)
    older = None
    for step in range(steps):
        ss = dot(s, s)
        a = ratio(dot(r, s), ss)
        x, r = x + a * p, r - a * s
        if step == steps - 1:
            break
        new_p, new_s = s, apply(s)
        for q, t, tt in [(p, s, ss)] + ([older] if older else []):
            beta = ratio(dot(new_s, t), tt)
            new_p, new_s = new_p - beta * q, new_s - beta * t
        older, p, s = (p, s, ss), new_p, new_s
    return x


def jacobi_davidson(operator, dim: int, wanted: int, inner: int = 4, spare: int = 8, rounds: int = 200, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors, of a
    symmetric ``operator`` known by its products; raises if residuals stay large."""
    wanted = min(wanted, dim)
    most = min(dim, 3 * wanted + 2 * spare)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = orthonormal(np.random.default_rng(seed).normal(size=(dim, min(dim, wanted + spare))))
    image = operator @ space
    for _ in range(rounds):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        left = wanted - locked.shape[1]
        residual = image - space * theta
        residual -= locked @ (locked.T @ residual)
        top = max(values[0] if len(values) else theta[0], 0.0)
        good = np.linalg.norm(residual[:, :left], axis=0) <= RESIDUAL * top
        done = left if good.all() else int(np.argmin(good))
        if done:
            locked, values = np.hstack([locked, space[:, :done]]), np.append(values, theta[:done])
            space, image, theta, residual = space[:, done:], image[:, done:], theta[done:], residual[:, done:]
            left -= done
        if not left:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        room = dim - locked.shape[1] - space.shape[1]
        if space.shape[1] + left > most and room:
            keep = min(left + spare, space.shape[1])
            space, image = space[:, :keep], image[:, :keep]
        z, shift = orthonormal(space[:, :left], locked), theta[:left]

        def projected(y):
            y = y - locked @ (locked.T @ y)
            y = y - z @ (z.T @ y)
            y = operator @ y - shift * y
            y = y - locked @ (locked.T @ y)
            return y - z @ (z.T @ y)

        rhs = -residual[:, :left]
        new = orthonormal(minres(projected, rhs - z @ (z.T @ rhs), inner), locked, space)
        if not new.shape[1] and room:
            new = orthonormal(np.random.default_rng(seed + locked.shape[1]).normal(size=(dim, min(left, room))), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, operator @ new])
        else:  # the space is whole: fresh products take out what rounding the images gathered
            space = orthonormal(space, locked)
            image = operator @ space
    raise RuntimeError("the eigensolver's residuals stay above double precision")


def fit(rows: DataFrame, dim: int, components: int) -> Fit | None:
    """Moments and leading components of the stage table ``(vec_id, x)``; None without rows."""
    first = summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), (dim + 1,), "int64") if dim else np.zeros(1, dtype=np.int64)
    n, sums = int(first[-1]), first[:-1]
    if not n:
        return None
    trace = float(summed(rows, lambda x: (centred(x, n, sums) ** 2).sum(keepdims=True).reshape(1), (1,), "float64")[0]) / n
    if trace == 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)))
    values, vectors = jacobi_davidson(Covariance(rows, n, sums), dim, components)
    keep = values > LEAST * values[0]
    return Fit(n, sums, trace, values[keep], vectors[:, keep])


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    n, sums, map_ = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def partial(x):
        w = centred(x, n, sums) @ map_
        return np.vstack([w.T @ w, w.sum(axis=0)])

    k = len(model.values)
    total = summed(rows, partial, (k + 1, k), "float64") / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max()) if k else 0.0


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``
    of every usable row and component.

    Rows whose vector is null, empty, of another length than most, or holds null
    or non-finite entries are dropped. Repeated rows and rows with a null id count
    and stay. A component needs an eigenvalue above 1e-9 of the largest, so equal
    vectors or an empty table give no rows. ``deviation`` is null where it does not
    fit 64 bits; entries may be up to 2**40 in size.
    """
    spark = ship(vectors)
    rows, dim = integers(vectors, vec_id, vector)
    model = fit(rows, dim, components)
    if model is None or not len(model.values):
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast((model, identity_error(rows, model)))

    def run(batches):
        model, error = shared.value
        n, k = model.n, len(model.values)
        map_, explained = model.vectors / np.sqrt(model.values), model.values / model.trace
        for part, x in matrices(batches, 1):
            apart = n * x - model.sums
            square = (apart.astype(float) ** 2).sum(axis=1)
            deviation = pa.array((apart * apart).sum(axis=1), pa.int64(), mask=square > 9.2e18)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch({"vec_id": part.column(0).take(pa.array(at)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                                   "n": pa.array(np.full(len(at), n)), "deviation": deviation.take(pa.array(at)), "whitened": pa.array(((apart / n) @ map_).ravel()),
                                   "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array(np.full(len(at), error))})

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
