"""Order-dependent vector folds (profile EMA, feedback EMA) and the mood EMA.

Each step of a profile normalises the running vector, so these folds are neither associative
nor mergeable: no partial aggregation exists. The layout that still scales:
hash-partition by key, ``sortWithinPartitions(key, order...)`` (external sort,
spills), then one ``mapInPandas`` pass that streams the sorted Arrow batches
and carries only the current key's O(dim) state across batch boundaries. A hot
key is therefore never materialised as one pandas frame (unlike
``applyInPandas``); its cost is one sequential scan, which the order
dependence makes unavoidable. Arithmetic is double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..session import ship_package
from . import prefix as PX


def _sorted(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    ship_package(df.sparkSession)
    return df.repartition(key).sortWithinPartitions(key, *order)


def _rows(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))


def profile_from_ratings(df: DataFrame, *, key: str = "user_id", order: list[str], weight: str = "weight",
                         vec: str = "embedding", time_col: str = "ts", config: Config = DEFAULT) -> DataFrame:
    """Rating-driven profile: first event ``norm(w*e)``; then
    ``norm(decay*v + lr*w*e)`` with ``lr = base_lr / (1 + 0.01 n)``. One row per
    key: ``key, profile_vec array<double>, interaction_count, created_at, last_updated``."""
    decay, base_lr, slow = config.profile_decay, config.profile_learning_rate, config.profile_lr_slowdown
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        cur, v, n, first, last = None, None, 0, None, None
        out = []

        def flush():
            out.append({key: cur, "profile_vec": v.tolist(), "interaction_count": n,
                        "created_at": first, "last_updated": last})

        for pdf in batches:
            if not len(pdf):
                continue
            keys, ws, ts, e = pdf[key].to_numpy(), pdf[weight].to_numpy(np.float64), pdf[time_col], _rows(pdf, vec)
            for i in range(len(pdf)):
                if cur is None or keys[i] != cur:
                    if cur is not None:
                        flush()
                    cur, v, n, first = keys[i], None, 0, ts.iloc[i]
                x = ws[i] * e[i]
                if v is None:
                    nr = np.linalg.norm(x)
                    v = x / nr if nr > 0 else x
                else:
                    v = decay * v + (base_lr / (1.0 + slow * n)) * x
                    nr = np.linalg.norm(v)
                    if nr > 0:
                        v = v / nr
                n += 1
                last = ts.iloc[i]
            if len(out) >= 1024:
                yield pd.DataFrame(out)
                out = []
        if cur is not None:
            flush()
        if out:
            yield pd.DataFrame(out)

    schema = (f"{key} {ktype}, profile_vec array<double>, interaction_count long, "
              f"created_at timestamp, last_updated timestamp")
    return _sorted(df, key, order).mapInPandas(run, schema)


def profile_from_feedback(df: DataFrame, *, key: str = "user_id", order: list[str], signal: str = "feedback",
                          vec: str = "mood_vec", time_col: str = "ts", config: Config = DEFAULT) -> DataFrame:
    """Feedback-driven profile: starts at the zero vector;
    ``v = decay*v + lr*f*mood`` normalised when its norm exceeds 1e-8.
    One row per key (same columns as :func:`profile_from_ratings`)."""
    decay, base_lr, slow, guard = (config.profile_decay, config.profile_learning_rate,
                                   config.profile_lr_slowdown, config.feedback_norm_guard)
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        cur, v, n, first, last = None, None, 0, None, None
        out = []

        def flush():
            out.append({key: cur, "profile_vec": v.tolist(), "interaction_count": n,
                        "created_at": first, "last_updated": last})

        for pdf in batches:
            if not len(pdf):
                continue
            keys, fs, ts, m = pdf[key].to_numpy(), pdf[signal].to_numpy(np.float64), pdf[time_col], _rows(pdf, vec)
            for i in range(len(pdf)):
                if cur is None or keys[i] != cur:
                    if cur is not None:
                        flush()
                    cur, v, n, first = keys[i], np.zeros(m.shape[1]), 0, ts.iloc[i]
                v = decay * v + (base_lr / (1.0 + slow * n)) * (fs[i] * m[i])
                nr = np.linalg.norm(v)
                if nr > guard:
                    v = v / nr
                n += 1
                last = ts.iloc[i]
            if len(out) >= 1024:
                yield pd.DataFrame(out)
                out = []
        if cur is not None:
            flush()
        if out:
            yield pd.DataFrame(out)

    schema = (f"{key} {ktype}, profile_vec array<double>, interaction_count long, "
              f"created_at timestamp, last_updated timestamp")
    return _sorted(df, key, order).mapInPandas(run, schema)


def feedback_states(df: DataFrame, *, key: str = "user_id", order: list[str], signal: str = "feedback",
                    vec: str = "mood_vec", config: Config = DEFAULT) -> DataFrame:
    """The feedback-driven profile after every event, in the same pass and with the
    same steps as :func:`profile_from_feedback`: ``key, *order, interaction_count,
    profile_vec``, one row an event."""
    decay, base_lr, slow, guard = (config.profile_decay, config.profile_learning_rate,
                                   config.profile_lr_slowdown, config.feedback_norm_guard)

    def run(batches):
        cur, v, n = None, None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, fs, m, counts, vecs = pdf[key].to_numpy(), pdf[signal].to_numpy(np.float64), _rows(pdf, vec), [], []
            for i in range(len(pdf)):
                if v is None or keys[i] != cur:
                    cur, v, n = keys[i], np.zeros(m.shape[1]), 0
                v = decay * v + (base_lr / (1.0 + slow * n)) * (fs[i] * m[i])
                nr = np.linalg.norm(v)
                if nr > guard:
                    v = v / nr
                n += 1
                counts.append(n)
                vecs.append(v)
            yield pdf[[key, *order]].assign(interaction_count=counts, profile_vec=vecs)

    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *order))
    return _sorted(df, key, order).mapInPandas(run, f"{fields}, interaction_count long, profile_vec array<double>")


def mood_states(df: DataFrame, *, key: str = "session_id", order: list[str], vec: str = "mood_vec",
                time_col: str = "ts", event_id: str = "event_id", config: Config = DEFAULT) -> DataFrame:
    """Session mood after every mood message: ``0.7*new + 0.3*old`` while the
    previous mood is still live (``ts - last_set < ttl``, strict), else the new
    vector. Every set renews the TTL. One row per message:
    ``key, event_id, ts, mood_vec array<double>, chain_len``.

    The update is not normalised, so it is affine: a message ``j`` places back
    weighs ``bf * (1-bf)**j``. Chains (messages less than the TTL apart) are
    numbered by a window over the gaps, and a mood is the fold of its chain's last
    messages, as far back as their weight is above ``1e-30`` (57 at the default):
    a bounded frame, where the whole chain would be a serial scan. Where a key has
    more than ``config.hot_key_rows`` messages, chains and frames come from a prefix
    scan over ranges of (key, order) and the key spreads over tasks.
    """
    ttl_us, bf = config.mood_ttl_seconds * 1_000_000, config.mood_blend_factor
    us = F.unix_micros(F.col(time_col).cast("timestamp"))
    look = max(1, int(-(-np.log(1e-30) // np.log(1.0 - bf)))) if 0.0 < bf < 1.0 else 1
    m = df.select(key, event_id, time_col, *[c for c in order if c not in (key, event_id, time_col)], F.col(vec).cast("array<double>").alias("_v"), us.alias("_us"))
    if PX.is_hot(df, key, config.hot_key_rows):
        rows = _chains_of_hot_keys(m, key, order, ttl_us, look)
    else:
        by = Window.partitionBy(key).orderBy(*order)
        starts = (F.lag("_us").over(by).isNull() | (F.col("_us") - F.lag("_us").over(by) >= ttl_us)).cast("int")
        m = m.withColumn("_chain", F.sum(starts).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        chain = Window.partitionBy(key, "_chain").orderBy(*order)
        m = m.withColumn("chain_len", F.row_number().over(chain).cast("long"))
        rows = m.withColumn("_near", F.collect_list("_v").over(chain.rowsBetween(-look, 0)))
    whole = F.size("_near") == F.col("chain_len")  # the chain's first message is in sight: its weight is not multiplied by bf
    first = F.when(whole, F.col("_near")[0]).otherwise(F.transform(F.col("_near")[0], lambda x: x * bf))
    mixed = F.aggregate(F.slice("_near", 2, F.size("_near")), first, lambda a, v: F.zip_with(a, v, lambda x, y: F.lit(bf) * y + F.lit(1.0 - bf) * x))
    return rows.select(key, event_id, time_col, mixed.alias("mood_vec"), "chain_len")


def _chains_of_hot_keys(m: DataFrame, key: str, order: list[str], ttl_us: int, look: int) -> DataFrame:
    """``chain_len`` and ``_near`` of every message by a prefix scan: each part sees
    the ``look`` messages before it, and the number of the message that began the
    running chain is carried from part to part."""
    parts = PX.numbered(PX.in_parts(m, key, order))
    rows, by = PX.with_halo(parts, look), parts.local()
    gap = F.col("_us") - F.lag("_us").over(by)
    start = F.when((F.col("_n") == 1) | (gap >= ttl_us), F.col("_n"))
    begun = rows.select(key, *[c for c in order if c != key], "_us", "_n", "_halo", PX.PART).withColumn("_start", start)
    ends = parts.of_spans(begun.where(~F.col("_halo"))).groupBy(key, PX.PART, "_seq").agg(F.max("_start").alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.max("_end").over(earlier))
    rows = rows.withColumn("_start", start).withColumn("_start", F.max("_start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_near", F.collect_list("_v").over(by.rowsBetween(-look, 0))).where(~F.col("_halo"))
    rows = parts.carry(rows, carried, "_carried")  # numbers grow, so the last start is the greatest
    rows = rows.withColumn("chain_len", F.col("_n").cast("long") - F.greatest("_start", "_carried") + 1)
    size = F.least(F.col("chain_len"), F.size("_near").cast("long")).cast("int")
    return rows.withColumn("_near", F.slice("_near", F.size("_near") - size + 1, size))
