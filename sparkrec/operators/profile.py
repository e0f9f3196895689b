"""Profile / mood relations around the folds: as-of mood lookup, history,
vector attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import prefix as PX


def mood_asof(feedback: DataFrame, moods: DataFrame, *, key: str = "session_id", time_col: str = "ts",
              config: Config = DEFAULT) -> DataFrame:
    """Attach to every feedback row the session's mood that is live at that
    moment: the latest mood set at or before the feedback (a mood at the same
    instant counts as earlier) with ``ts - mood_ts < ttl``. Feedback without a
    live mood gets null ``mood_vec`` (the reference ignores such feedback).

    As-of join without a native operator: union both sides, then the last mood
    over the key ordered by time (one sort per key, spills; no pairs are formed).
    Where a key holds more than ``config.hot_key_rows`` rows the running value is
    a prefix scan over ranges of (key, time), so the key spreads over tasks."""
    mood = F.struct(F.col("_mv").alias("vec"), F.col("_mts").alias("ts"), F.col("_mid").alias("id"))
    f = feedback.withColumn("_kind", F.lit(1))
    m = moods.select(
        key, time_col, F.lit(0).alias("_kind"), F.col("mood_vec").alias("_mv"), F.col(time_col).alias("_mts"),
        F.col("event_id").alias("_mid"),
    )
    u = f.unionByName(m, allowMissingColumns=True).withColumn("_oid", F.coalesce("event_id", "_mid"))
    order, value = [time_col, "_kind", "_oid"], F.when(F.col("_kind") == 0, mood)
    if PX.is_hot(feedback.select(key).unionByName(moods.select(key)), key, config.hot_key_rows):
        u = PX.last_value(PX.in_parts(u, key, order), value, "_last")
    else:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_last", F.last(value, ignorenulls=True).over(w))
    last = F.col("_last")
    live = (F.unix_micros(F.col(time_col).cast("timestamp")) - F.unix_micros(last["ts"].cast("timestamp"))) < F.lit(config.mood_ttl_seconds * 1_000_000)
    return u.where(F.col("_kind") == 1).select(
        *[c for c in feedback.columns],
        F.when(live, last["vec"]).alias("mood_vec"),
        F.when(live, last["id"]).alias("mood_event_id"),
    )


def mood_history(applied: DataFrame, *, key: str = "user_id", limit: int = DEFAULT.mood_history_limit,
                 order: list[str] = ("ts", "event_id")) -> DataFrame:
    """Last ``limit`` applied feedback records per user, oldest first
    (``limit = 0`` keeps all). Adds ``pos`` (1 = oldest kept)."""
    desc = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    r = applied.withColumn("_rd", F.row_number().over(desc))
    if limit:
        r = r.where(F.col("_rd") <= limit)
    asc = Window.partitionBy(key).orderBy(*order)
    return r.withColumn("pos", F.row_number().over(asc)).drop("_rd")


def profile_asof(interactions: DataFrame, states: DataFrame, *, user: str = "user_id", order: list[str] = ("ts", "event_id"),
                 config: Config = DEFAULT) -> DataFrame:
    """Each interaction with its user's profile as it stood right before it:
    ``interaction_count`` and ``profile_vec`` of the last state whose ``order`` is
    smaller, or null. An event's own update comes after it, and no later event
    changes an earlier row."""
    state = F.struct("interaction_count", "profile_vec")
    s = states.select(user, *order, F.lit(1).alias("_kind"), state.alias("_state"))
    u = interactions.withColumn("_kind", F.lit(0)).unionByName(s, allowMissingColumns=True)
    by = [*order, "_kind"]  # at one place an interaction comes before the update
    if PX.is_hot(interactions.select(user).unionByName(states.select(user)), user, config.hot_key_rows):
        u = PX.last_value(PX.in_parts(u, user, by), F.col("_state"), "_last")
    else:
        w = Window.partitionBy(user).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_last", F.last("_state", ignorenulls=True).over(w))
    return u.where(F.col("_kind") == 0).select(*interactions.columns, F.col("_last.interaction_count").alias("interaction_count"), F.col("_last.profile_vec").alias("profile_vec"))


def attach_vectors(interactions: DataFrame, moods: DataFrame, states: DataFrame, *, session: str = "session_id", user: str = "user_id",
                   time_col: str = "ts", event_id: str = "event_id", config: Config = DEFAULT) -> DataFrame:
    """Mood and profile vectors of each interaction as of its moment: the session's
    live mood (:func:`mood_asof`) and the user's profile before it
    (:func:`profile_asof`); absent ones stay null."""
    with_mood = mood_asof(interactions, moods, key=session, time_col=time_col, config=config)
    return profile_asof(with_mood, states, user=user, order=[time_col, event_id], config=config)
