"""Structured Streaming forms of the stateful operators.

* graduation (threshold crossing, emitted once per movie)
* session mood with TTL and EMA (state freed by event-time timeout)
* rating-driven user profile (ordered normalised EMA)
* session mood and feedback-driven profile in one keyed state
* late rows split off into a side table with counts before a watermark
* retrain signal via ``foreachBatch``

All use ``applyInPandasWithState`` keyed by the entity. Within a micro-batch
rows are applied in event order; a later micro-batch is applied after the
earlier ones (late rows are not re-ordered into history). Mood state uses a
watermark: rows later than the watermark are dropped by Spark, and a session's
state is removed once the watermark passes its expiry. Checkpoints go under
the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import DEFAULT, Config
from ..session import ensure_checkpoint_dir, ship_package


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def read_interactions(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Append-only interaction intake from a folder of parquet files."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


# ------------------------------------------------------------------ graduation

def graduation_stream(interactions: DataFrame, catalog: DataFrame, *, movie: str = "movie_id",
                      order: list[str], threshold: int = DEFAULT.graduation_threshold,
                      time_col: str = "ts") -> DataFrame:
    """Emits ``movie, graduated_at, interaction_count`` once, when a movie
    outside the (static) catalogue reaches ``threshold`` interactions."""
    ship_package(interactions.sparkSession)
    x = interactions.join(catalog.select(movie), movie, "left_anti")
    mtype = x.schema[movie].dataType.simpleString()

    def fn(key, pdfs, state):
        count = state.get[0] if state.exists else 0
        done = state.get[1] if state.exists else False
        out = []
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")
        for ts in pdf[time_col]:
            count += 1
            if not done and count >= threshold:
                done = True
                out.append({movie: key[0], "graduated_at": pd.Timestamp(ts).strftime("%Y-%m-%d"),
                            "interaction_count": count})
        state.update((count, done))
        if out:
            yield pd.DataFrame(out)

    return x.groupBy(movie).applyInPandasWithState(
        fn, f"{movie} {mtype}, graduated_at string, interaction_count long", "count long, done boolean",
        "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ mood

def mood_stream(messages: DataFrame, *, key: str = "session_id", vec: str = "mood_vec", time_col: str = "ts",
                event_id: str = "event_id", watermark: str = "1 hour", config: Config = DEFAULT) -> DataFrame:
    """Session mood after each message (EMA while the previous mood is live,
    strict TTL). State: vector, last set time; freed by event-time timeout."""
    ship_package(messages.sparkSession)
    ttl_us, bf = config.mood_ttl_seconds * 1_000_000, config.mood_blend_factor
    m = messages.withWatermark(time_col, watermark).withColumn("_us", F.unix_micros(F.col(time_col).cast("timestamp")))
    ktype = m.schema[key].dataType.simpleString()

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        v = np.asarray(state.get[0], dtype=np.float64) if state.exists else None
        last = state.get[1] if state.exists else None
        chain = state.get[2] if state.exists else 0
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", event_id], kind="stable")
        rows = []
        for us, eid, ts, mv in zip(pdf["_us"], pdf[event_id], pdf[time_col], pdf[vec]):
            mv = np.asarray(mv, dtype=np.float64)
            if v is not None and us - last < ttl_us:
                v, chain = bf * mv + (1.0 - bf) * v, chain + 1
            else:
                v, chain = mv.copy(), 1
            last = int(us)
            rows.append({key: k[0], event_id: eid, time_col: ts, "mood_vec": v.tolist(), "chain_len": chain})
        state.update((v.tolist(), last, chain))
        state.setTimeoutTimestamp(last // 1000 + ttl_us // 1000)
        yield pd.DataFrame(rows)

    return m.groupBy(key).applyInPandasWithState(
        fn, f"{key} {ktype}, {event_id} long, {time_col} timestamp, mood_vec array<double>, chain_len long",
        "vec array<double>, last_us long, chain long", "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ profile

def profile_stream(rated: DataFrame, *, key: str = "user_id", order: list[str], weight: str = "weight",
                   vec: str = "embedding", config: Config = DEFAULT) -> DataFrame:
    """Rating-driven profile; emits the updated profile of every user touched
    by a micro-batch (the latest row per user is the current profile)."""
    ship_package(rated.sparkSession)
    decay, base_lr, slow = config.profile_decay, config.profile_learning_rate, config.profile_lr_slowdown
    ktype = rated.schema[key].dataType.simpleString()

    def fn(k, pdfs, state):
        v = np.asarray(state.get[0], dtype=np.float64) if state.exists else None
        n = state.get[1] if state.exists else 0
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")
        for w, e in zip(pdf[weight], pdf[vec]):
            x = float(w) * np.asarray(e, dtype=np.float64)
            if v is None:
                nr = np.linalg.norm(x)
                v = x / nr if nr > 0 else x
            else:
                v = decay * v + (base_lr / (1.0 + slow * n)) * x
                nr = np.linalg.norm(v)
                if nr > 0:
                    v = v / nr
            n += 1
        state.update((v.tolist(), n))
        yield pd.DataFrame([{key: k[0], "profile_vec": v.tolist(), "interaction_count": n}])

    return rated.groupBy(key).applyInPandasWithState(
        fn, f"{key} {ktype}, profile_vec array<double>, interaction_count long",
        "vec array<double>, n long", "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ mood and feedback in one state

def feedback_stream(events: DataFrame, *, user: str = "user_id", session: str = "session_id", time_col: str = "ts", event_id: str = "event_id",
                    vec: str = "mood_vec", signal: str = "feedback", watermark: str = "1 hour", config: Config = DEFAULT) -> DataFrame:
    """Feedback-driven profiles over a stream of two event kinds in one keyed state.

    A row with a vector is a mood message of its session (EMA while the session's
    mood is live); a row with a signal is feedback, which moves the user's profile
    by the mood live at that moment and does nothing without one. Messages come
    before feedback of the same instant. After each micro-batch the profile of every
    user whose feedback was applied is emitted (the row of most interactions is the
    current one). The state holds the profile and the live moods of the user's
    sessions; moods that no later event can see are dropped by the watermark."""
    ship_package(events.sparkSession)
    ttl_us, bf = config.mood_ttl_seconds * 1_000_000, config.mood_blend_factor
    decay, base_lr, slow, guard = config.profile_decay, config.profile_learning_rate, config.profile_lr_slowdown, config.feedback_norm_guard
    e = events.withWatermark(time_col, watermark).select(
        user, F.col(session).cast("string").alias("_session"), time_col, event_id, F.col(vec).cast("array<double>").alias("_vec"),
        F.col(signal).cast("double").alias("_signal"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("_us"),
        F.when(F.col(vec).isNotNull(), 0).otherwise(1).alias("_kind"))
    utype = e.schema[user].dataType.simpleString()

    def load(state):
        """Profile, its count, and {session: (time, vector)}."""
        if not state.exists:
            return None, 0, {}
        profile, n, sessions, times, flat = state.get
        flat = np.asarray(flat, dtype=np.float64).reshape(len(sessions), -1) if len(sessions) else []
        moods = {None if not s else s[1:]: (t, v) for s, t, v in zip(sessions, times, flat)}
        return (np.asarray(profile, dtype=np.float64) if n else None), n, moods

    def save(state, profile, n, moods):
        now = state.getCurrentWatermarkMs() * 1000
        moods = {s: m for s, m in moods.items() if m[0] + ttl_us > now}
        if not n and not moods:
            state.remove()
            return
        names = ["" if s is None else "=" + s for s in moods]
        state.update((profile.tolist() if n else [], n, names, [int(t) for t, _ in moods.values()], [float(x) for _, v in moods.values() for x in v]))
        if moods:
            state.setTimeoutTimestamp(max(now // 1000 + 1, max(t for t, _ in moods.values()) // 1000 + ttl_us // 1000 + 1))

    def fn(key, pdfs, state):
        profile, n, moods = load(state)
        if state.hasTimedOut:
            save(state, profile, n, moods)
            return
        rows, seen = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", "_kind", event_id], kind="stable"), n
        for us, name, v, f in zip(rows["_us"], rows["_session"], rows["_vec"], rows["_signal"]):
            name = None if pd.isna(name) else name
            last = moods.get(name)
            live = last is not None and us - last[0] < ttl_us
            if v is not None:
                v = np.asarray(v, dtype=np.float64)
                moods[name] = (us, bf * v + (1.0 - bf) * last[1] if live else v)
            elif live and not pd.isna(f):
                mood = last[1]
                step = decay * (profile if n else np.zeros(len(mood))) + (base_lr / (1.0 + slow * n)) * (f * mood)
                size = np.linalg.norm(step)
                profile, n = step / size if size > guard else step, n + 1
        save(state, profile, n, moods)
        if n > seen:
            yield pd.DataFrame([{user: key[0], "profile_vec": profile.tolist(), "interaction_count": n}])

    return e.groupBy(user).applyInPandasWithState(
        fn, f"{user} {utype}, profile_vec array<double>, interaction_count long",
        "profile array<double>, n long, sessions array<string>, times array<long>, moods array<double>", "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ late rows

def late_splitter(out: str, *, time_col: str = "ts", delay_seconds: int = 3600):
    """``foreachBatch`` sink before a watermark: rows at or below the watermark that
    the earlier epochs set go to ``out/late``, all others to ``out/accepted``, and
    ``out/counts`` keeps how many were read, accepted and late in every epoch.

    The bound is Spark's: the latest time of the earlier epochs, in milliseconds,
    less the delay. An epoch's folders are overwritten, its counts come last, so a
    replayed epoch gives the same tables. Rows without a time are accepted, as Spark
    drops none of them."""
    out = out.rstrip("/")

    def sink(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        before = None
        if epoch_id > 0:
            before = spark.read.parquet(f"{out}/counts/epoch={epoch_id - 1}").first()["latest_us"]
        us = F.unix_micros(F.col(time_col).cast("timestamp"))
        late = F.lit(False) if before is None else F.coalesce(us <= F.lit((before // 1000 - delay_seconds * 1000) * 1000), F.lit(False))
        folder = f"{out}/split/epoch={epoch_id}"
        batch.withColumn("_late", late).write.mode("overwrite").parquet(folder)  # the batch is evaluated once
        rows = spark.read.parquet(folder)
        for name, keep in (("accepted", ~F.col("_late")), ("late", F.col("_late"))):
            rows.where(keep).drop("_late").write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch_id}")
        counts = rows.agg(F.count("*").alias("n_read"), F.count_if(~F.col("_late")).alias("n_accepted"), F.count_if(F.col("_late")).alias("n_late"),
                          F.greatest(F.max(us), F.lit(before).cast("long")).alias("latest_us"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{out}/counts/epoch={epoch_id}")

    return sink


def read_accepted(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The accepted rows as a stream source for operators with the same watermark
    delay, which then drop none of them. Do not limit its files a trigger: an epoch
    must not be split over micro-batches."""
    return spark.readStream.schema(f"{schema}, epoch int").parquet(f"{out.rstrip('/')}/accepted")


# ------------------------------------------------------------------ retrain signal

def retrain_monitor(graduations: DataFrame, pending_path: str, signal_path: str,
                    n: int = DEFAULT.retrain_on_graduation_count, completed_path: str | None = None):
    """``foreachBatch`` sink: each epoch's graduations overwrite that epoch's
    partition of the pending table, so a replayed epoch changes nothing, and the
    one-row retrain signal counts the distinct pending movies that are not in the
    completed table yet."""
    movie = graduations.columns[0]

    def sink(batch: DataFrame, epoch_id: int):
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{pending_path.rstrip('/')}/epoch={epoch_id}")
        pend = spark.read.option("basePath", pending_path).parquet(pending_path).select(movie).distinct()
        if completed_path is not None:
            pend = pend.join(spark.read.parquet(completed_path).select(movie), movie, "left_anti")
        sig = pend.agg(F.count("*").alias("pending_count")).withColumn(
            "should_retrain", F.col("pending_count") >= F.lit(n)).withColumn("epoch_id", F.lit(epoch_id))
        sig.write.mode("overwrite").parquet(signal_path)

    return sink
