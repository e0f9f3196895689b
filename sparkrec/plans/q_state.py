"""Stateful batch queries: profile / feedback folds, mood EMA, as-of mood,
history, vector attachment, graduation.

Stand-ins: ``events`` is the interaction stream, session = user; ``signup``
events are mood messages whose vector is item vector ``event_id mod n_items``;
feedback signals purchase +2, click +1, view 0, error -1. Ratings
(orders x lineitem) drive the rating profile and graduation.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import fold as FO
from ..operators import graduation as G
from ..operators import profile as P
from ..operators.lifecycle import GraduationStore
from ..sources.io import materialize, stage_folder
from ..sources.tables import table
from . import standins as S
from .registry import query

RATING_ORDER = ["ts", "order_key", "line_number", "item_id", "price", "rating"]
FEEDBACK_SIGNAL = {"purchase": 2.0, "click": 1.0, "view": 0.0, "error": -1.0}
GRAD_THRESHOLD = 50


def mood_messages(spark, d, items=None):
    items = items if items is not None else S.items(spark, d)
    n = items.count()
    ev = table(spark, d, "events").where(F.col("event_type") == "signup")
    j = ev.join(items.select(F.col("faiss_idx").alias("_i"), F.col("embedding").alias("mood_vec")),
                F.pmod(ev.event_id, F.lit(n)) == F.col("_i"))
    return j.select("event_id", "ts", F.col("user_id").alias("session_id"), "user_id", "mood_vec")


def feedback_events(spark, d):
    ev = table(spark, d, "events").where(F.col("event_type").isin(*FEEDBACK_SIGNAL))
    sig = F.lit(None).cast("double")
    for k, v in FEEDBACK_SIGNAL.items():
        sig = F.when(F.col("event_type") == k, F.lit(v)).otherwise(sig)
    return ev.select("event_id", "ts", F.col("user_id").alias("session_id"), "user_id", sig.alias("feedback"))


def moods(spark, d):
    return FO.mood_states(mood_messages(spark, d), order=["ts", "event_id"])


def live_feedback(spark, d):
    return P.mood_asof(feedback_events(spark, d), moods(spark, d))


def feedback_profiles(spark, d):
    lf = live_feedback(spark, d).where(F.col("mood_vec").isNotNull())
    return FO.profile_from_feedback(lf, order=["ts", "event_id"])


def _summary(vec):
    return [F.round(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"),
            F.round(F.element_at(vec, 1), 6).alias("v0")]


# ------------------------------------------------------------------ oracle SQL

IT = "it AS (SELECT vec_id AS faiss_idx, vec_id AS movie_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
NRM = ("CASE WHEN sqrt(list_inner_product({v}, {v})) > {g} "
       "THEN list_transform({v}, lambda y: y / sqrt(list_inner_product({v}, {v}))) ELSE {v} END")
LR = "(CAST(0.1 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + CAST(0.01 AS DOUBLE) * {n}))"

MOOD_SQL = f"""{IT},
ev AS (SELECT event_id, ts, user_id AS session_id, user_id, event_type FROM events),
mm AS (SELECT e.session_id, e.event_id, e.ts, it.e AS m,
              row_number() OVER (PARTITION BY e.session_id ORDER BY e.ts, e.event_id) AS k
       FROM ev e CROSS JOIN (SELECT count(*) AS n FROM it) nn JOIN it ON it.faiss_idx = e.event_id % nn.n
       WHERE e.event_type = 'signup'),
mood AS (
  SELECT session_id, k, event_id, ts, m AS v, 1 AS chain_len FROM mm WHERE k = 1
  UNION ALL
  SELECT mm.session_id, mm.k, mm.event_id, mm.ts,
         CASE WHEN epoch_us(mm.ts) - epoch_us(p.ts) < 1800000000
              THEN list_transform(range(1, len(mm.m) + 1),
                     lambda i: CAST(0.7 AS DOUBLE) * mm.m[i] + (CAST(1.0 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * p.v[i])
              ELSE mm.m END,
         CASE WHEN epoch_us(mm.ts) - epoch_us(p.ts) < 1800000000 THEN p.chain_len + 1 ELSE 1 END
  FROM mood p JOIN mm ON mm.session_id = p.session_id AND mm.k = p.k + 1),
fb AS (SELECT event_id, ts, session_id, user_id,
              CAST(CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.0 ELSE -1.0 END
                   AS DOUBLE) AS f
       FROM ev WHERE event_type IN ('purchase', 'click', 'view', 'error')),
fa AS (SELECT fb.*, mood.v AS mv, mood.ts AS mts, mood.event_id AS mid
       FROM fb ASOF LEFT JOIN mood ON fb.session_id = mood.session_id AND fb.ts >= mood.ts),
live AS (SELECT event_id, ts, session_id, user_id, f,
                CASE WHEN epoch_us(ts) - epoch_us(mts) < 1800000000 THEN mv END AS lv,
                CASE WHEN epoch_us(ts) - epoch_us(mts) < 1800000000 THEN mid END AS mood_event_id FROM fa),
fe AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, f, lv, event_id, ts
       FROM live WHERE lv IS NOT NULL),
pf AS (
  SELECT user_id, n, {NRM.format(v='x', g='1e-8')} AS v FROM (
    SELECT user_id, n, list_transform(lv, lambda y: CAST(0.95 AS DOUBLE) * 0.0 + {LR.format(n='0')} * (f * y)) AS x
    FROM fe WHERE n = 1)
  UNION ALL
  SELECT user_id, n, {NRM.format(v='x', g='1e-8')} FROM (
    SELECT fe.user_id, fe.n, list_transform(range(1, len(fe.lv) + 1),
             lambda i: CAST(0.95 AS DOUBLE) * p.v[i] + {LR.format(n='p.n')} * (fe.f * fe.lv[i])) AS x
    FROM pf p JOIN fe ON fe.user_id = p.user_id AND fe.n = p.n + 1))"""


@query(
    "profile_fold",
    oracle=f"""WITH RECURSIVE {IT},
r AS ({S.RATINGS_SQL}),
ev AS (SELECT r.user_id, row_number() OVER (PARTITION BY r.user_id ORDER BY r.ts, r.order_key, r.line_number,
              r.item_id, r.price, r.rating) AS n, r.rating - 3.0 AS w, it.e
       FROM r JOIN it ON r.item_id = it.movie_id),
fold AS (
  SELECT user_id, n, {NRM.format(v='x', g='0')} AS v FROM (
    SELECT user_id, n, list_transform(e, lambda y: w * y) AS x FROM ev WHERE n = 1)
  UNION ALL
  SELECT user_id, n, {NRM.format(v='x', g='0')} FROM (
    SELECT ev.user_id, ev.n, list_transform(range(1, len(ev.e) + 1),
             lambda i: CAST(0.95 AS DOUBLE) * f.v[i] + {LR.format(n='f.n')} * (ev.w * ev.e[i])) AS x
    FROM fold f JOIN ev ON ev.user_id = f.user_id AND ev.n = f.n + 1))
SELECT user_id, n AS interaction_count, round(list_sum(v), 6) AS checksum, round(v[1], 6) AS v0
FROM fold WHERE (user_id, n) IN (SELECT user_id, max(n) FROM ev GROUP BY user_id)""",
)
def profile_fold(spark, d):
    """Rating-driven user profiles: ordered EMA of (rating - 3) x item vector,
    items without a vector skipped."""
    items = S.items(spark, d)
    r = S.ratings(spark, d).join(items.select(F.col("movie_id").alias("item_id"), "embedding"), "item_id")
    r = r.withColumn("weight", F.col("rating") - F.lit(3.0))
    p = FO.profile_from_ratings(r, order=RATING_ORDER)
    return p.select("user_id", "interaction_count", *_summary("profile_vec"))


@query("mood_ema", oracle=f"""WITH RECURSIVE {MOOD_SQL}
SELECT session_id, event_id, CAST(chain_len AS BIGINT) AS chain_len, round(list_sum(v), 6) AS checksum,
       round(v[1], 6) AS v0 FROM mood""")
def mood_ema(spark, d):
    """Session mood after every mood message (EMA 0.7 new / 0.3 old while the
    previous mood is younger than 30 minutes)."""
    m = moods(spark, d)
    return m.select("session_id", "event_id", "chain_len", *_summary("mood_vec"))


@query("mood_asof", oracle=f"""WITH RECURSIVE {MOOD_SQL}
SELECT event_id, mood_event_id, round(list_sum(lv), 6) AS checksum FROM live""")
def mood_asof(spark, d):
    """Every feedback event with the session mood live at that moment."""
    lf = live_feedback(spark, d)
    return lf.select("event_id", "mood_event_id",
                     F.round(F.aggregate("mood_vec", F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


@query("feedback_fold", oracle=f"""WITH RECURSIVE {MOOD_SQL}
SELECT user_id, n AS interaction_count, round(list_sum(v), 6) AS checksum, round(v[1], 6) AS v0
FROM pf WHERE (user_id, n) IN (SELECT user_id, max(n) FROM fe GROUP BY user_id)""")
def feedback_fold(spark, d):
    """Feedback-driven profiles: +-signal x live mood, ordered EMA from zero."""
    p = feedback_profiles(spark, d)
    return p.select("user_id", "interaction_count", *_summary("profile_vec"))


@query("mood_history", oracle=f"""WITH RECURSIVE {MOOD_SQL},
h AS (SELECT user_id, event_id, f, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rd
      FROM fe)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos, event_id,
       f AS feedback FROM h WHERE rd <= 10""")
def mood_history(spark, d):
    """Last 10 applied feedback records per user, oldest first."""
    lf = live_feedback(spark, d).where(F.col("mood_vec").isNotNull())
    h = P.mood_history(lf, limit=10)
    return h.select("user_id", F.col("pos").cast("int").alias("pos"), "event_id", "feedback")


ATTACHED_SQL = """
before AS (SELECT l.event_id, max(fe.n) AS n FROM live l JOIN fe ON fe.user_id = l.user_id
           AND (fe.ts < l.ts OR (fe.ts = l.ts AND fe.event_id < l.event_id)) GROUP BY l.event_id)
SELECT l.event_id, l.mood_event_id, round(list_sum(l.lv), 6) AS mood_checksum, round(l.lv[1], 6) AS mood_v0,
       pf.n AS profile_count, round(list_sum(pf.v), 6) AS profile_checksum, round(pf.v[1], 6) AS profile_v0,
       round(list_inner_product(l.lv, pf.v), 6) AS alignment
FROM live l LEFT JOIN before USING (event_id) LEFT JOIN pf ON pf.user_id = l.user_id AND pf.n = before.n"""


@query("attach_vectors", oracle=f"WITH RECURSIVE {MOOD_SQL}, {ATTACHED_SQL}")
def attach_vectors(spark, d):
    """Each feedback interaction with the mood live at its moment and its user's
    profile right before it (vectors reported by sum, first component and inner product)."""
    m, feedback = moods(spark, d), feedback_events(spark, d)
    applied = P.mood_asof(feedback, m).where(F.col("mood_vec").isNotNull())
    states = FO.feedback_states(applied, order=["ts", "event_id"])
    a = P.attach_vectors(feedback, m, states)
    (msum, m0), (psum, p0) = _summary("mood_vec"), _summary("profile_vec")
    both = F.aggregate(F.zip_with("mood_vec", "profile_vec", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return a.select("event_id", "mood_event_id", msum.alias("mood_checksum"), m0.alias("mood_v0"), F.col("interaction_count").alias("profile_count"),
                    psum.alias("profile_checksum"), p0.alias("profile_v0"), F.round(both, 6).alias("alignment"))


HOT = replace(DEFAULT, hot_key_rows=100)  # at test scale the hot keys below are split all the same
HOT_SESSION = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"
HOT_MOOD_SQL = MOOD_SQL.replace("user_id AS session_id", f"{HOT_SESSION} AS session_id")


def _hot(df):
    """A third of all events in one session."""
    return df.withColumn("session_id", F.expr(HOT_SESSION).cast(df.schema["session_id"].dataType))


@query("mood_asof_hot", oracle=f"""WITH RECURSIVE {HOT_MOOD_SQL}
SELECT event_id, mood_event_id, round(list_sum(lv), 6) AS checksum FROM live""")
def mood_asof_hot(spark, d):
    """As-of moods where one session holds a third of all events: mood chains and
    the as-of join run as prefix scans, so the session spreads over tasks."""
    m = FO.mood_states(_hot(mood_messages(spark, d)), order=["ts", "event_id"], config=HOT)
    lf = P.mood_asof(_hot(feedback_events(spark, d)), m, config=HOT)
    return lf.select("event_id", "mood_event_id", F.round(F.aggregate("mood_vec", F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"))


GRAD_SQL = f"""r AS ({S.RATINGS_SQL}),
t AS (SELECT r.* EXCLUDE (item_id), item_id - item_id % 2 AS movie_id FROM r),
x AS (SELECT t.*, row_number() OVER (PARTITION BY movie_id ORDER BY ts, order_key, line_number, user_id, price, rating) AS k,
             count(*) OVER (PARTITION BY movie_id) AS c
      FROM t WHERE movie_id NOT IN (SELECT vec_id FROM embeddings)),
g AS (SELECT movie_id, strftime(ts, '%Y-%m-%d') AS graduated_at, c AS interaction_count FROM x WHERE k = {GRAD_THRESHOLD})"""

GRAD_ORDER = ["ts", "order_key", "line_number", "user_id", "price", "rating"]


def pending(spark, d):
    # two neighbouring parts are one title here, so that titles reach the threshold
    r = S.ratings(spark, d).withColumn("movie_id", F.col("item_id") - F.pmod("item_id", F.lit(2))).drop("item_id")
    catalog = S.items(spark, d).select("movie_id")
    return G.graduations(r, catalog, order=GRAD_ORDER, threshold=GRAD_THRESHOLD)


@query("graduation_batch", oracle=f"WITH {GRAD_SQL} SELECT movie_id, graduated_at, interaction_count FROM g")
def graduation_batch(spark, d):
    """Cold-start movies (no item vector yet) crossing 50 interactions."""
    return pending(spark, d)


HOT_MOVIE = "CASE WHEN order_key % 3 = 0 THEN -1 ELSE item_id - item_id % 2 END"


@query("graduation_hot", oracle="WITH " + GRAD_SQL.replace("item_id - item_id % 2 AS movie_id", f"{HOT_MOVIE} AS movie_id") + """
SELECT movie_id, graduated_at, interaction_count FROM g""")
def graduation_hot(spark, d):
    """Graduations where one movie holds a third of all interactions: they are
    numbered by a prefix scan over ranges of (movie, time)."""
    r = S.ratings(spark, d)
    r = r.withColumn("movie_id", F.expr(HOT_MOVIE).cast(r.schema["item_id"].dataType)).drop("item_id")
    return G.graduations(r, S.items(spark, d).select("movie_id"), order=GRAD_ORDER, threshold=GRAD_THRESHOLD, config=HOT)


@query("retrain_trigger", oracle=f"WITH {GRAD_SQL} SELECT count(*) AS pending_count, count(*) >= 100 AS should_retrain FROM g")
def retrain_trigger(spark, d):
    return G.retrain_signal(pending(spark, d), 100)


@query("weekly_batches", oracle=f"""WITH {GRAD_SQL},
w AS (SELECT movie_id, date_trunc('week', CAST(graduated_at AS TIMESTAMP)) AS wk FROM g)
SELECT movie_id, CASE WHEN wk < (SELECT max(wk) FROM w) THEN 'completed' ELSE 'pending' END AS status,
       CASE WHEN wk < (SELECT max(wk) FROM w) THEN 'batch-' || strftime(wk, '%Y-%m-%d') END AS batch,
       CASE WHEN wk < (SELECT max(wk) FROM w) THEN strftime(CAST(wk AS DATE) + 7, '%Y-%m-%d') END AS retrained_at
FROM w""")
def weekly_batches(spark, d):
    """Weekly retrain batches: graduations of closed weeks move to completed."""
    return G.weekly_batches(pending(spark, d))


@query("mark_retrained", oracle=f"""WITH {GRAD_SQL},
w AS (SELECT movie_id, graduated_at, interaction_count, date_trunc('week', CAST(graduated_at AS TIMESTAMP)) AS wk FROM g)
SELECT movie_id, graduated_at, interaction_count, CASE WHEN wk < (SELECT max(wk) FROM w) THEN 'completed' ELSE 'pending' END AS status,
       CASE WHEN wk < (SELECT max(wk) FROM w) THEN 'batch-' || strftime(wk, '%Y-%m-%d') END AS batch,
       CASE WHEN wk < (SELECT max(wk) FROM w) THEN strftime(CAST(wk AS DATE) + 7, '%Y-%m-%d') END AS retrained_at
FROM w""")
def mark_retrained(spark, d):
    """All weekly retrain batches: the pending movies of every closed week move to completed."""
    p = materialize(pending(spark, d))
    plan = G.weekly_batches(p).where(F.col("status") == "completed").select("movie_id", "batch", "retrained_at")
    still, done = G.mark_retrained(p.join(plan, "movie_id", "left"), plan.select("movie_id"), batch_id=F.col("batch"), retrained_at=F.col("retrained_at"))
    still = still.withColumn("status", F.lit("pending"))
    return still.unionByName(done.withColumn("status", F.lit("completed"))).select(
        "movie_id", "graduated_at", "interaction_count", "status", "batch", "retrained_at")


@query("graduation_lifecycle", oracle=f"""WITH r AS ({S.RATINGS_SQL}),
t AS (SELECT r.* EXCLUDE (item_id), item_id - item_id % 2 AS movie_id, CASE WHEN ts < TIMESTAMP '1998-01-01' THEN 0 ELSE 1 END AS epoch FROM r),
x AS (SELECT t.*, row_number() OVER (PARTITION BY movie_id ORDER BY ts, order_key, line_number, user_id, price, rating) AS k
      FROM t WHERE movie_id NOT IN (SELECT vec_id FROM embeddings)),
first AS (SELECT movie_id, count(*) AS c FROM x WHERE epoch = 0 GROUP BY movie_id),
done AS (SELECT movie_id, c FROM first WHERE c >= 20 AND movie_id % 4 = 0),
total AS (SELECT movie_id, count(*) AS c FROM x GROUP BY movie_id),
g AS (SELECT movie_id, strftime(ts, '%Y-%m-%d') AS graduated_at FROM x WHERE k = 20)
SELECT total.movie_id, CASE WHEN done.c IS NOT NULL THEN 'completed' WHEN total.c >= 20 THEN 'pending' ELSE 'counting' END AS status,
       graduated_at, coalesce(done.c, total.c) AS interaction_count,
       CASE WHEN done.c IS NOT NULL THEN 'batch-0' END AS batch, CASE WHEN done.c IS NOT NULL THEN '1998-01-01' END AS retrained_at
FROM total LEFT JOIN done USING (movie_id) LEFT JOIN g USING (movie_id)""")
def graduation_lifecycle(spark, d):
    """The graduation store over two epochs of interactions with a retrain batch
    between them: all movies with their state."""
    r = S.ratings(spark, d).withColumn("movie_id", F.col("item_id") - F.pmod("item_id", F.lit(2))).drop("item_id")
    first = F.col("ts") < F.lit("1998-01-01").cast("timestamp")
    catalog = S.items(spark, d).select("movie_id")
    store = GraduationStore(spark, f"{stage_folder(spark)}/graduation-{uuid.uuid4().hex}", order=GRAD_ORDER, threshold=20)
    store.record(r.where(first), 0, catalog)
    store.mark_retrained(store.state().pending.where(F.col("movie_id") % 4 == 0), batch_id="batch-0", retrained_at="1998-01-01")
    store.record(r.where(~first), 1, catalog)
    return store.all_movies().select("movie_id", "status", "graduated_at", "interaction_count", "batch", "retrained_at")
