"""Queries of the sequence, temporal, aggregate and set operators over the events table.

A user is a stream, an event's time its clock, its value the measure, its type the state and
``k`` the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import round_even
from .operators import aggregates as agg
from .operators import sequences as seq
from .operators import sets, temporal
from .registry import HOUR, MINUTE, events, query

U, ORDER = ["user_id"], ["t", "event_id"]


def _toggles(e: DataFrame) -> DataFrame:
    return seq.alternating_pairs(e, U, ORDER, "t")


def _effects(e: DataFrame) -> DataFrame:
    """Each event as an interval of k times 6 minutes."""
    return e.select("user_id", "event_id", F.col("t").alias("start_t"), (F.col("t") + F.col("k").cast("long") * (6 * MINUTE)).alias("end_t"), "event_type", "k")


def _segments(e: DataFrame) -> DataFrame:
    return seq.merge_segments(_effects(e.where("event_type = 'view'")), U, 6 * HOUR)


TOGGLES = """toggles AS (
  SELECT user_id, (rn - 1) // 2 AS pair, min(t) AS start_t, max(t) AS end_t, max(t) - min(t) AS duration
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev)
  GROUP BY user_id, pair HAVING count(*) = 2)"""
RUNS = """runs AS (
  SELECT user_id, run, event_type, min(t) AS start_t, max(t) AS end_t, count(*) AS n_rows, CASE WHEN count(nt) = count(*) THEN max(nt) END AS next_t
  FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS run
        FROM (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS nw, lead(t) OVER w AS nt
              FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)))
  GROUP BY user_id, run, event_type)"""
MOVING = """moving AS (
  SELECT user_id, min(CASE WHEN value >= 10 THEN t END) AS start_t, max(CASE WHEN value >= 10 THEN t END) AS end_t, min(t) AS t0, max(t) AS t1, count(*) AS frames
  FROM ev GROUP BY user_id),
win AS (
  SELECT user_id, start_t IS NOT NULL AS available,
    CASE WHEN start_t IS NULL THEN 'no_movement_evidence' ELSE 'movement_window_from_speed_threshold' END AS reason,
    start_t, end_t, end_t - start_t AS duration, start_t - t0 AS head_idle, t1 - end_t AS tail_idle, frames FROM moving)"""
EFFECTS = "eff AS (SELECT user_id, event_id, t AS start_t, t + CAST(k AS BIGINT) * 360000000 AS end_t, event_type, k FROM ev)"
SEGMENTS = EFFECTS + """, seg AS (
  SELECT user_id, segment, min(start_t) AS start_t, max(end_t) AS end_t, count(*) AS members, max(end_t) - min(start_t) AS duration
  FROM (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY start_t, end_t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
        FROM (SELECT *, CASE WHEN start_t - max(end_t) OVER (PARTITION BY user_id ORDER BY start_t, end_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 21600000000 THEN 0 ELSE 1 END AS nw
              FROM eff WHERE event_type = 'view'))
  GROUP BY user_id, segment)"""


@query(f"{RUNS} SELECT * FROM runs")
def lap_runs(spark: SparkSession, d: str) -> DataFrame:
    return seq.state_runs(events(spark, d), U, ORDER, "event_type", "t")


@query(f"{MOVING} SELECT * FROM win")
def movement_window(spark: SparkSession, d: str) -> DataFrame:
    return seq.movement_window(events(spark, d), U, "t", "value", threshold=10)


@query(f"""{RUNS}, {MOVING}, j AS (
  SELECT r.user_id, r.run, r.start_t, r.end_t, greatest(r.start_t, w.start_t) AS lo, least(r.end_t, w.end_t) AS hi, w.available, w.duration, w.head_idle + w.duration + w.tail_idle AS total
  FROM runs r LEFT JOIN win w USING (user_id)),
k AS (SELECT *, CASE WHEN NOT coalesce(available, false) THEN 'movement_window_unavailable' WHEN hi < lo THEN 'lap_outside_movement_window'
  WHEN hi = lo THEN 'no_movement_inside_lap' WHEN total > 0 AND duration / total < 0.25 THEN 'movement_window_implausibly_short' ELSE '' END AS reason FROM j)
SELECT user_id, run, end_t - start_t AS span, reason, CASE WHEN reason IN ('', 'no_movement_inside_lap', 'movement_window_implausibly_short') THEN hi - lo END AS race_time_estimate,
  reason = '' AS race_time_estimated, CASE WHEN reason = '' THEN 'estimated_from_movement' ELSE 'unavailable' END AS status FROM k""")
def lap_time_semantics(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    laps = seq.state_runs(e, U, ORDER, "event_type", "t").select("user_id", "run", "start_t", "end_t")
    out = seq.lap_time_semantics(laps, seq.movement_window(e, U, "t", "value", threshold=10), U)
    return out.drop("start_t", "end_t")


@query("""e AS (SELECT *, value > 20 AS f, lag(value > 20, 1, false) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was FROM ev)
SELECT user_id, event_id, t FROM e WHERE f AND NOT was""")
def rising_edges(spark: SparkSession, d: str) -> DataFrame:
    return seq.rising_edges(events(spark, d), U, ORDER, F.col("value") > 20).select("user_id", "event_id", "t")


@query(f"""{RUNS} SELECT user_id, start_t, coalesce(next_t, end_t) AS end_t, coalesce(next_t, end_t) - start_t AS duration, n_rows, next_t IS NULL AS open_end,
  coalesce(next_t, end_t) - start_t >= 21600000000 AS validated FROM runs WHERE event_type = 'view'""")
def state_islands_validated(spark: SparkSession, d: str) -> DataFrame:
    return seq.state_intervals(events(spark, d), U, ORDER, "event_type", "view", "t", 6 * HOUR)


@query(f"{TOGGLES} SELECT * FROM toggles")
def alternating_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _toggles(events(spark, d))


@query("""n AS (SELECT user_id, event_type, t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS n FROM ev WHERE event_type IN ('click', 'purchase'))
SELECT o.user_id, CAST(o.n AS INTEGER) AS n, o.t AS start_t, c.t AS end_t, c.t - o.t AS duration, coalesce(c.t >= o.t, false) AS valid
FROM (SELECT * FROM n WHERE event_type = 'click') o LEFT JOIN (SELECT * FROM n WHERE event_type = 'purchase') c ON o.user_id = c.user_id AND o.n = c.n""")
def fifo_toggle_pairs(spark: SparkSession, d: str) -> DataFrame:
    return seq.fifo_pairs(events(spark, d), U, ORDER, "t", F.col("event_type") == "click", F.col("event_type") == "purchase")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS opens, count(*) FILTER (event_type = 'purchase') AS closes,
  least(count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'purchase')) AS intervals,
  count(*) FILTER (event_type = 'click') = count(*) FILTER (event_type = 'purchase') AS balanced FROM ev GROUP BY user_id""")
def toggle_balance(spark: SparkSession, d: str) -> DataFrame:
    return agg.toggle_balance(events(spark, d), U, F.col("event_type") == "click", F.col("event_type") == "purchase")


@query(f"""{TOGGLES}, f AS (
  SELECT *, CASE WHEN end_t - start_t <= 86400000000 AND lag(end_t - start_t <= 86400000000) OVER w AND start_t - lag(end_t) OVER w BETWEEN -60000 AND 43200000000 THEN 0 ELSE 1 END AS nw
  FROM toggles WINDOW w AS (PARTITION BY user_id ORDER BY start_t, end_t)),
g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY start_t, end_t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM f)
SELECT user_id, "group", min(start_t) AS start_t, max(end_t) AS end_t, count(*) AS members, max(end_t) - min(start_t) AS duration FROM g GROUP BY user_id, "group" """)
def logical_grouping(spark: SparkSession, d: str) -> DataFrame:
    return seq.logical_groups(_toggles(events(spark, d)), U, longest=24 * HOUR, gap=(-60000, 12 * HOUR))


@query(f"{SEGMENTS} SELECT * FROM seg")
def segment_merge(spark: SparkSession, d: str) -> DataFrame:
    return _segments(events(spark, d))


@query(f"""{SEGMENTS}, n AS (SELECT *, lead(start_t) OVER (PARTITION BY user_id ORDER BY start_t, segment) AS nx FROM seg),
m AS (SELECT user_id, segment, start_t, end_t, members, duration, CASE WHEN nx > end_t THEN nx END AS next_start FROM n),
c AS (SELECT m.user_id, m.segment, min(greatest(x.start_t, m.end_t)) AS cut_t FROM m JOIN eff x ON x.user_id = m.user_id AND x.event_type = 'error' AND x.end_t > m.end_t GROUP BY ALL),
s AS (SELECT m.*, c.cut_t, least(end_t + 43200000000, next_start, cut_t) AS lim FROM m LEFT JOIN c USING (user_id, segment)),
o AS (SELECT s.user_id, s.segment, count(*) AS candidates, max(x.end_t) AS ee FROM s JOIN eff x ON x.user_id = s.user_id AND x.event_type IN ('click', 'purchase') AND x.end_t > x.start_t
  AND x.start_t >= s.end_t AND x.start_t <= s.lim GROUP BY ALL)
SELECT s.user_id, s.segment, s.start_t, s.end_t, s.members, s.duration, o.ee IS NOT NULL AS recovery_available,
  coalesce(CASE WHEN o.ee IS NOT NULL THEN least(o.ee, s.next_start, s.cut_t) END, s.end_t) AS recovery_end,
  CASE WHEN o.ee IS NULL THEN 'no_native_recovery_effect' WHEN s.cut_t < least(o.ee, coalesce(s.next_start, o.ee)) THEN 'airborne_hard_cut'
       WHEN s.next_start < o.ee THEN 'next_drift_hard_cut' ELSE 'native_small_boost_end' END AS end_reason, coalesce(o.candidates, 0) AS candidates
FROM s LEFT JOIN o USING (user_id, segment)""")
def recovery_end(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    effects = _effects(e).withColumn("semantic", F.when(F.col("event_type") == "click", "drift_small_boost").when(F.col("event_type") == "purchase", "air_boost"))
    return seq.recovery_end(_segments(e), effects.where("semantic is not null"), U, _effects(e.where("event_type = 'error'")), window=12 * HOUR)


@query("""c AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'click'), p AS (SELECT user_id, event_id AS pid, t AS pt FROM ev WHERE event_type = 'purchase'),
b AS (SELECT c.*, p.pid AS bid, p.pt AS bt FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.t >= p.pt),
a AS (SELECT b.*, p.pid AS aid, p.pt AS aft FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.pt),
n AS (SELECT *, CASE WHEN aft IS NULL THEN true WHEN bt IS NULL THEN false ELSE NOT (aft - t < t - bt) END AS back FROM a),
m AS (SELECT user_id, event_id, t, CASE WHEN back THEN bt ELSE aft END AS nt, CASE WHEN back THEN bid ELSE aid END AS ni FROM n)
SELECT user_id, event_id, t, CASE WHEN abs(nt - t) <= 36000000000 THEN nt END AS near_t, CASE WHEN abs(nt - t) <= 36000000000 THEN ni END AS near FROM m""")
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("user_id", "event_id", "t")
    return temporal.nearest(left, e.where("event_type = 'purchase'"), U, "t", "t", "event_id", tolerance=10 * HOUR)


@query("""q AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'error'), v AS (SELECT user_id, t AS d, cents AS v FROM ev WHERE event_type = 'view'),
l AS (SELECT q.*, v.d AS d0, v.v AS v0 FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.t >= v.d),
h AS (SELECT l.*, v.d AS d1, v.v AS v1 FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.t <= v.d)
SELECT user_id, event_id, t, round_even(CASE WHEN d0 = t THEN v0 WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN v0 + (v1 - v0) * ((t::DOUBLE - d0) / (d1::DOUBLE - d0)) END * 10000, 0) / 10000 AS value_at FROM h""")
def value_at_time_lerp(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = temporal.value_at(e.where("event_type = 'error'").select("user_id", "event_id", "t"), e.where("event_type = 'view'"), U, "t", "t", "cents")
    return out.withColumn("value_at", round_even(F.col("value_at"), 4))


@query(f"""{TOGGLES}, q AS (SELECT user_id, event_id, t FROM ev)
SELECT q.user_id, q.event_id, q.t, EXISTS (SELECT 1 FROM toggles x WHERE x.user_id = q.user_id AND q.t >= x.start_t AND q.t < x.end_t) AS active FROM q""")
def interval_mark(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return temporal.mark_intervals(e.select("user_id", "event_id", "t"), _toggles(e), U, "t", "active")


@query(f"""{TOGGLES}, {EFFECTS}, o AS (
  SELECT a.user_id, a.pair, count(*) AS n, sum(greatest(least(a.end_t, b.end_t) - greatest(a.start_t, b.start_t), 0)) AS overlap, string_agg(DISTINCT b.event_type, ',' ORDER BY b.event_type) AS labels
  FROM toggles a JOIN eff b ON a.user_id = b.user_id AND b.start_t <= a.end_t AND b.end_t >= a.start_t GROUP BY a.user_id, a.pair)
SELECT a.*, coalesce(n, 0) AS n, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap, coalesce(labels, '') AS labels FROM toggles a LEFT JOIN o USING (user_id, pair)""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = temporal.overlaps(_toggles(e), _effects(e), U, "pair", "event_type", width=24 * HOUR)
    return out.withColumn("labels", F.array_join("labels", ","))


@query(f"""{TOGGLES}, {RUNS}, f AS (SELECT a.user_id, a.pair, arg_min(r.run, r.start_t) AS first_run FROM toggles a JOIN runs r ON a.user_id = r.user_id AND r.start_t <= a.end_t AND r.end_t >= a.start_t GROUP BY ALL)
SELECT a.*, f.first_run FROM toggles a LEFT JOIN f USING (user_id, pair)""")
def interval_first_lap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return temporal.first_overlap(_toggles(e), seq.state_runs(e, U, ORDER, "event_type", "t"), U, "pair", "run", "first_run", width=24 * HOUR)


@query(f"""{EFFECTS}, o AS (SELECT a.user_id, a.event_id, count(*) FILTER (b.event_type = 'click') AS clicks, count(*) FILTER (b.value > 50) AS large FROM eff a JOIN ev b ON a.user_id = b.user_id AND b.t BETWEEN a.start_t AND a.end_t GROUP BY ALL)
SELECT a.user_id, a.event_id, coalesce(clicks, 0) AS clicks, coalesce(large, 0) AS large FROM eff a LEFT JOIN o USING (user_id, event_id)""")
def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = temporal.counts_inside(_effects(e), e, U, "event_id", "t", {"clicks": F.col("event_type") == "click", "large": F.col("value") > 50})
    return out.select("user_id", "event_id", "clicks", "large")


@query(f"""{TOGGLES}, f AS (SELECT a.user_id, a.pair, min(b.t - a.end_t) AS latency FROM toggles a JOIN ev b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.t BETWEEN a.end_t AND a.end_t + 43200000000 GROUP BY ALL)
SELECT a.*, f.latency FROM toggles a LEFT JOIN f USING (user_id, pair)""")
def first_after(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return temporal.first_after(_toggles(e), e.where("event_type = 'purchase'"), U, "pair", "t", 12 * HOUR)


@query("""SELECT a.user_id, a.event_id, a.t FROM ev a WHERE a.event_type = 'click' AND EXISTS
  (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 7200000000)""")
def tolerance_semijoin(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return temporal.near_any(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), U, "t", "t", 2 * HOUR).select("user_id", "event_id", "t")


@query("""h AS (SELECT DISTINCT a.k AS code, b.event_type AS kind, a.event_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_type IN ('click', 'purchase', 'signup') AND a.event_type = 'view' AND abs(a.t - b.t) <= 7200000000),
n AS (SELECT code, kind, count(*) AS near FROM h GROUP BY ALL), c AS (SELECT k AS code, count(*) AS events FROM ev WHERE event_type = 'view' GROUP BY k)
SELECT code, events, kind, coalesce(near, 0) AS near FROM c LEFT JOIN n USING (code)""")
def evidence_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return temporal.evidence_matrix(e.where("event_type = 'view'"), e.where("event_type in ('click', 'purchase', 'signup')"), U, "t", "k", "t", "event_type", 2 * HOUR)


@query("""f AS (SELECT user_id, CASE WHEN event_type = 'click' THEN EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 7200000000) END AS aligned FROM ev a),
r AS (SELECT user_id, count(aligned) AS anchor_events, count(*) FILTER (aligned) AS aligned_events FROM f GROUP BY user_id)
SELECT *, CASE WHEN anchor_events > 0 THEN aligned_events / anchor_events END AS rate,
  CASE WHEN anchor_events = 0 THEN 'not_applicable' WHEN aligned_events / anchor_events < 0.25 THEN 'variant_mismatch' ELSE 'aligned' END AS gate,
  NOT (anchor_events > 0 AND coalesce(aligned_events / nullif(anchor_events, 0), 1) < 0.25) AS counts_allowed FROM r""")
def alignment_gate(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    clicks = e.where("event_type = 'click'")
    near = temporal.near_any(clicks, e.where("event_type = 'purchase'"), U, "t", "t", 2 * HOUR).select("event_id", F.lit(True).alias("_near"))
    flagged = e.join(near, "event_id", "left").withColumn("aligned", F.when(F.col("event_type") == "click", F.coalesce("_near", F.lit(False))))
    return agg.alignment_gate(flagged, U, least=0.25)


@query("""SELECT user_id, event_id, t, p AS purchase, s AS signup, p OR s AS any_anchor FROM (SELECT a.*,
  EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND abs(a.t - b.t) <= 7200000000) AS p,
  EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND abs(a.t - b.t) <= 7200000000) AS s FROM ev a WHERE a.event_type = 'click')""")
def anchored_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    starts = e.where("event_type = 'click'").select("user_id", "event_id", "t")
    return temporal.anchored_buckets(starts, {n: e.where(f"event_type = '{n}'").select("user_id", "t") for n in ("purchase", "signup")}, U, "event_id", "t", 2 * HOUR)


@query(f"""{TOGGLES}, {EFFECTS}, s AS (SELECT user_id, event_id, start_t, end_t - start_t AS duration FROM eff WHERE event_type = 'click'),
x AS (SELECT s.*,
  EXISTS (SELECT 1 FROM eff a WHERE a.user_id = s.user_id AND a.event_type = 'error' AND s.start_t >= a.start_t AND s.start_t < a.end_t) AS air,
  (SELECT min(s.start_t - l.t) FROM ev l WHERE l.user_id = s.user_id AND l.event_type = 'signup' AND s.start_t - l.t BETWEEN 0 AND 7200000000) AS landing,
  (SELECT arg_min(d.pair, d.start_t) FROM toggles d WHERE d.user_id = s.user_id AND s.start_t BETWEEN d.start_t AND d.end_t) AS during,
  (SELECT arg_min(d.pair, s.start_t - d.end_t) FROM toggles d WHERE d.user_id = s.user_id AND s.start_t - d.end_t BETWEEN 0 AND 14400000000) AS post FROM s),
c AS (SELECT *, CASE WHEN duration NOT BETWEEN 3600000000 AND 28800000000 THEN 'unknown_speed_effect' WHEN air THEN 'air_boost' WHEN landing IS NOT NULL THEN 'landing_boost'
  WHEN during IS NOT NULL OR post IS NOT NULL THEN 'drift_small_boost' ELSE 'other_small_boost' END AS subtype FROM x)
SELECT user_id, event_id, start_t, duration, subtype, CASE WHEN subtype = 'drift_small_boost' THEN CASE WHEN during IS NOT NULL THEN 'during' ELSE 'post' END END AS relation,
  CASE WHEN subtype = 'drift_small_boost' THEN coalesce(during, post) END AS drift_id, CASE WHEN subtype = 'landing_boost' THEN landing END AS landing_delta FROM c""")
def context_classify(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    starts = _effects(e.where("event_type = 'click'")).select("user_id", "event_id", "start_t", (F.col("end_t") - F.col("start_t")).alias("duration"))
    drifts = _toggles(e).select("user_id", "start_t", "end_t", F.col("pair").alias("id"))
    air = _effects(e.where("event_type = 'error'"))
    landings = e.where("event_type = 'signup'").select("user_id", "t")
    return temporal.classify_context(starts, air, landings, drifts, U, "event_id", 2 * HOUR, 4 * HOUR, (HOUR, 8 * HOUR))


@query("""w AS (SELECT *, coalesce(lead(cents) OVER w, cents) AS v1, coalesce(lag(cents) OVER w, cents) AS v0, coalesce(lead(t) OVER w, t) AS t1, coalesce(lag(t) OVER w, t) AS t0
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, round_even(CASE WHEN t1 > t0 THEN (v1 - v0) / (t1 - t0) ELSE 0.0 END * 1e12, 0) / 1e12 AS rate FROM w""")
def derivative(spark: SparkSession, d: str) -> DataFrame:
    out = seq.derivative(events(spark, d), U, ORDER, "cents", "t", "rate")
    return out.select("user_id", "event_id", round_even(F.col("rate"), 12).alias("rate"))


POSE = "pose AS (SELECT *, t / 1e6 AS time_s, cents AS x, k AS y, 0 AS z, k / 64.0 AS yaw FROM ev)"
STEPS = POSE + """, st AS (SELECT *, row_number() OVER w AS rn, coalesce(time_s - lag(time_s) OVER w, 0) AS dt,
  coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM pose WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


def _pose(e: DataFrame) -> DataFrame:
    return e.withColumns({"time_s": F.col("t") / 1e6, "x": F.col("cents"), "y": F.col("k"), "z": F.lit(0), "yaw": F.col("k") / 64.0})


@query(f"""{STEPS}, r AS (SELECT *, CAST(round_even(step, 0) AS BIGINT) AS whole FROM st)
SELECT user_id, event_id, round_even(step * 10000, 0) / 10000 AS step, CAST(sum(whole) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS distance FROM r""")
def derivative_distance(spark: SparkSession, d: str) -> DataFrame:
    out = seq.steps(_pose(events(spark, d)), U, ORDER).withColumn("whole", F.rint("step").cast("long"))
    out = seq.cumulative(out, U, ORDER, "whole", "distance")
    return out.select("user_id", "event_id", round_even(F.col("step"), 4).alias("step"), "distance")


@query(f"""{STEPS}, n AS (SELECT *, lag(yaw) OVER w AS yaw0,
  list_concat(list(CASE WHEN step > 1e-6 AND rn > 1 THEN step END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING),
              list(CASE WHEN step > 1e-6 AND rn > 1 THEN step END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 FOLLOWING AND 8 FOLLOWING)) AS near
  FROM st WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
m AS (SELECT *, coalesce(list_median(list_filter(near, lambda v: v IS NOT NULL)), 0) AS med, abs(yaw - yaw0) AS turn FROM n)
SELECT user_id, event_id, coalesce(step > greatest(1.25, 2.0 * med) AND (turn > 0.45 OR step > greatest(2.0, 4.0 * med)) AND rn > 1, false) AS break_before FROM m""")
def local_median_breaks(spark: SparkSession, d: str) -> DataFrame:
    out = seq.pose_breaks(seq.steps(_pose(events(spark, d)), U, ORDER), U, ORDER, soft=(1.25, 2.0), hard=(2.0, 4.0))
    return out.select("user_id", "event_id", "break_before")


@query("""SELECT user_id, event_id, median(cents) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS boundary FROM ev""")
def boundary_median(spark: SparkSession, d: str) -> DataFrame:
    return seq.boundary_median(events(spark, d), U, ORDER, "cents", "boundary").select("user_id", "event_id", "boundary")


@query("""n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS z FROM ev)
SELECT user_id, avg(cents) FILTER (a <= 8) AS entry, avg(cents) FILTER (z <= 8) AS exit, count(*) AS n_rows FROM n GROUP BY user_id""")
def edge_averages(spark: SparkSession, d: str) -> DataFrame:
    return seq.edge_averages(events(spark, d), U, ORDER, "cents")


DIST = """dist AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS distance FROM ev),
br AS (SELECT *, min(distance) OVER (PARTITION BY user_id) AS d0, lead(distance) OVER w AS d1, lead(t) OVER w AS t1, lead(k) OVER w AS k1, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n
  FROM dist WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
ab AS (SELECT *, CAST(ceil((distance - d0) / 5000.0) AS BIGINT) AS a, CASE WHEN rn = n - 1 THEN CAST(floor((d1 - d0) / 5000.0) AS BIGINT) ELSE CAST(ceil((d1 - d0) / 5000.0) AS BIGINT) - 1 END AS b FROM br WHERE d1 > distance),
sm AS (SELECT user_id, s.g AS kk, d0 + s.g * 5000.0 AS pos, t + (t1 - t) * ((d0 + s.g * 5000.0 - distance) / (d1 - distance)) AS t, k + (k1 - k) * ((d0 + s.g * 5000.0 - distance) / (d1 - distance)) AS k
  FROM ab, unnest(generate_series(a, b)) AS s(g))"""


def _distance(e: DataFrame) -> DataFrame:
    return seq.cumulative(e, U, ORDER, "cents", "distance")


@query(f"{DIST} SELECT user_id, kk AS k, CAST(pos AS DOUBLE) AS at_d, round_even(t / 1000, 0) AS ms, round_even(k * 10000, 0) / 10000 AS code FROM sm")
def resample_fixed_step(spark: SparkSession, d: str) -> DataFrame:
    e = _distance(events(spark, d)).withColumn("code", F.col("k"))
    out = seq.resample(e.drop("k"), U, ORDER, "distance", ["t", "code"], 5000.0)
    return out.select("user_id", "k", F.col("at").alias("at_d"), F.rint(F.col("t") / 1000).alias("ms"), round_even(F.col("code"), 4).alias("code"))


def _bend_sql(n: int) -> str:
    a = f"(x - lag(x, {n}) OVER w)", f"(y - lag(y, {n}) OVER w)", f"(lead(x, {n}) OVER w - x)", f"(lead(y, {n}) OVER w - y)"
    cross, dot = f"{a[0]} * {a[3]} - {a[1]} * {a[2]}", f"{a[0]} * {a[2]} + {a[1]} * {a[3]}"
    short = f"sqrt({a[0]} * {a[0]} + {a[1]} * {a[1]}) < 1e-9 OR sqrt({a[2]} * {a[2]} + {a[3]} * {a[3]}) < 1e-9"
    return f"CASE WHEN {short} THEN 0.0 ELSE degrees(atan2({cross} + 0.0, {dot} + 0.0)) END"


@query(f"""sp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k, cents::DOUBLE AS x, k::DOUBLE AS y FROM ev),
b AS (SELECT *, {_bend_sql(4)} AS s4, {_bend_sql(8)} / 2 AS s8, count(*) OVER (PARTITION BY user_id) AS n FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY k)),
r AS (SELECT user_id, k, CASE WHEN k > 8 AND k <= n - 8 THEN coalesce(0.7 * s4 + 0.3 * s8, s4, s8, 0.0) ELSE 0.0 END AS raw FROM b)
SELECT user_id, CAST(k AS INTEGER) AS k, round_even(coalesce((lag(raw, 2) OVER w + 2 * lag(raw) OVER w + 3 * raw + 2 * lead(raw) OVER w + lead(raw, 2) OVER w) / 9, 0.0) * 1000, 0) / 1000 AS signal FROM r WINDOW w AS (PARTITION BY user_id ORDER BY k)""")
def turn_signal(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = events(spark, d).select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("k"), F.col("cents").cast("double").alias("x"), F.col("k").cast("double").alias("y"), F.lit(True).alias("ok"))
    return seq.turn_signal(e, U).select("user_id", "k", round_even(F.col("signal"), 3).alias("signal"))


@query("""i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
k AS (SELECT *, (i % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0 OR i = n - 1) AS keep FROM i),
b AS (SELECT *, coalesce(sum(keep::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM k),
m AS (SELECT *, bool_or(value > 100) OVER (PARTITION BY user_id, blk) AS broken FROM b)
SELECT user_id, event_id, t, broken FROM m WHERE keep""")
def preview_downsample(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("broken", F.col("value") > 100)
    return seq.preview(e, U, ORDER, most=20, broken="broken").select("user_id", "event_id", "t", "broken")


@query("""SELECT user_id, event_id, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM ev""")
def break_runs(spark: SparkSession, d: str) -> DataFrame:
    return seq.run_ids(events(spark, d).withColumn("b", F.col("value") > 100), U, ORDER, "b").select("user_id", "event_id", "run_id")


@query("""SELECT event_type, count(cents) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS low, max(cents) AS high, quantile_cont(cents, 0.5) AS median, avg(cents) AS mean FROM ev GROUP BY event_type""")
def stats_by_group(spark: SparkSession, d: str) -> DataFrame:
    out = agg.stats(events(spark, d), ["event_type"], F.col("cents").cast("double"))
    return out.withColumns({"total": F.col("total").cast("long"), "low": F.col("low").cast("long"), "high": F.col("high").cast("long")})


@query("""SELECT user_id, round_even(quantile_cont(cents, 0.2) * 10000, 0) / 10000 AS p20, round_even(quantile_cont(cents, 0.5) * 10000, 0) / 10000 AS p50, round_even(quantile_cont(cents, 0.9) * 10000, 0) / 10000 AS p90 FROM ev GROUP BY user_id""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return seq.rounded(agg.percentiles(events(spark, d), U, "cents", [0.2, 0.5, 0.9]), ["p20", "p50", "p90"])


@query("""s AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS dt FROM ev),
r AS (SELECT user_id, dt, row_number() OVER (PARTITION BY user_id ORDER BY dt) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE dt > 0)
SELECT user_id, dt AS step_ms, 1000 / dt AS hz FROM r WHERE i = n // 2 + 1""")
def sample_rate(spark: SparkSession, d: str) -> DataFrame:
    return agg.sample_rate(events(spark, d), U, ORDER, "t")


@query("""c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS histogram, count(*) AS distinct_codes, CAST(sum(n) AS BIGINT) AS events FROM c GROUP BY user_id""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    out = agg.histogram(events(spark, d), U, "event_type")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("histogram", text)


@query("""SELECT k AS code, count(*) AS intervals, quantile_cont(cents, 0.5) AS median_duration, string_agg(DISTINCT s, ',' ORDER BY s) AS semantics, count(*) FILTER (s LIKE 'unknown%') AS unknown
FROM (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown_effect' END AS s FROM ev) GROUP BY k""")
def code_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("s", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("unknown_effect"))
    return agg.code_evidence(e, "k", "cents", "s").withColumnRenamed("k", "code").withColumn("semantics", F.array_join("semantics", ","))


@query(f"""{DIST} SELECT user_id, max(t) - min(t) AS duration, max(distance) - min(distance) AS distance, max(value) AS max_speed, count(*) AS n_rows,
  string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_type_values, CASE WHEN max(t) > min(t) THEN (max(distance) - min(distance)) / (max(t) - min(t)) END AS avg_speed FROM dist GROUP BY user_id""")
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    out = agg.stream_totals(_distance(events(spark, d)), U, "t", "distance", "value", ["event_type"])
    return out.withColumn("event_type_values", F.array_join("event_type_values", ","))


@query(f"""{DIST}, lp AS (SELECT *, t // 604800000000 AS lap FROM dist)
SELECT user_id, lap, max(t) - min(t) AS duration, max(distance) - min(distance) AS distance, avg(cents) AS avg_speed, max(cents) AS max_speed, quantile_cont(cents, 0.5) AS median_speed,
  min(cents) AS min_speed, min(CASE WHEN cents >= 500 THEN cents END) AS min_moving_speed FROM lp GROUP BY user_id, lap""")
def lap_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _distance(events(spark, d)).withColumn("lap", F.expr(f"t div {168 * HOUR}"))
    return agg.lap_metrics(e, ["user_id", "lap"], "cents", "t", "distance", moving=500)


@query(f"""{TOGGLES}, c AS (SELECT user_id, lo.lo AS lo, lo.hi AS hi FROM (SELECT user_id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY user_id) lo),
i AS (SELECT c.user_id, greatest(x.start_t, lo) AS s, least(x.end_t, hi) AS e FROM toggles x JOIN c USING (user_id) WHERE x.end_t > lo AND x.start_t < hi
  UNION ALL SELECT user_id, hi, hi FROM c UNION ALL SELECT user_id, lo, lo FROM c),
g AS (SELECT user_id, s, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM i)
SELECT user_id, gap_start, s AS gap_end FROM g WHERE gap_start < s""")
def interval_complement(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    spans = e.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return sets.complement(spans, _toggles(e), U)


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, t, event_id) AS r FROM ev)
SELECT user_id, k, event_id, event_type FROM r WHERE r = 1""")
def dedupe_precedence(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return sets.dedupe_by_precedence(events(spark, d), ["user_id", "k"], rank, ["t", "event_id"]).select("user_id", "k", "event_id", "event_type")


@query("""m AS (SELECT user_id, event_id, cents - lag(cents) OVER (PARTITION BY user_id ORDER BY t, event_id) AS change FROM ev),
s AS (SELECT *, CASE WHEN change > 0.0005 THEN 'loss' WHEN change < -0.0005 THEN 'gain' END AS side FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY abs(change) DESC, event_id) AS rank FROM s WHERE side IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY side DESC, rank) AS position FROM r WHERE rank <= 5)
SELECT user_id, event_id, change, side, CAST(rank AS INTEGER) AS rank, CAST(position AS INTEGER) AS position FROM b WHERE position <= 8""")
def top_loss_gain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = events(spark, d)
    change = F.col("cents") - F.lag("cents").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    ranked = sets.top_changes(e.select("user_id", "event_id", change.alias("change")), U, "change", "event_id")
    return sets.observation_budget(ranked, U).select("user_id", "event_id", "change", "side", "rank", "position")


@query("""f AS (SELECT user_id, count(*) / nullif(max(t) - min(t), 0) * 1e9 AS hz, min(event_id) AS start_byte, user_id % 7 AS replay FROM ev GROUP BY user_id),
r AS (SELECT replay, user_id, row_number() OVER (PARTITION BY replay ORDER BY hz DESC, start_byte) - 1 AS shadow FROM f)
SELECT replay, user_id, CAST(shadow AS INTEGER) AS shadow, CASE WHEN shadow = 0 THEN 'local_high_frequency' ELSE 'network_low_frequency' END AS role FROM r""")
def role_assignment(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("user_id").agg((F.try_divide(F.count("*"), F.max("t") - F.min("t")) * 1e9).alias("hz"), F.min("event_id").alias("start_byte"))
    return sets.assign_roles(e.withColumn("replay", F.col("user_id") % 7), ["replay"]).select("replay", "user_id", "shadow", "role")


@query("""s AS (SELECT user_id, event_id, 1e6 + 2.5e5 * (event_type = 'click')::INT + 1e5 * (event_type = 'view')::INT + 1e4 * (k % 10) + 1e3 * (k % 3) + 100 * (k / 100.0) + (k % 5) AS score FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM s)
SELECT user_id, event_id, round_even(score * 1000, 0) / 1000 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    c = {"marker": F.col("event_type") == "click", "effect": F.col("event_type") == "view", "effect_records": k % 10, "matches": k % 3, "share": k / 100.0, "intervals": k % 5}
    e = events(spark, d).withColumn("score", sets.drift_candidate_score({n: x.cast("int") if n in ("marker", "effect") else x for n, x in c.items()}))
    return sets.keep_best(e, U, F.col("score"), ["event_id"], 8).select("user_id", "event_id", round_even(F.col("score"), 3).alias("score"), "rank")


@query("""c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS n24, count(*) FILTER (event_type = 'purchase') AS n19, count(*) FILTER (event_type = 'signup' AND k < 20) AS cw FROM ev GROUP BY user_id),
u AS (SELECT *, n19 AS wcw, least(n19, greatest(0, n24 - cw)) AS consumed FROM c)
SELECT *, n24 - cw - consumed AS cww, cw + wcw + (n24 - cw - consumed) = n24 AS consistent FROM u""")
def marker_accounting(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    c = events(spark, d).groupBy("user_id").agg(F.count_if(t == "click").alias("n24"), F.count_if(t == "purchase").alias("n19"), F.count_if((t == "signup") & (F.col("k") < 20)).alias("cw"))
    return agg.marker_accounting(c)
