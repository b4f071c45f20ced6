"""Queries of catalog entries, measures of sections and corners, and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scalar import round_even
from .operators import aggregates as agg
from .operators import catalogs, comparison, measures, temporal
from .operators import sequences as seq
from .queries_events import EFFECTS, SEGMENTS, TOGGLES
from .registry import HOUR, events, query, table
from .sources import maps
from .plans import analysis

U, ORDER = ["user_id"], ["t", "event_id"]


@query("""d AS (SELECT p_partkey % 40 AS map_id, CASE WHEN p_partkey % 7 = 0 THEN '??' ELSE 'name' || (p_partkey % 41 // 21) END AS name, 'm' || (p_partkey % 3) AS md5 FROM part),
f AS (SELECT s_suppkey % 50 AS map_id FROM supplier), u AS (SELECT map_id, list_sort(list(DISTINCT name)) AS names, count(DISTINCT md5) AS n FROM d WHERE length(translate(name, '? ', '')) > 0 GROUP BY map_id),
i AS (SELECT map_id FROM d UNION SELECT map_id FROM f), c AS (SELECT map_id, count(*) AS n_files FROM f GROUP BY map_id)
SELECT i.map_id, array_to_string(u.names, ',') AS all_names, CASE WHEN names IS NULL THEN 'unavailable' WHEN len(names) > 1 THEN 'multiple' WHEN n = 1 THEN 'exact' ELSE 'single' END AS name_status,
  names[1] AS primary_name, coalesce(n_files, 0) AS files_count, coalesce(n_files, 0) > 0 AS has_files FROM i LEFT JOIN u USING (map_id) LEFT JOIN c USING (map_id)""")
def map_catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    desc = table(spark, d, "part").select((k % 40).alias("map_id"), F.when(k % 7 == 0, "??").otherwise(F.concat(F.lit("name"), F.expr("p_partkey % 41 div 21"))).alias("name"), F.concat(F.lit("m"), k % 3).alias("md5"))
    files = table(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("map_id"))
    return catalogs.catalog_entries(desc, {"files": files}).withColumn("all_names", F.array_join("all_names", ","))


@query("""a AS (SELECT n_nationkey AS map_id FROM nation), b AS (SELECT s_suppkey % 40 + 10 AS map_id FROM supplier), x AS (SELECT map_id, count(*) AS n FROM a GROUP BY 1), y AS (SELECT map_id, count(*) AS n FROM b GROUP BY 1)
SELECT coalesce(x.map_id, y.map_id) AS map_id, coalesce(x.n, 0) AS nodes_count, coalesce(y.n, 0) AS packages_count, x.n IS NOT NULL AS has_nodes, y.n IS NOT NULL AS has_packages FROM x FULL JOIN y ON x.map_id = y.map_id""")
def union_index(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("map_id"))
    packages = table(spark, d, "supplier").select((F.col("s_suppkey") % 40 + 10).alias("map_id"))
    return maps.union_index(nodes=nodes, packages=packages)


@query("""i AS (SELECT user_id, event_id AS iid, t AS start_t, t + CAST(k AS BIGINT) * 60000000 AS end_t FROM ev WHERE event_type = 'view')
SELECT e.user_id, e.event_id, i.iid FROM ev e JOIN i ON e.user_id = i.user_id AND e.t >= i.start_t AND e.t < i.end_t""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    iv = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("iid"), F.col("t").alias("start_t"), (F.col("t") + F.col("k").cast("long") * 60_000_000).alias("end_t"))
    return temporal.range_join(e.select("user_id", "event_id", "t"), iv, U, "t", width=HOUR, closed_end=False).select("user_id", "event_id", "iid")


@query("""r AS (SELECT *, t // 86400000000 AS day FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY t, event_id) AS a, row_number() OVER (PARTITION BY user_id, day ORDER BY t DESC, event_id DESC) AS z FROM r),
g AS (SELECT user_id, day, avg(cents) FILTER (a <= 8) AS entry, avg(cents) FILTER (z <= 8) AS exit, min(cents) AS low, quantile_cont(cents, 0.2) AS p20, avg(cents) AS mean, max(cents) AS high, max(t) - min(t) AS duration,
  max(event_id) - min(event_id) AS length, arg_max(k - 50, (abs(k - 50), k)) AS turn_deg, max(abs(k - 50)) AS peak_deg FROM n GROUP BY user_id, day),
e AS (SELECT *, 0.45 * greatest(0.0, least(1.0, CASE WHEN high > 0 THEN p20 / high ELSE 0.0 END)) + 0.20 * greatest(0.0, least(1.0, CASE WHEN high > 0 THEN mean / high ELSE 0.0 END)) + 0.35 * greatest(0.0, least(1.0, CASE WHEN entry > 0 THEN exit / entry ELSE 0.0 END)) AS eff FROM g)
SELECT user_id, day, round_even(entry * 100, 0) / 100 AS entry, round_even(exit * 100, 0) / 100 AS exit, low, round_even(p20 * 100, 0) / 100 AS p20, high, duration, length, peak_deg, CASE WHEN peak_deg >= 8 THEN 'turn' ELSE 'straight' END AS kind, round_even(eff * 1e6, 0) / 1e6 AS efficiency FROM e""")
def section_measures(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"day": F.expr("t div 86400000000"), "turn": F.col("k") - 50})
    m = agg.section_measures(e, ["user_id", "day"], ORDER, "cents", "t", "event_id", "turn", "turn")
    m = m.withColumns({c: round_even(F.col(c), 2) for c in ("entry", "exit", "p20")} | {"efficiency": round_even(F.col("efficiency"), 6)})
    return m.select("user_id", "day", "entry", "exit", "low", "p20", "high", "duration", "length", "peak_deg", "kind", "efficiency")


@query("""s AS (SELECT user_id, event_id AS corner, t AS drift_start, t + 36000000000 AS drift_end, CASE WHEN k % 2 = 0 THEN t + 72000000000 END AS recovery_end FROM ev WHERE event_type = 'click'),
r AS (SELECT user_id, t, cents, sum(cents) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS distance, median(cents) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM ev),
j AS (SELECT s.*, r.t, r.cents, r.distance, r.m, r.t <= drift_end AS d, recovery_end IS NOT NULL AND r.t >= drift_end AS a FROM s JOIN r ON r.user_id = s.user_id AND r.t BETWEEN drift_start AND coalesce(recovery_end, drift_end))
SELECT user_id, corner, arg_min(m, t) AS entry_speed, min(cents) FILTER (d) AS min_speed, max(cents) FILTER (a) AS exit_speed, max(distance) FILTER (d) - min(distance) FILTER (d) AS drift_distance,
  max(distance) FILTER (a) - min(distance) FILTER (a) AS recovery_distance, max(distance) - min(distance) AS total_distance FROM j GROUP BY user_id, corner""")
def corner_measures(spark: SparkSession, d: str) -> DataFrame:
    e = seq.cumulative(events(spark, d), U, ORDER, "cents", "distance").withColumn("speed", F.col("cents"))
    w = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("corner"), F.col("t").alias("drift_start"), (F.col("t") + 10 * HOUR).alias("drift_end"), F.when(F.col("k") % 2 == 0, F.col("t") + 20 * HOUR).alias("recovery_end"))
    m = comparison.corner_measures(w, e, U, "corner", width=20 * HOUR)
    return m.drop("drift_start", "drift_end", "recovery_end")


@query("""p AS (SELECT user_id // 2 AS pair, count(*) FILTER (event_type = 'click' AND user_id % 2 = 0) AS pairs, count(*) FILTER (user_id % 2 = 0) AS subject_points, count(*) FILTER (user_id % 2 = 1) AS baseline_points FROM ev GROUP BY 1)
SELECT *, pairs / nullif(subject_points, 0) AS subject_coverage, pairs / nullif(baseline_points, 0) AS baseline_coverage,
  least(pairs / nullif(subject_points, 0), pairs / nullif(baseline_points, 0)) AS coverage, least(pairs / nullif(subject_points, 0), pairs / nullif(baseline_points, 0)) < 0.2 AS degraded FROM p""")
def comparison_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("pair", F.expr("user_id div 2"))
    points = e.groupBy("pair").agg(F.count_if(F.col("user_id") % 2 == 0).alias("subject_points"), F.count_if(F.col("user_id") % 2 == 1).alias("baseline_points"))
    return comparison.comparison_coverage(e.where("event_type = 'click' and user_id % 2 = 0"), points, ["pair"])


@query("""w AS (SELECT *, value > 100 AS b, lead(value > 100, 1, false) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b1, CASE WHEN value BETWEEN 0 AND 9999.999 THEN value END AS good FROM ev),
m AS (SELECT *, quantile_cont(good, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 7 PRECEDING AND 2 PRECEDING) AS before, quantile_cont(good, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS after FROM w),
e AS (SELECT *, lead(before) OVER (PARTITION BY user_id ORDER BY t, event_id) AS early FROM m)
SELECT user_id, event_id, NOT (b OR b1) AS pose_valid, round_even((CASE WHEN k % 5 = 0 THEN value WHEN b THEN coalesce(after, 0) WHEN b1 THEN coalesce(early, 0) ELSE value END) * 1e6, 0) / 1e6 AS speed_fixed FROM e""")
def pose_repair(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("k") % 5 == 0, "replay_linear_velocity").otherwise("position_derived")
    e = events(spark, d).withColumns({"speed": F.col("value"), "speed_source": source, "break_before": F.col("value") > 100})
    return seq.repair_breaks(e, U, ORDER).select("user_id", "event_id", "pose_valid", round_even(F.col("speed_fixed"), 6).alias("speed_fixed"))


@query("""l AS (SELECT user_id, t // 604800000000 AS lap, count(*) FILTER (event_type = 'view') AS n, max(t) - min(t) AS span FROM ev GROUP BY ALL)
SELECT user_id, arg_min(lap, (-n, span, lap)) AS lap FROM l WHERE n > 0 GROUP BY user_id""")
def representative_lap(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("user_id").alias("replay_sha"), F.lit(0).alias("stream"), F.expr(f"t div {168 * HOUR}").alias("lap_index"), "t", "event_type")
    spans = e.groupBy("replay_sha", "stream", "lap_index").agg((F.max("t") - F.min("t")).alias("span"))
    return analysis.representative_lap(e.where("event_type = 'view'"), spans).select(F.col("replay_sha").alias("user_id"), F.col("lap_index").alias("lap"))


DAY = 24 * HOUR
WEEK = 7 * DAY


@query(f"""{EFFECTS}, r AS (SELECT user_id, t, cents, abs(k - 50) AS slip, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS d FROM ev),
c AS (SELECT user_id, min(d) AS d0, max(d) - min(d) AS total FROM r GROUP BY user_id),
m AS (SELECT e.user_id, e.event_id, e.start_t, e.end_t, arg_min(r.cents, (abs(r.t - e.start_t), r.t)) AS entry_speed, arg_min(r.d, (abs(r.t - e.start_t), r.t)) AS a, arg_min(r.cents, (abs(r.t - e.end_t), r.t)) AS exit_speed, arg_min(r.d, (abs(r.t - e.end_t), r.t)) AS b,
  min(r.cents) FILTER (r.t BETWEEN e.start_t AND e.end_t) AS min_speed, max(r.cents) FILTER (r.t BETWEEN e.start_t AND e.end_t) AS max_speed, max(slip) FILTER (r.t BETWEEN e.start_t AND e.end_t) AS peak_slip,
  avg(slip) FILTER (r.t BETWEEN e.start_t AND e.end_t) AS mean_slip, count(*) FILTER (r.t BETWEEN e.start_t AND e.end_t) AS n_rows FROM eff e JOIN r USING (user_id) GROUP BY ALL)
SELECT user_id, event_id, start_t, end_t, entry_speed, exit_speed, min_speed, max_speed, peak_slip, round_even(mean_slip * 1e4, 0) / 1e4 AS mean_slip, n_rows, b - a AS length,
  round_even(CASE WHEN total <> 0 THEN (a - d0) / total END * 1e6, 0) / 1e6 AS start_progress, round_even(CASE WHEN total <> 0 THEN (b - d0) / total END * 1e6, 0) / 1e6 AS end_progress FROM m JOIN c USING (user_id)""")
def interval_measures(spark: SparkSession, d: str) -> DataFrame:
    e = seq.cumulative(events(spark, d).withColumn("slip", F.col("k") - 50), U, ORDER, "cents", "distance")
    e = e.withColumn("distance", F.col("distance").cast("long"))
    iv = e.select("user_id", "event_id", F.col("t").alias("start_t"), (F.col("t") + F.col("k").cast("long") * 360_000_000).alias("end_t"))
    m = measures.measure_intervals(iv, e, U, "event_id", "t", "cents", "distance", "slip", width=6 * HOUR)
    return m.withColumns({"mean_slip": round_even(F.col("mean_slip"), 4)} | {c: round_even(F.col(c), 6) for c in ("start_progress", "end_progress")})


@query(f"""{EFFECTS}, w AS (SELECT user_id, day, day * {DAY} AS start_t, (day + 1) * {DAY} AS end_t, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1 AS closed_end FROM (SELECT DISTINCT user_id, t // {DAY} AS day FROM ev)),
s AS (SELECT w.user_id, w.day, arg_min(cents, (t, event_id)) AS entry_speed, min(cents) AS min_speed, arg_max(cents, (t, event_id)) AS exit_speed, avg(cents) AS avg_speed FROM w JOIN ev ON ev.user_id = w.user_id AND t >= start_t AND (t < end_t OR closed_end AND t <= end_t) GROUP BY ALL),
n AS (SELECT w.user_id, w.day, count(*) AS episodes, CAST(sum(e.end_t - e.start_t) AS BIGINT) AS episode_time FROM w JOIN eff e ON e.user_id = w.user_id AND e.start_t >= w.start_t AND (e.start_t < w.end_t OR closed_end AND e.start_t <= w.end_t) GROUP BY ALL)
SELECT w.*, entry_speed, min_speed, exit_speed, round_even(avg_speed * 1e4, 0) / 1e4 AS avg_speed, coalesce(episodes, 0) AS episodes, coalesce(episode_time, 0) AS episode_time FROM w LEFT JOIN s USING (user_id, day) LEFT JOIN n USING (user_id, day)""")
def window_measures(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    w = e.select("user_id", F.expr(f"t div {DAY}").alias("day")).distinct().withColumns({"start_t": F.col("day") * DAY, "end_t": (F.col("day") + 1) * DAY})
    iv = e.select("user_id", F.col("t").alias("start_t"), (F.col("t") + F.col("k").cast("long") * 360_000_000).alias("end_t"))
    return measures.measure_windows(w, e, iv, U, "day", ORDER, "cents", width=DAY).withColumn("avg_speed", round_even(F.col("avg_speed"), 4))


@query(f"""{SEGMENTS} SELECT user_id, start_t // {WEEK} AS week, string_agg(segment::VARCHAR, ',' ORDER BY segment) AS segments, count(*) AS n_segments, CAST(sum(members) AS BIGINT) AS n_members, count(*) FILTER (end_t // {WEEK} <> start_t // {WEEK}) AS n_crossing FROM seg GROUP BY ALL""")
def segment_owners(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'view'")
    iv = e.select("user_id", F.col("t").alias("start_t"), (F.col("t") + F.col("k").cast("long") * 360_000_000).alias("end_t"))
    s = seq.merge_segments(iv, U, 6 * HOUR).withColumns({"week": F.expr(f"start_t div {WEEK}"), "week_end": F.expr(f"end_t div {WEEK}")})
    return measures.segments_by_owner(s, U, "week", "week_end", "segment", "members").withColumn("segments", F.array_join("segments", ","))


@query(f"""{EFFECTS} SELECT user_id, coalesce(string_agg(start_t::VARCHAR, ',' ORDER BY start_t) FILTER (event_type = 'click'), '') AS click_starts, coalesce(string_agg(start_t::VARCHAR, ',' ORDER BY start_t) FILTER (event_type = 'error'), '') AS error_starts,
  CAST(count(*) FILTER (event_type = 'click') AS INTEGER) AS n_click, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS n_error FROM eff GROUP BY user_id""")
def effect_starts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("start_t", F.col("t"))
    out = measures.starts_by_kind(e, U, {n: F.col("event_type") == n for n in ("click", "error")})
    return out.withColumns({c: F.array_join(c, ",") for c in ("click_starts", "error_starts")})


@query(f"""x AS (SELECT user_id, t // {DAY} AS day, arg_min(cents, (t, event_id)) AS entry, min(cents) AS least, arg_max(cents, (t, event_id)) AS exit, max(t) - min(t) AS duration FROM ev GROUP BY ALL)
SELECT user_id, day // 7 AS week, count(*) AS episodes, CAST(sum(duration) AS BIGINT) AS duration, median(entry) AS entry, median(least) AS least, median(exit) AS exit, median(exit) - median(least) AS recovery FROM x GROUP BY ALL""")
def lap_episode_medians(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("t", "event_id")
    x = events(spark, d).groupBy("user_id", F.expr(f"t div {DAY}").alias("day")).agg(F.min_by("cents", at).alias("entry"), F.min("cents").alias("least"), F.max_by("cents", at).alias("exit"), (F.max("t") - F.min("t")).alias("duration"))
    return measures.episode_medians(x.withColumn("week", F.expr("day div 7")), ["user_id", "week"], "entry", "least", "exit", "duration")


@query(f"""{TOGGLES}, f AS (SELECT o.user_id, o.t AS start_t, c.t AS end_t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev WHERE event_type = 'click') o
  JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev WHERE event_type = 'purchase') c ON o.user_id = c.user_id AND o.n = c.n WHERE c.t >= o.t),
a AS (SELECT user_id, start_t, end_t FROM toggles)
SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM f) UNION ALL SELECT *, 'derived' FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM a)""")
def rederived_intervals(spark: SparkSession, d: str) -> DataFrame:
    e, kind = events(spark, d), F.col("event_type")
    stored = seq.alternating_pairs(e, U, ORDER, "t").select("user_id", "start_t", "end_t")
    derived = seq.fifo_pairs(e, U, ORDER, "t", kind == "click", kind == "purchase").where("valid").select("user_id", "start_t", "end_t")
    return measures.differences(stored, derived)


@query("""SELECT coalesce(o_orderpriority, 'unknown') AS status, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_ids, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return measures.summary(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


_SPANS_SQL = "p AS (SELECT user_id, event_id, t, k, t // 86400000000 AS day, t / 1e6 AS time_s, k / 20.0::DOUBLE AS y, 4.0::DOUBLE * row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS x FROM ev)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Users' days as sections of a route: distance along x, code across it."""
    along = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) * 4.0
    return events(spark, d).select("user_id", "event_id", "t", "k", F.expr("t div 86400000000").alias("day"), (F.col("t") / 1e6).alias("time_s"), (F.col("k") / 20.0).alias("y"), along.alias("x"))


@query("""s AS (SELECT user_id, t // 86400000000 AS day, min(t) AS start_t, max(t) AS end_t FROM ev GROUP BY ALL),
e AS (SELECT user_id, t AS es, t + k * 10000000 AS ee, CASE WHEN k % 3 > 0 THEN k * 10 END AS l, k % 2 AS boosts FROM ev WHERE event_type = 'click')
SELECT s.user_id, s.day, s.start_t, s.end_t, count(es) AS drifts, CAST(coalesce(sum(least(end_t, ee) - greatest(start_t, es)) FILTER (es IS NOT NULL), 0) AS BIGINT) AS drift_time, CAST(coalesce(sum(boosts), 0) AS BIGINT) AS boosts, count(l) AS latencies,
  CAST(round_even(quantile_cont(l, 0.5), 0) AS BIGINT) AS latency_median, CAST(round_even(quantile_cont(l, 0.9), 0) AS BIGINT) AS latency_p90, min(l) AS latency_min, max(l) AS latency_max
FROM s LEFT JOIN e ON e.user_id = s.user_id AND es < end_t AND ee > start_t GROUP BY s.user_id, s.day, s.start_t, s.end_t""")
def section_native(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    found = e.groupBy("user_id", F.expr("t div 86400000000").alias("day")).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"))
    drifted = e.where("event_type = 'click'").select("user_id", F.col("t").alias("start_t"), (F.col("t") + F.col("k") * 10_000_000).alias("end_t"), F.when(F.col("k") % 3 > 0, F.col("k") * 10).alias("latency_ms"), (F.col("k") % 2).alias("boosts"))
    return measures.section_native(found, drifted, ["user_id"], "day", 6 * HOUR, ["boosts"])


@query(_SPANS_SQL + """, q AS (SELECT *, lead(x) OVER w AS x1, lead(time_s) OVER w AS t1, lead(y) OVER w AS y1, lead(k) OVER w AS k1, min(x) OVER (PARTITION BY user_id, day) AS d0,
  greatest(2.5::DOUBLE, (max(x) OVER (PARTITION BY user_id, day) - min(x) OVER (PARTITION BY user_id, day)) / 64) AS step, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id, day ORDER BY x)),
g AS (SELECT *, unnest(generate_series(CASE WHEN n = 1 THEN 0 ELSE CAST(floor((x - d0) / step) AS BIGINT) + 1 END, CAST(least(floor((x1 - d0) / step), 63) AS BIGINT))) AS point FROM q WHERE x1 IS NOT NULL AND k % 9 > 0 AND k1 % 9 > 0 AND k1 % 5 > 0),
h AS (SELECT *, d0 + point * step AS d, (d0 + point * step - x) / (x1 - x) AS share FROM g)
SELECT user_id, day, point, round_even(d * 1000, 0) / 1000 AS d, round_even((time_s + (t1 - time_s) * share) * 1000, 0) / 1000 AS time_s, round_even((y + (y1 - y) * share) * 1e6, 0) / 1e6 AS y FROM h""")
def section_trajectory(spark: SparkSession, d: str) -> DataFrame:
    got = measures.section_trajectory(_spans(spark, d), ["user_id", "day"], ["x"], "x", ["time_s", "y"], valid=F.col("k") % 9 > 0, broken=F.col("k") % 5 == 0)
    return got.select("user_id", "day", "point", round_even(F.col("d"), 3).alias("d"), round_even(F.col("time_s"), 3).alias("time_s"), round_even(F.col("y"), 6).alias("y"))


@query(_SPANS_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY x) - 1 AS i, row_number() OVER (PARTITION BY user_id, day ORDER BY x DESC) - 1 AS j FROM p),
c AS (SELECT user_id, day, max(i) AS last, max(CASE WHEN i = 4 THEN x END) - max(CASE WHEN i = 0 THEN x END) AS ax, max(CASE WHEN i = 4 THEN y END) - max(CASE WHEN i = 0 THEN y END) AS ay,
  max(CASE WHEN j = 0 THEN x END) - max(CASE WHEN j = 4 THEN x END) AS bx, max(CASE WHEN j = 0 THEN y END) - max(CASE WHEN j = 4 THEN y END) AS b_y FROM n GROUP BY user_id, day)
SELECT user_id, day, round_even(CASE WHEN last >= 4 THEN degrees(atan2(ax * b_y - ay * bx, ax * bx + ay * b_y)) ELSE 0 END * 1e6, 0) / 1e6 AS heading_change FROM c""")
def heading_change(spark: SparkSession, d: str) -> DataFrame:
    got = measures.heading_change(_spans(spark, d), ["user_id", "day"], ["x"])
    return got.select("user_id", "day", round_even(F.col("heading_change"), 6).alias("heading_change"))


@query("""w AS (SELECT event_id, cents / 64.0::DOUBLE AS sc, k / 1.0::DOUBLE AS bc, CASE WHEN k % 7 > 0 THEN cents / 32.0::DOUBLE END AS sf, CASE WHEN k % 4 > 0 THEN k * 1.25::DOUBLE ELSE cents / 32.0::DOUBLE END AS bf FROM ev),
x AS (SELECT *, sc - bc AS core_delta, round_even((sf - bf) * 1e4, 0) / 1e4 AS final_delta FROM w), z AS (SELECT *, round_even((core_delta - final_delta) * 1e4, 0) / 1e4 AS subject_gain FROM x)
SELECT event_id, round_even(core_delta * 1e4, 0) / 1e4 AS core_delta, final_delta, subject_gain, round_even((sf - sc) * 1e4, 0) / 1e4 AS subject_tail, round_even((bf - bc) * 1e4, 0) / 1e4 AS baseline_tail,
  CASE WHEN abs(core_delta) <= 0.0005 THEN 'equal' WHEN core_delta > 0 THEN 'slower' ELSE 'faster' END AS core_direction,
  CASE WHEN final_delta IS NULL THEN 'unavailable' WHEN abs(final_delta) <= 0.0005 THEN 'equal' WHEN final_delta > 0 THEN 'slower' ELSE 'faster' END AS final_direction,
  CASE WHEN subject_gain IS NULL THEN 'unavailable' WHEN abs(subject_gain) <= 0.0005 THEN 'equal' WHEN subject_gain > 0 THEN 'subject_gain' ELSE 'subject_loss' END AS gain_direction FROM z""")
def strategy_deltas(spark: SparkSession, d: str) -> DataFrame:
    k, cents = F.col("k"), F.col("cents")
    w = events(spark, d).select("event_id", (cents / 64.0).alias("subject_core"), (k / 1.0).alias("baseline_core"), F.when(k % 7 > 0, cents / 32.0).alias("subject_final"), F.when(k % 4 > 0, k * 1.25).otherwise(cents / 32.0).alias("baseline_final"))
    got = comparison.strategy_deltas(w)
    return got.select("event_id", round_even(F.col("core_delta"), 4).alias("core_delta"), "final_delta", "subject_gain", "subject_tail", "baseline_tail", "core_direction", "final_direction", "gain_direction")


@query("""SELECT user_id % 4 AS catalog, upper(sha256(string_agg(event_type || '|' || event_id || '|' || cents || '|' || t, chr(10) ORDER BY event_type, event_id::VARCHAR))) AS source_signature, count(*) AS files FROM ev GROUP BY 1""")
def source_signature(spark: SparkSession, d: str) -> DataFrame:
    files = events(spark, d).select((F.col("user_id") % 4).alias("catalog"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("name"), F.col("cents").alias("length"), F.col("t").alias("modified"))
    return catalogs.source_signature(files, ("catalog",))


@query("""e AS (SELECT p_partkey AS map_id, CASE WHEN p_partkey % 5 > 0 THEN split_part(p_name, ' ', 1) END AS primary_name, CASE WHEN p_partkey % 5 = 0 THEN 'unavailable' WHEN p_partkey % 7 = 0 THEN 'multiple' ELSE 'exact' END AS name_status FROM part)
SELECT count(*) AS maps, count(primary_name) AS named_maps, count(*) - count(primary_name) AS unnamed_maps, count(*) FILTER (name_status = 'multiple') AS ambiguous_maps,
  (SELECT count(*) FROM (SELECT primary_name FROM e WHERE primary_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_names FROM e""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    entries = table(spark, d, "part").select(k.alias("map_id"), F.when(k % 5 > 0, F.substring_index("p_name", " ", 1)).alias("primary_name"), F.when(k % 5 == 0, "unavailable").when(k % 7 == 0, "multiple").otherwise("exact").alias("name_status"))
    return catalogs.catalog_summary(entries)


_CATALOG_SQL = """d AS (SELECT p_partkey % 40 AS map_id, CASE WHEN p_partkey % 7 = 0 THEN '??' WHEN p_partkey % 40 < 20 THEN 'Road ' || (p_partkey % 11) || CASE WHEN p_partkey % 2 = 0 THEN '-by-ann' ELSE '' END ELSE 'lane' || (p_partkey % 40) END AS name, p_partkey % 9 <> 0 AS parsed FROM part),
l AS (SELECT s_suppkey % 50 AS map_id, CASE WHEN s_suppkey % 6 = 0 THEN '???' WHEN s_suppkey % 4 = 0 THEN 'ROAD  3' ELSE 'lane' || (s_suppkey % 50) END AS name, s_suppkey % 50 + CASE WHEN s_suppkey % 10 = 0 AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS game_id FROM supplier),
ids AS (SELECT map_id FROM d UNION SELECT map_id FROM l),
dn AS (SELECT map_id, list_sort(list(DISTINCT name) FILTER (parsed AND length(translate(name, '? ', '')) > 0)) AS descriptor_names, count(*) AS versions, count(*) FILTER (NOT parsed) AS failures FROM d GROUP BY map_id),
ln AS (SELECT map_id, list_sort(list(DISTINCT name) FILTER (length(translate(name, '? ', '')) > 0)) AS usable, list_sort(list(DISTINCT name)) AS declared, list_sort(list(DISTINCT game_id)) AS game_ids FROM l GROUP BY map_id),
e AS (SELECT map_id, CASE WHEN len(usable) > 0 THEN usable ELSE descriptor_names END AS names, CASE WHEN len(usable) > 0 THEN 'declared' ELSE 'descriptor' END AS name_source, descriptor_names, game_ids, coalesce(versions, 0) AS versions, coalesce(failures, 0) AS failures FROM ids LEFT JOIN dn USING (map_id) LEFT JOIN ln USING (map_id)),
a AS (SELECT DISTINCT map_id, lower(trim(regexp_replace(n, '\\s+', ' ', 'g'))) AS name_key, lower(trim(regexp_replace(trim(regexp_replace(n, '(?i)[\\s_-]*by[-_ ].*$', '')), '\\s+', ' ', 'g'))) AS alias_key FROM (SELECT map_id, unnest(names) AS n FROM e)),
nk AS (SELECT name_key FROM a GROUP BY name_key HAVING count(DISTINCT map_id) > 1 AND name_key <> ''), ak AS (SELECT alias_key, array_to_string(list_sort(list(DISTINCT map_id)), ',') AS map_ids FROM a GROUP BY alias_key HAVING count(DISTINCT map_id) > 1 AND alias_key <> '')"""


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Descriptors and declared identities of maps, with names that differ by case, blanks and an author's mark."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    name = F.when(k % 7 == 0, "??").when(k % 40 < 20, F.concat(F.lit("Road "), k % 11, F.when(k % 2 == 0, "-by-ann").otherwise(""))).otherwise(F.concat(F.lit("lane"), k % 40))
    descriptors = table(spark, d, "part").select((k % 40).alias("map_id"), name.alias("name"), k.cast("string").alias("md5"), (k % 9 != 0).alias("parsed"))
    said = F.when(s % 6 == 0, "???").when(s % 4 == 0, "ROAD  3").otherwise(F.concat(F.lit("lane"), s % 50))
    declared = table(spark, d, "supplier").select((s % 50).alias("map_id"), said.alias("name"), (s % 50 + F.when((s % 10 == 0) & (s % 3 == 0), 1).otherwise(0)).alias("game_id"))
    return descriptors, declared


@query(_CATALOG_SQL + " SELECT alias_key AS alias_name, map_ids FROM ak")
def alias_collisions(spark: SparkSession, d: str) -> DataFrame:
    found = catalogs.alias_collisions(catalogs.identity_entries(*_catalog(spark, d)))
    return found.select("alias_name", F.array_join("map_ids", ",").alias("map_ids"))


@query(_CATALOG_SQL + """ SELECT (SELECT count(*) FROM e) AS map_id_count, (SELECT count(*) FROM e WHERE len(names) > 0) AS exact_named_map_count, (SELECT count(*) FROM e WHERE coalesce(len(names), 0) = 0) AS unnamed_map_count,
  (SELECT count(*) FROM nk) AS duplicate_name_count, (SELECT count(*) FROM ak) AS alias_collision_count, (SELECT count(*) FROM d) AS descriptor_version_count, (SELECT count(*) FROM d WHERE parsed) AS descriptor_exact_parse_count,
  (SELECT count(*) FROM l) AS declared_identity_record_count, (SELECT count(*) FROM e WHERE len(game_ids) = 1) AS declared_identity_map_count, (SELECT count(*) FROM e WHERE len(game_ids) > 1) AS declared_identity_conflict_count,
  (SELECT count(*) FROM e WHERE name_source = 'declared') AS declared_name_used_map_count, (SELECT count(*) FROM e WHERE name_source = 'declared' AND NOT coalesce(list_contains(descriptor_names, names[1]), false)) AS descriptor_name_stale_map_count""")
def catalog_meta(spark: SparkSession, d: str) -> DataFrame:
    descriptors, declared = _catalog(spark, d)
    return catalogs.catalog_meta(catalogs.identity_entries(descriptors, declared), descriptors, declared)
