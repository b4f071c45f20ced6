"""Queries of the order-dependent operators and byte decoders, which SQL doesn't express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import comparison as cmp
from .operators import matching, sections
from .operators import sequences as seq
from .functions.scalar import round_even
from .queries_native import greedy_sql
from .registry import HOUR, events, query
from .storage import kept

U, ORDER = ["user_id"], ["t", "event_id"]


@query("RECURSIVE src AS (SELECT user_id, event_id AS i, CAST(t AS DOUBLE) AS t, event_type AS c FROM ev WHERE event_type IN ('click', 'purchase', 'error')), " + greedy_sql("c = 'click'", "c = 'purchase'", "c <> 'click'", 12 * HOUR) + " SELECT * FROM pairs")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return matching.greedy_pairs(events(spark, d), U, "event_id", "t", kind == "click", kind == "purchase", kind.isin("purchase", "error"), 12 * HOUR)


@query()
def combo_sequences(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("t", F.col("t") / 36_000_000)
    return matching.combo_sequences(e.where("event_type = 'purchase'"), e.where("event_type = 'click'").withColumn("drift_id", F.lit(1)), U)


@query("""RECURSIVE p AS (SELECT user_id AS replay, user_id * 100000 + t // 86400000000 AS part_id, min(t) / 864e9 AS t0, max(t) / 864e9 AS t1, CAST(count(*) AS DOUBLE) AS hz, CAST(arg_min(k, t) AS DOUBLE) AS x0, CAST(arg_max(k, t) AS DOUBLE) AS x1 FROM ev GROUP BY user_id, t // 86400000000),
o AS (SELECT *, row_number() OVER (PARTITION BY replay ORDER BY t0, t1, part_id) AS n FROM p),
g AS (SELECT DISTINCT replay, 0::BIGINT AS n, CAST([] AS STRUCT(t DOUBLE, x DOUBLE, hz DOUBLE)[]) AS v, 0::BIGINT AS part_id, 0::BIGINT AS vehicle FROM p
  UNION ALL SELECT replay, n, CASE WHEN best IS NULL THEN list_append(v, struct_pack(t := t1, x := x1, hz := hz))
      ELSE list_concat(v[:best - 1], [struct_pack(t := t1, x := x1, hz := (v[best].hz + hz) / 2)], v[best + 1:]) END, part_id, coalesce(best - 1, len(v))
  FROM (SELECT g.replay, o.n, g.v, o.part_id, o.t1, o.x1, o.hz, list_sort(list_filter(list_transform(range(1, len(g.v) + 1), lambda k: struct_pack(score := abs(g.v[k].x - o.x0) + 5 * abs(o.t0 - g.v[k].t) + abs(o.hz - g.v[k].hz), k := k)),
      lambda c: o.t0 - g.v[c.k].t BETWEEN -0.06 AND 0.35 AND abs(o.hz - g.v[c.k].hz) <= 1.5 AND abs(g.v[c.k].x - o.x0) <= 3 + 30 * greatest(o.t0 - g.v[c.k].t, 0)))[1].k AS best
    FROM g JOIN o ON o.replay = g.replay AND o.n = g.n + 1))
SELECT replay, part_id, vehicle FROM g WHERE n > 0""")
def part_stitching(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    day = e.groupBy(F.col("user_id").alias("replay"), F.col("user_id"), F.expr("t div 86400000000").alias("part_id")).agg(
        (F.min("t") / 864e9).alias("t0"), (F.max("t") / 864e9).alias("t1"), F.count("*").cast("double").alias("hz"), F.min_by("k", "t").cast("double").alias("x0"), F.max_by("k", "t").cast("double").alias("x1"),
    )
    day = day.withColumns({"part_id": F.col("user_id") * 100000 + F.col("part_id"), "y0": F.lit(0.0), "z0": F.lit(0.0), "y1": F.lit(0.0), "z1": F.lit(0.0)})
    return matching.stitch_parts(day, ["replay"])


def _laps(spark: SparkSession, d: str) -> DataFrame:
    """Users as laps on a plane: distance along x, code across it."""
    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = e.withColumns({"distance": F.row_number().over(w) * 4.0, "x": F.row_number().over(w) * 4.0, "y": F.col("k") / 20.0, "time_s": F.col("t") / 1e6, "pose_valid": F.lit(True), "break_before": F.lit(False)})
    return e


_LAPS_SQL = "p AS (SELECT user_id, event_id, t, t / 1e6 AS time_s, k / 20.0::DOUBLE AS y, 4.0::DOUBLE * row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS x FROM ev)"


@query(_LAPS_SQL + """, q AS (SELECT *, lead(x) OVER o AS x1, lead(time_s) OVER o AS t1, lead(y) OVER o AS y1, 4.0::DOUBLE AS d0, greatest(4.0::DOUBLE, (max(x) OVER (PARTITION BY user_id) - 4.0::DOUBLE) / 180) AS step
  FROM p WINDOW o AS (PARTITION BY user_id ORDER BY x)),
g AS (SELECT *, unnest(generate_series(CAST(ceil((x - d0) / step) AS BIGINT), CAST(ceil((x1 - d0) / step) AS BIGINT) - 1)) AS n FROM q WHERE x1 IS NOT NULL),
h AS (SELECT *, d0 + n * step AS d, (d0 + n * step - x) / (x1 - x) AS share FROM g)
SELECT user_id, 1 AS block, round_even(d * 1e6, 0) / 1e6 AS d, round_even((time_s + (t1 - time_s) * share) * 1000, 0) / 1000 AS time_s, round_even((x + (x1 - x) * share) * 1e6, 0) / 1e6 AS x, round_even((y + (y1 - y) * share) * 1e6, 0) / 1e6 AS y FROM h
UNION ALL SELECT user_id, 1, x, round_even(time_s * 1000, 0) / 1000, x, round_even(y * 1e6, 0) / 1e6 FROM q WHERE x1 IS NULL""")
def control_points(spark: SparkSession, d: str) -> DataFrame:
    p = seq.control_points(_laps(spark, d), U, ORDER)
    return p.select("user_id", "block", *[round_even(F.col(c), n).alias(c) for c, n in (("d", 6), ("time_s", 3), ("x", 6), ("y", 6))])


@query()
def trajectory_alignment(spark: SparkSession, d: str) -> DataFrame:
    p = seq.control_points(_laps(spark, d), U, ORDER).withColumn("pair", F.expr("user_id div 2"))
    return matching.align_trajectories(p.where("user_id % 2 = 0"), p.where("user_id % 2 = 1"), ["pair"])


@query()
def shared_progress(spark: SparkSession, d: str) -> DataFrame:
    pairs = kept(trajectory_alignment(spark, d))  # two tables below are made of it
    points = pairs.select("pair", (F.col("a_progress") + 0.001).alias("u"))
    return cmp.to_shared(points, pairs, ["pair"], "u")


@query()
def hysteresis_sections(spark: SparkSession, d: str) -> DataFrame:
    samples = seq.resample(_laps(spark, d), U, ORDER, "distance", ["x", "y"], 1.0)
    return sections.hysteresis_sections(seq.turn_signal(samples, U), U)


@query()
def corner_pairing(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'click'")
    w = Window.partitionBy("user_id")
    # a user of one moment has no progress: NULL, not a division by zero
    span = F.nullif(F.max("t").over(w) - F.min("t").over(w), F.lit(0))
    c = e.select("user_id", F.col("event_id").alias("corner"), ((F.col("t") - F.min("t").over(w)) / span).alias("s_start")).withColumn("pair", F.expr("user_id div 2"))
    return matching.pair_corners(c.where("user_id % 2 = 0"), c.where("user_id % 2 = 1"), ["pair"])


@query("""RECURSIVE c AS (SELECT user_id, t / 1e9 AS s_lo, t / 1e9 + k / 10.0::DOUBLE AS s_hi, t / 1e9 + k / 5.0::DOUBLE AS final_hi, lead(t / 1e9) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next_start FROM ev WHERE event_type = 'click'),
o AS (SELECT *, CASE WHEN next_start > s_lo + 1e-9 THEN next_start ELSE 'infinity'::DOUBLE END AS cut, row_number() OVER (PARTITION BY user_id ORDER BY s_lo, s_hi) AS n FROM c),
r AS (SELECT user_id, 0::BIGINT AS n, '-infinity'::DOUBLE AS before, 0::BIGINT AS window_no, false AS made, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS fin, false AS c1, false AS c2 FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT r.user_id, o.n, CASE WHEN least(s_hi, cut) > greatest(s_lo, before) + 1e-9 THEN least(s_hi, cut) ELSE before END,
    r.window_no + CASE WHEN least(s_hi, cut) > greatest(s_lo, before) + 1e-9 THEN 1 ELSE 0 END, least(s_hi, cut) > greatest(s_lo, before) + 1e-9,
    greatest(s_lo, before), least(s_hi, cut), greatest(least(final_hi, cut), least(s_hi, cut)), s_hi > cut + 1e-9, final_hi > cut + 1e-9 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, window_no, 'paired_corner' AS source, lo AS s_start, hi AS s_end, fin AS final_end, c1 AS cut_applied, c2 AS final_cut_applied FROM r WHERE made""")
def corner_windows(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).where("event_type = 'click'")
    t = F.col("t") / 1e9
    nxt = F.lead(t).over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    c = e.select("user_id", t.alias("s_lo"), (t + F.col("k") / 10).alias("s_hi"), (t + F.col("k") / 5).alias("final_hi"), nxt.alias("next_start"), F.lit("paired_corner").alias("source"))
    return cmp.corner_windows(c, U)


@query(_LAPS_SQL + """, i AS (SELECT user_id, x, y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p),
s AS (SELECT * FROM i WHERE i % greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) = 0),
t AS (SELECT DISTINCT user_id, floor(x / 50) * 50 AS x0 FROM p),
z AS (SELECT s.user_id, s.i, coalesce(bool_or(50 * s.y >= -0.35 AND -50 * s.y - 6 * (s.x - t.x0) + 300 >= -0.35 AND 6 * (s.x - t.x0) >= -0.35), false) AS inside
  FROM s JOIN t ON t.user_id = s.user_id GROUP BY ALL)
SELECT user_id, avg(CAST(inside AS INTEGER)) AS coverage, count(*) AS sampled FROM z GROUP BY user_id""")
def surface_coverage(spark: SparkSession, d: str) -> DataFrame:
    laps = _laps(spark, d).withColumn("i", F.col("event_id"))
    w = F.floor(F.col("x") / 50) * 50.0
    tri = laps.select("user_id", w.alias("x0")).distinct()
    tri = tri.select("user_id", F.xxhash64("user_id", "x0").alias("tri_id"), F.col("x0").alias("ax"), F.lit(0.0).alias("ay"), (F.col("x0") + 50).alias("bx"), F.lit(0.0).alias("by"), F.col("x0").alias("cx"), F.lit(6.0).alias("cy"))
    return sections.coverage(laps.select("user_id", "i", "x", "y"), tri, U, U)
