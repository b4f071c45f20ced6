"""Window operators over ordered rows of one stream.

``keys`` name the stream (recording, vehicle); ``order`` the columns that order its rows. Every
operator shuffles on ``keys`` once; operators over the same keys and order share that shuffle.
Thresholds are parameters with the defaults of replay data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import angle_delta_deg, hypot3, round_even, wrap_pi
from .temporal import range_join


def _over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _median_over(value: str | Column, w) -> Column:
    """Median of the non-null values of a frame; NULL without any. Frames are a few rows wide."""
    v = F.array_sort(F.collect_list(value).over(w))
    n = F.size(v)
    at = lambda k: F.try_element_at(v, F.greatest(F.lit(1), F.floor((n + k) / 2)).cast("int"))
    return (at(1) + at(2)) / 2


def derivative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, time: str, out: str) -> DataFrame:
    """Central difference, one-sided at the ends; 0 where time doesn't advance."""
    w = _over(keys, order)
    v1, v0 = F.coalesce(F.lead(value).over(w), F.col(value)), F.coalesce(F.lag(value).over(w), F.col(value))
    t1, t0 = F.coalesce(F.lead(time).over(w), F.col(time)), F.coalesce(F.lag(time).over(w), F.col(time))
    return df.withColumn(out, F.when(t1 > t0, (v1 - v0) / (t1 - t0)).otherwise(0.0))


def steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], xyz: Sequence[str] = ("x", "y", "z"), time: str = "time_s") -> DataFrame:
    """Adds ``dt`` and ``step`` (3-D distance) from the row before; 0 on the first row."""
    w = _over(keys, order)
    d = [F.col(c) - F.lag(c).over(w) for c in xyz]
    return df.withColumns({"dt": F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0)), "step": F.coalesce(hypot3(*d), F.lit(0.0))})


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, out: str, skip: str | None = None) -> DataFrame:
    """Running sum of ``amount``; rows where ``skip`` holds add nothing."""
    add = F.col(amount) if skip is None else F.when(F.col(skip), 0).otherwise(F.col(amount))
    return df.withColumn(out, F.sum(add).over(_over(keys, order)))


def pose_breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: str = "step", yaw: str = "yaw", out: str = "break_before",
                reach: int = 8, soft: tuple[float, float] = (1.25, 5.0), hard: tuple[float, float] = (2.0, 8.0), jump: float = 0.45) -> DataFrame:
    """Flags edges that jump: longer than the soft limit, and with a turn or beyond the hard limit.

    Limits are the larger of a length and a multiple of the local median step, which leaves out the
    edge itself, its two neighbours and steps of no length.
    """
    w = _over(keys, order)
    moving = F.when((F.col(step) > 1e-6) & (F.row_number().over(w) > 1), F.col(step))
    base = df.withColumn("_moving", moving)
    sides = [F.collect_list("_moving").over(w.rowsBetween(a, b)) for a, b in ((-reach, -2), (2, reach))]
    near = F.array_sort(F.concat(*sides))
    n = F.size(near)
    middle = (F.element_at(near, F.floor((n + 1) / 2).cast("int")) + F.element_at(near, F.floor((n + 2) / 2).cast("int"))) / 2
    local = F.when(n > 0, middle).otherwise(0.0)
    turn = F.abs(wrap_pi(F.col(yaw) - F.lag(yaw).over(w)))
    over = lambda limit: F.col(step) > F.greatest(F.lit(limit[0]), limit[1] * local)
    flag = over(soft) & ((turn > jump) | over(hard)) & (F.row_number().over(w) > 1)
    return base.withColumn(out, F.coalesce(flag, F.lit(False))).drop("_moving")


def repair_breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], speed: str = "speed", source: str = "speed_source", broken: str = "break_before") -> DataFrame:
    """Adds ``pose_valid`` (false on both rows of a broken edge) and ``speed_fixed``.

    Only derived speeds are repaired: before the break by the median of rows i-7 to i-2 of the
    edge, after it by that of rows i+1 to i+6.
    """
    w = _over(keys, order)
    good = F.when(F.col(speed).between(0, 9999.999), F.col(speed))
    before = _median_over(good, w.rowsBetween(-7, -2))
    after = _median_over(good, w.rowsBetween(1, 6))
    base = df.withColumns({"_before": before, "_after": after})
    next_broken = F.coalesce(F.lead(broken).over(w), F.lit(False))
    # the first row of an edge is one row earlier than the edge's own frame
    early = F.lead("_before").over(w)
    fixed = F.when(F.col(broken), F.coalesce("_after", F.lit(0.0))).when(next_broken, F.coalesce(early, F.lit(0.0))).otherwise(F.col(speed))
    fixed = F.when(F.col(source) == "replay_linear_velocity", F.col(speed)).otherwise(fixed)
    return base.withColumns({"pose_valid": ~(F.col(broken) | next_broken), "speed_fixed": fixed}).drop("_before", "_after")


def movement_window(df: DataFrame, keys: Sequence[str], time: str, speed: str, valid: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a stream: first and last moving time, idle head and tail; NULL with a reason if none moves."""
    moving = F.col(speed) >= threshold
    moving = moving & valid if valid is not None else moving
    at = F.when(moving, F.col(time))
    out = df.groupBy(*keys).agg(
        F.min(at).alias("start_t"), F.max(at).alias("end_t"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("frames")
    )
    return out.select(
        *keys,
        F.col("start_t").isNotNull().alias("available"),
        F.when(F.col("start_t").isNull(), "no_movement_evidence").otherwise("movement_window_from_speed_threshold").alias("reason"),
        "start_t",
        "end_t",
        (F.col("end_t") - F.col("start_t")).alias("duration"),
        (F.col("start_t") - F.col("t0")).alias("head_idle"),
        (F.col("t1") - F.col("end_t")).alias("tail_idle"),
        "frames",
    )


def lap_time_semantics(laps: DataFrame, windows: DataFrame, keys: Sequence[str], least_share: float = 0.25) -> DataFrame:
    """Laps (``start_t, end_t``) with the part of their span inside the movement window.

    The estimate is usable only where something of the lap lies inside, and the window covers at
    least ``least_share`` of the recording.
    """
    w = windows.select(*keys, F.col("available").alias("_ok"), F.col("start_t").alias("_s"), F.col("end_t").alias("_e"), F.col("duration").alias("_d"),
                       (F.col("head_idle") + F.col("duration") + F.col("tail_idle")).alias("_all"))
    j = laps.join(w, list(keys), "left")
    lo, hi = F.greatest("start_t", "_s"), F.least("end_t", "_e")
    reason = (
        F.when(~F.coalesce("_ok", F.lit(False)), "movement_window_unavailable")
        .when(hi < lo, "lap_outside_movement_window")
        .when(hi == lo, "no_movement_inside_lap")
        .when((F.col("_all") > 0) & (F.col("_d") / F.col("_all") < least_share), "movement_window_implausibly_short")
        .otherwise("")
    )
    j = j.withColumn("reason", reason)
    estimate = F.when(F.col("reason").isin("", "no_movement_inside_lap", "movement_window_implausibly_short"), hi - lo)
    usable = F.col("reason") == ""
    return j.withColumns(
        {
            "span": F.col("end_t") - F.col("start_t"),
            "race_time_estimate": estimate,
            "race_time_estimated": usable,
            "status": F.when(usable, "estimated_from_movement").otherwise("unavailable"),
        }
    ).drop("_ok", "_s", "_e", "_d", "_all")


def state_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, time: str, refuse_null: bool = False) -> DataFrame:
    """Runs of equal ``state``: gaps and islands, one row a run with its span and number of rows.

    ``next_t`` is the time of the first row after the run. With ``refuse_null`` a stream with any
    unknown state has no runs.
    """
    w = _over(keys, order)
    changed = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    rows = df.withColumns({"_new": F.when(first, 1).otherwise(changed), "_next": F.lead(time).over(w)})
    rows = rows.withColumn("run", F.sum("_new").over(w))
    if refuse_null:
        rows = rows.withColumn("_bad", F.max(F.col(state).isNull()).over(Window.partitionBy(*keys))).where("not _bad")
    return rows.groupBy(*keys, "run").agg(
        F.first(state).alias(state), F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count("*").alias("n_rows"), F.max_by("_next", time).alias("next_t")
    )


def rising_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Rows at which ``flag`` turns true."""
    w = _over(keys, order)
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("_was", F.lag("_flag", 1, False).over(w))
    return rows.where("_flag and not _was").drop("_flag", "_was")


def state_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, value, time: str, least: float) -> DataFrame:
    """Intervals in which ``state`` is ``value``, up to the first row after; an open end stays open.

    ``validated`` tells whether the interval lasts at least ``least``.
    """
    runs = state_runs(df, keys, order, state, time).where(F.col(state) == F.lit(value))
    end = F.coalesce("next_t", "end_t")
    return runs.select(
        *keys, "start_t", end.alias("end_t"), (end - F.col("start_t")).alias("duration"), "n_rows", F.col("next_t").isNull().alias("open_end"),
        (end - F.col("start_t") >= least).alias("validated"),
    )


def edge_averages(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = 8) -> DataFrame:
    """Mean of the first and of the last ``rows`` values of each group."""
    up, down = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    numbered = df.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)})
    return numbered.groupBy(*keys).agg(
        F.avg(F.when(F.col("_a") <= rows, F.col(value))).alias("entry"), F.avg(F.when(F.col("_z") <= rows, F.col(value))).alias("exit"), F.count("*").alias("n_rows")
    )


def boundary_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Median of a row and its two neighbours within the group."""
    return df.withColumn(out, _median_over(value, _over(keys, order).rowsBetween(-1, 1)))


def alternating_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str) -> DataFrame:
    """Rows 2k and 2k+1 of a toggle table as an interval; a last odd row makes none."""
    w = _over(keys, order)
    numbered = df.withColumn("pair", F.floor((F.row_number().over(w) - 1) / F.lit(2)))
    pairs = numbered.groupBy(*keys, "pair").agg(F.min(time).alias("start_t"), F.max(time).alias("end_t"), F.count("*").alias("n"))
    return pairs.where("n = 2").select(*keys, "pair", "start_t", "end_t", (F.col("end_t") - F.col("start_t")).alias("duration"))


def fifo_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, opens: Column, closes: Column) -> DataFrame:
    """The n-th open with the n-th close of its group, first in, first out.

    ``valid`` is false where the close comes before the open; opens without a close stay open.
    """
    side = F.when(opens, 1).when(closes, 0)
    rows = df.withColumn("_side", side).where("_side is not null")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "_side").orderBy(*order)))
    pairs = rows.groupBy(*keys, "n").agg(F.max(F.when(F.col("_side") == 1, F.col(time))).alias("start_t"), F.max(F.when(F.col("_side") == 0, F.col(time))).alias("end_t"))
    pairs = pairs.where("start_t is not null")
    return pairs.withColumns({"duration": F.col("end_t") - F.col("start_t"), "valid": F.coalesce(F.col("end_t") >= F.col("start_t"), F.lit(False))})


def logical_groups(intervals: DataFrame, keys: Sequence[str], start: str = "start_t", end: str = "end_t", longest: float = 500, gap: tuple[float, float] = (-60000, 100)) -> DataFrame:
    """Short neighbouring intervals as one: a new group unless both are short and the gap fits."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    short = F.col(end) - F.col(start) <= longest
    joins = short & F.lag(short).over(w) & (F.col(start) - F.lag(end).over(w)).between(*gap)
    rows = intervals.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("group", F.sum("_new").over(w))
    out = rows.groupBy(*keys, "group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))
    return out.withColumn("duration", F.col(end) - F.col(start))


def merge_segments(intervals: DataFrame, keys: Sequence[str], gap: float, start: str = "start_t", end: str = "end_t", tie: Sequence[str] = ()) -> DataFrame:
    """Intervals whose start is less than ``gap`` after the latest end so far, merged."""
    w = Window.partitionBy(*keys).orderBy(start, end, *tie)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("_new", F.when(F.col(start) - latest < gap - 1e-9, 0).otherwise(1)).withColumn("segment", F.sum("_new").over(w))
    out = rows.groupBy(*keys, "segment").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))
    return out.withColumn("duration", F.col(end) - F.col(start))


def resample(df: DataFrame, keys: Sequence[str], order: Sequence[str], axis: str, values: Sequence[str], step: float, valid: Column | None = None) -> DataFrame:
    """Rows at every ``step`` of a non-decreasing ``axis``, values by linear interpolation.

    Each bracket of two rows makes its own targets, counted from the stream's first axis value, so
    there is no join. ``ok`` holds where both ends of the bracket are valid.
    """
    w = _over(keys, order)
    flag = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    base = df.withColumns({"_d0": F.min(axis).over(Window.partitionBy(*keys)), "_d1": F.lead(axis).over(w), "_ok": flag})
    base = base.withColumns({f"_{v}": F.lead(v).over(w) for v in values} | {"_ok1": F.lead("_ok").over(w)})
    first = F.ceil((F.col(axis) - F.col("_d0")) / step).cast("long")
    last = F.ceil((F.col("_d1") - F.col("_d0")) / step).cast("long") - 1
    is_end = F.lead("_d1").over(w).isNull()
    last = F.when(is_end, F.floor((F.col("_d1") - F.col("_d0")) / step).cast("long")).otherwise(last)
    rows = base.withColumns({"_a": first, "_b": last}).where(f"_d1 > `{axis}` and _b >= _a").withColumn("k", F.explode(F.sequence("_a", "_b")))
    at = F.col("_d0") + F.col("k") * step
    share = (at - F.col(axis)) / (F.col("_d1") - F.col(axis))
    return rows.select(*keys, "k", at.alias("at"), *[(F.col(v) + (F.col(f"_{v}") - F.col(v)) * share).alias(v) for v in values], (F.col("_ok") & F.col("_ok1")).alias("ok"))


def turn_signal(samples: DataFrame, keys: Sequence[str], order: Sequence[str] = ("k",), x: str = "x", y: str = "y", valid: str = "ok") -> DataFrame:
    """Turn in degrees on samples at equal distances: two scales, then five-tap smoothing.

    The raw signal is 0.7 of the turn over 4 samples and 0.3 of half that over 8, whichever are
    valid; it is 0 within 8 samples of an end. Smoothing weighs 1, 2, 3, 2, 1.
    """
    w = _over(keys, order)

    def turn(n: int) -> Column:
        ok = F.col(valid) & F.lag(valid, n).over(w) & F.lead(valid, n).over(w)
        bend = angle_delta_deg(F.col(x) - F.lag(x, n).over(w), F.col(y) - F.lag(y, n).over(w), F.lead(x, n).over(w) - F.col(x), F.lead(y, n).over(w) - F.col(y))
        return F.when(ok, bend)

    at = F.row_number().over(w)
    rows = samples.withColumns({"_s4": turn(4), "_s8": turn(8) / 2, "_i": at, "_n": F.count("*").over(Window.partitionBy(*keys))})
    mixed = F.coalesce(0.7 * F.col("_s4") + 0.3 * F.col("_s8"), "_s4", "_s8", F.lit(0.0))
    rows = rows.withColumn("raw_signal", F.when((F.col("_i") > 8) & (F.col("_i") <= F.col("_n") - 8), mixed).otherwise(0.0))
    parts = [F.lag("raw_signal", 2).over(w), 2 * F.lag("raw_signal").over(w), 3 * F.col("raw_signal"), 2 * F.lead("raw_signal").over(w), F.lead("raw_signal", 2).over(w)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return rows.withColumn("signal", F.coalesce(total / 9, F.lit(0.0))).drop("_s4", "_s8", "_i", "_n")


def _first_cut(seg: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``seg`` with ``cut_t``: where the first interval of ``cuts`` that reaches beyond ``end_t`` begins, ``end_t`` at the earliest.

    Ends and cuts in one order: the latest end of the cuts begun so far tells whether one holds the
    segment's end, and the look-ahead gives the next one's start.
    """
    kind = dict(seg.dtypes)["end_t"]
    a = seg.select(*keys, F.col("end_t").alias("_t"), F.lit(1).alias("_side"), F.struct(*seg.columns).alias("_row"), F.lit(None).cast(kind).alias("_ce"))
    b = cuts.where("end_t >= start_t").select(*keys, F.col("start_t").cast(kind).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col("end_t").cast(kind).alias("_ce"))
    so_far = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = a.unionByName(b).withColumns({"_until": F.max("_ce").over(so_far), "_next": F.last(F.when(F.col("_side") == 0, F.col("_t")), ignorenulls=True).over(ahead)})
    return rows.where("_side = 1").select(*[F.col(f"_row.{c}").alias(c) for c in seg.columns], F.when(F.col("_until") > F.col("_t"), F.col("_t")).otherwise(F.col("_next")).alias("cut_t"))


def recovery_end(segments: DataFrame, effects: DataFrame, keys: Sequence[str], cuts: DataFrame | None = None, window: float = 2.0, family: Sequence[str] = ("drift_small_boost", "air_boost", "landing_boost", "other_small_boost")) -> DataFrame:
    """Segments (``segment, start_t, end_t``) with where their recovery ends and why.

    An effect of the family owns the recovery if it starts between the segment's end and the
    first of: ``window`` later, the next segment's start, the first cut interval (``start_t, end_t``)
    that reaches beyond the end. The latest end wins, then the latest start; it is cut by the next
    segment, then by the cut interval.
    """
    w = Window.partitionBy(*keys).orderBy("start_t", "segment")
    seg = segments.withColumn("next_start", F.lead("start_t").over(w))
    seg = seg.withColumn("next_start", F.when(F.col("next_start") > F.col("end_t"), F.col("next_start")))
    if cuts is None:
        seg = seg.withColumn("cut_t", F.lit(None).cast(dict(seg.dtypes)["end_t"]))
    else:
        seg = _first_cut(seg, cuts, keys)
    limit = F.least(F.col("end_t") + window, "next_start", "cut_t")
    e = effects.where(F.col("semantic").isin(*family) & (F.col("end_t") > F.col("start_t")))
    e = e.select(*keys, F.col("start_t").alias("_es"), F.col("end_t").alias("_ee"))
    # effects meet only segments whose window shares a time bucket with them
    owned = range_join(e, seg.withColumn("_limit", limit), keys, "_es", "end_t", "_limit", width=window)
    best = owned.groupBy(*keys, "segment").agg(F.max(F.struct("_ee", "_es")).alias("_best"), F.count("*").alias("candidates"))
    j = seg.join(best, [*keys, "segment"], "left")
    end = F.least("_best._ee", "next_start", "cut_t")
    reason = (
        F.when(F.col("_best").isNull(), "no_native_recovery_effect")
        .when(F.col("cut_t") < F.least("_best._ee", F.coalesce("next_start", "_best._ee")), "airborne_hard_cut")
        .when(F.col("next_start") < F.col("_best._ee"), "next_drift_hard_cut")
        .otherwise("native_small_boost_end")
    )
    return j.select(
        *segments.columns, F.col("_best").isNotNull().alias("recovery_available"), F.coalesce(F.when(F.col("_best").isNotNull(), end), "end_t").alias("recovery_end"),
        reason.alias("end_reason"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def preview(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 1400, broken: str | None = None) -> DataFrame:
    """Every n-th row and the last, n the smallest that leaves about ``most`` rows.

    A kept row's break flag covers the rows left out before it.
    """
    w = _over(keys, order)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    rows = rows.withColumn("_step", F.greatest(F.lit(1), F.ceil(F.col("_n") / most)))
    keep = (F.col("_i") % F.col("_step") == 0) | (F.col("_i") == F.col("_n") - 1)
    rows = rows.withColumn("_keep", keep)
    if broken:
        block = F.coalesce(F.sum(F.col("_keep").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("_block", block)
        rows = rows.withColumn(broken, F.max(broken).over(Window.partitionBy(*keys, "_block")))
        rows = rows.drop("_block")
    return rows.where("_keep").drop("_i", "_n", "_step", "_keep")


def run_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], broken: str) -> DataFrame:
    """Adds ``run_id``: the number of breaks up to and with the row."""
    return df.withColumn("run_id", F.sum(F.coalesce(F.col(broken).cast("int"), F.lit(0))).over(_over(keys, order)))


def control_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], valid: str = "pose_valid", broken: str = "break_before",
                   axis: str = "distance", values: Sequence[str] = ("time_s", "x", "y"), least: float = 4.0, points: int = 180) -> DataFrame:
    """Points at equal distances along each valid run, with the run's number and its exact last row.

    The distance between points is the larger of ``least`` and the stream's span over ``points``.
    """
    w = _over(keys, order)
    start = F.col(valid) & (F.coalesce(F.col(broken), F.lit(False)) | ~F.coalesce(F.lag(valid).over(w), F.lit(False)))
    rows = df.withColumn("block", F.sum(start.cast("int")).over(w)).where(F.col(valid))
    spans = rows.groupBy(*keys).agg((F.max(axis) - F.min(axis)).alias("_span"))
    rows = rows.join(spans, list(keys)).withColumn("_step", F.greatest(F.lit(least), F.col("_span") / points))
    inside = [*keys, "block"]
    b = Window.partitionBy(*inside).orderBy(*order)
    rows = rows.withColumns({"_d0": F.min(axis).over(Window.partitionBy(*inside)), "_d1": F.lead(axis).over(b)} | {f"_{v}": F.lead(v).over(b) for v in values})
    a, z = F.ceil((F.col(axis) - F.col("_d0")) / F.col("_step")).cast("long"), F.ceil((F.col("_d1") - F.col("_d0")) / F.col("_step")).cast("long") - 1
    made = rows.withColumns({"_a": a, "_z": z}).where(f"_d1 > `{axis}` and _z >= _a").withColumn("_k", F.explode(F.sequence("_a", "_z")))
    at = F.col("_d0") + F.col("_k") * F.col("_step")
    share = (at - F.col(axis)) / (F.col("_d1") - F.col(axis))
    made = made.select(*inside, at.alias("d"), *[(F.col(v) + (F.col(f"_{v}") - F.col(v)) * share).alias(v) for v in values])
    ends = rows.where("_d1 is null").select(*inside, F.col(axis).alias("d"), *values)
    return made.unionByName(ends)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: round_even(F.col(c), digits) for c in columns})
