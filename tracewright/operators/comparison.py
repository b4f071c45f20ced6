"""Comparison of two laps on a shared axis: boundaries, windows, deltas and their reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import delta_direction, round_even
from . import temporal
from .sequences import _median_over
from .temporal import range_join


def to_shared(points: DataFrame, pairs: DataFrame, keys: Sequence[str], at: str, side: str = "a_progress", width: float = 0.03) -> DataFrame:
    """``points`` with ``component_no`` and ``shared``: a side's progress on the shared axis.

    Linear between the pairs of one component; NULL elsewhere, so breaks are never bridged. Points meet
    only the stretches in their bucket of ``width``, the largest gap within a component.
    """
    w = Window.partitionBy(*keys, "component_no").orderBy("pair_no")
    p = pairs.select(*keys, "component_no", F.col(side).alias("_u0"), F.lead(side).over(w).alias("_u1"), F.col("shared").alias("_s0"), F.lead("shared").over(w).alias("_s1"))
    j = range_join(points.withColumn("_id", F.monotonically_increasing_id()), p.where("_u1 >= _u0"), keys, at, "_u0", "_u1", width=width, how="left")
    share = (F.col(at) - F.col("_u0")) / F.when(F.col("_u1") > F.col("_u0"), F.col("_u1") - F.col("_u0"))
    s = F.col("_s0") + (F.col("_s1") - F.col("_s0")) * F.coalesce(share, F.lit(0.0))
    first = F.min(F.when(F.col("_u0").isNotNull(), F.struct(F.col("component_no").alias("c"), s.alias("s"))))
    return j.groupBy("_id", *points.columns).agg(first.alias("_m")).select(*points.columns, F.col("_m.c").alias("component_no"), F.col("_m.s").alias("shared"))


def thin(sorted_points: Column, least: Column) -> Column:
    """A sorted array without points nearer than ``least`` to the one kept before; both ends stay."""
    step = F.aggregate(
        sorted_points,
        F.array().cast("array<double>"),
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= least), F.concat(kept, F.array(x))).otherwise(kept),
    )
    last = F.element_at(sorted_points, -1)
    ended = F.when(F.element_at(step, -1) == last, step).otherwise(
        F.concat(F.when((F.size(step) > 1) & (last - F.element_at(step, -1) < least), F.slice(step, F.lit(1), F.size(step) - 1)).otherwise(step), F.array(last))
    )
    return F.when(F.size(sorted_points) > 0, ended).otherwise(sorted_points)


def boundaries(marks: DataFrame, keys: Sequence[str], component: str, at: str, least: Column) -> DataFrame:
    """Boundaries of each component: its marks in order, thinned to a least distance, ends kept."""
    points = F.array_sort(F.collect_set(F.col(at).cast("double")))
    out = marks.groupBy(*keys, component).agg(points.alias("_p"), F.max(least).alias("_l"))
    return out.select(*keys, component, thin(F.col("_p"), F.col("_l")).alias("boundaries"))


def windows_between(bounds: DataFrame, keys: Sequence[str], component: str) -> DataFrame:
    """Windows between consecutive boundaries, numbered over the components of a comparison."""
    b = bounds.select(*keys, component, F.posexplode("boundaries").alias("_i", "lo"))
    w = Window.partitionBy(*keys, component).orderBy("_i")
    rows = b.withColumn("hi", F.lead("lo").over(w)).where("hi > lo")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(component, "lo"))
    return rows.select(*keys, component, number.alias("window_no"), "lo", "hi", (F.col("hi") - F.col("lo")).alias("span"))


def window_deltas(measured: DataFrame) -> DataFrame:
    """Adds ``delta`` (subject minus baseline) and its ``direction`` to ``subject_time, baseline_time``."""
    d = F.col("subject_time") - F.col("baseline_time")
    return measured.withColumn("delta", d).withColumn("direction", delta_direction(d))


def swap(windows: DataFrame) -> DataFrame:
    """The same windows with the sides changed: every delta changes its sign."""
    return window_deltas(windows.withColumns({"subject_time": F.col("baseline_time"), "baseline_time": F.col("subject_time")}).drop("delta", "direction"))


def reconcile(windows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the windows' deltas explain the total difference.

    ``windows``: ``delta, matched``; ``totals``: ``total_delta, spans, sample_interval, subject_coverage,
    baseline_coverage``. The tolerance is derived: (2 spans + 2) sample intervals. What no window
    covers is ``unmatched``; the residual is what remains.
    """
    sums = windows.groupBy(*keys).agg(F.sum(F.when(F.col("matched"), F.col("delta"))).alias("matched_delta"), F.sum(F.when(~F.col("matched"), F.col("delta"))).alias("unmatched_delta"), F.count("*").alias("n_windows"))
    j = totals.join(sums, list(keys), "left")
    j = j.withColumns(
        {
            "residual": F.col("total_delta") - F.coalesce("matched_delta", F.lit(0)) - F.coalesce("unmatched_delta", F.lit(0)),
            "tolerance": (2 * F.col("spans") + 2) * F.col("sample_interval"),
            "coverage": F.least("subject_coverage", "baseline_coverage"),
        }
    )
    status = F.when(F.col("total_delta").isNull() | F.col("matched_delta").isNull(), "unavailable").when(F.abs("residual") <= F.col("tolerance"), "reconciled").otherwise("residual_exceeds_tolerance")
    return j.withColumn("status", status)


def comparison_coverage(pairs: DataFrame, points: DataFrame, keys: Sequence[str], degraded: float = 0.2) -> DataFrame:
    """Pairs over control points on each side; ``degraded`` where the smaller share is low."""
    n = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"))
    j = points.join(n, list(keys), "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    j = j.withColumns({"subject_coverage": F.try_divide("pairs", "subject_points"), "baseline_coverage": F.try_divide("pairs", "baseline_points")})
    j = j.withColumn("coverage", F.least("subject_coverage", "baseline_coverage"))
    return j.withColumn("degraded", F.col("coverage") < degraded)


def corner_windows(corners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows from paired and single corners (``s_lo, s_hi, final_hi, next_start, source``).

    Core and final end are cut at the next drift's start; a window begins no earlier than the one
    before ends, and is dropped if nothing is left. The clipping runs in order within a comparison.
    """
    kinds = dict(corners.dtypes)

    def clip(pdf: pd.DataFrame) -> pd.DataFrame:
        out, before = [], -np.inf
        for r in pdf.sort_values(["s_lo", "s_hi"], kind="stable").itertuples():
            cut = r.next_start if pd.notna(r.next_start) and r.next_start > r.s_lo + 1e-9 else np.inf
            final = r.s_hi if pd.isna(r.final_hi) else r.final_hi
            lo, hi = max(r.s_lo, before), min(r.s_hi, cut)
            if hi <= lo + 1e-9:
                continue
            out.append((len(out) + 1, r.source, lo, hi, max(min(final, cut), hi), r.s_hi > cut + 1e-9, final > cut + 1e-9))
            before = hi
        got = pd.DataFrame(out, columns=["window_no", "source", "s_start", "s_end", "final_end", "cut_applied", "final_cut_applied"])
        for c in reversed(list(keys)):
            got.insert(0, c, pdf[c].iloc[0])
        return got

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", window_no long, source string, s_start double, s_end double, final_end double, cut_applied boolean, final_cut_applied boolean"
    return corners.groupBy(*keys).applyInPandas(clip, schema)


def corner_bounds(pairs: DataFrame) -> DataFrame:
    """Bounds of paired corners: earlier start to earlier recovery end; the later end is the final one."""
    return pairs.withColumns(
        {
            "s_lo": F.least("a_start", "b_start"), "s_hi": F.least("a_end", "b_end"), "final_hi": F.greatest("a_end", "b_end"),
            "next_start": F.least("a_next", "b_next"), "source": F.lit("paired_corner"),
        }
    )


def same_map(a: str = "a", b: str = "b") -> Column:
    """Whether two sides are on one map: by resource id, else game id, else exact name.

    The first identity that both sides have decides; a conflict there refuses.
    """
    parts = []
    for f in ("resource_id", "game_id", "name_key"):
        x, y = F.col(f"{a}.{f}"), F.col(f"{b}.{f}")
        parts.append(F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, F.lit(f)).otherwise(F.concat(F.lit("conflict_"), F.lit(f)))))
    return F.coalesce(*parts, F.lit("unknown"))


def max_in_window(points: DataFrame, windows: DataFrame, keys: Sequence[str], window: str, time: str, value: str, width: float | None = None) -> DataFrame:
    """The largest value of each window, ends included; NULL for an empty one. ``width`` as in ``range_join``."""
    p = points.select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"))
    inside = range_join(p, windows.select(*keys, window, "lo", "hi"), keys, "_t", "lo", "hi", width)
    j = inside.groupBy(*keys, window).agg(F.max("_v").alias(f"max_{value}"))
    return windows.join(j, [*keys, window], "left")


def corner_measures(windows: DataFrame, rows: DataFrame, keys: Sequence[str], window: str, width: float | None = None) -> DataFrame:
    """Per side of a corner: entry speed (median of 3 rows), lowest in the drift, peak to recovery end.

    ``windows``: ``drift_start, drift_end, recovery_end`` in time; ``rows``: ``t, speed, distance``. A recovery
    without native evidence is NULL, never 0. ``width`` as in ``range_join``.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    r = rows.select(*keys, "t", "speed", "distance", _median_over("speed", w.rowsBetween(-1, 1)).alias("_m"))
    spans = windows.select(*keys, window, "drift_start", "drift_end", "recovery_end", F.coalesce("recovery_end", "drift_end").alias("_until"))
    j = range_join(r, spans, keys, "t", "drift_start", "_until", width)
    in_drift, after = F.col("t") <= F.col("drift_end"), F.col("recovery_end").isNotNull() & (F.col("t") >= F.col("drift_end"))
    got = j.groupBy(*keys, window).agg(
        F.min_by("_m", "t").alias("entry_speed"), F.min(F.when(in_drift, F.col("speed"))).alias("min_speed"), F.max(F.when(after, F.col("speed"))).alias("exit_speed"),
        (F.max(F.when(in_drift, F.col("distance"))) - F.min(F.when(in_drift, F.col("distance")))).alias("drift_distance"),
        (F.max(F.when(after, F.col("distance"))) - F.min(F.when(after, F.col("distance")))).alias("recovery_distance"),
        (F.max("distance") - F.min("distance")).alias("total_distance"),
    )
    return windows.join(got, [*keys, window], "left")


#: Seconds that one small boost lasts, and where a recovery's end comes from.
BOOST_TAIL_S = 0.25
TAIL_NATIVE, TAIL_GAMEPLAY, TAIL_NONE = "native_small_boost_recovery_end", "gameplay_min_small_boost_tail_0p25s", "native_drift_end_no_tail"


def recovery_tail(windows: DataFrame, ends: DataFrame, keys: Sequence[str], tail: float = BOOST_TAIL_S, least: float = 1e-6) -> DataFrame:
    """``windows`` with ``metric_end``, up to which a corner's recovery is measured, and ``metric_source``.

    A native recovery end holds. Without one, the recovery is empty where the effects could be seen and
    showed none. Only where they can't be (``observable`` false), or on a ``low_frequency`` stream with
    neither ``boosts`` nor ``nitros``, it lasts as long as one small boost, but not beyond ``next_drift`` or
    the stream's end (``ends``: keys, ``last_t``). The corner itself and who owns it stay as they are.
    """
    unseen = ~F.coalesce(F.col("observable"), F.lit(False)) | (F.col("low_frequency") & (F.coalesce("boosts", F.lit(0)) == 0) & (F.coalesce("nitros", F.lit(0)) == 0))
    j = windows.join(ends.select(*keys, "last_t"), list(keys), "left")
    until = F.least(F.col("drift_end") + tail, F.col("next_drift"), F.col("last_t"))
    lasts = F.col("recovery_end").isNull() & unseen & (until > F.col("drift_end") + least)
    source = F.when(F.col("recovery_end").isNotNull(), TAIL_NATIVE).when(lasts, TAIL_GAMEPLAY).otherwise(TAIL_NONE)
    return j.withColumns({"metric_end": F.when(lasts, until).otherwise(F.coalesce("recovery_end", "drift_end")), "metric_source": source}).drop("last_t")


def corner_metrics(windows: DataFrame, drifts: DataFrame, rows: DataFrame, keys: Sequence[str], window: str, tail: float = BOOST_TAIL_S, width: int = 256) -> DataFrame:
    """Every figure of a corner on its own side, with its recovery measured up to ``recovery_tail``'s end.

    ``windows``: ``drift_start, drift_end, recovery_end`` and the columns of ``recovery_tail``; ``drifts``: the corner's own
    intervals ``start_t, end_t``; ``rows``: ``t, speed, distance, pose_valid``. Speeds are of rows, those nearest to a time;
    invalid and negative ones don't count. Distances are interpolated and end with the stream.

    ``entry_speed`` is the median of three rows at the drift's start, ``min_speed`` the least in the drift,
    ``exit_speed`` the largest from its end to the recovery's, or the median of three rows at the drift's
    end where there is no recovery; ``exit_source`` says which. ``drift_distance`` is what was driven
    within the intervals, ``gap_distance`` between them. ``width`` is the number of rows to a bucket of the row join.
    """
    keys, own = list(keys), [*keys, window]
    order = Window.partitionBy(*keys).orderBy("t")
    usable = F.col("pose_valid") & (F.col("speed") >= 0) & (F.abs("speed") < float("inf")) & ~F.isnan("speed")
    r = rows.withColumn("_v", F.when(usable, F.col("speed"))).withColumns({"_i": F.row_number().over(order), "_m": _median_over("_v", order.rowsBetween(-1, 1))})
    ends = rows.groupBy(*keys).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    w = recovery_tail(windows, ends, keys, tail)

    inside = lambda c: F.greatest(F.least(F.col(c), F.col("last_t")), F.col("first_t"))
    marks = F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).cast("double").alias("at")) for n, c in (("start", "drift_start"), ("end", "drift_end"), ("metric", "metric_end"))])
    times = w.select(*own, F.lit(None).cast("double").alias("sign"), F.explode(marks).alias("x")).select(*own, "sign", "x.what", "x.at")
    spans = drifts.select(*own, F.explode(F.array(*[F.struct(F.lit(s).alias("sign"), F.lit("drift").alias("what"), F.col(c).cast("double").alias("at")) for s, c in ((-1.0, "start_t"), (1.0, "end_t"))])).alias("x")).select(*own, "x.*")
    asked = times.unionByName(spans).join(ends, keys).withColumn("at", inside("at")).drop("first_t", "last_t")
    placed = temporal.value_at(asked, r, keys, "at", "t", "distance", "d")
    when = lambda n: F.max(F.when(F.col("what") == n, F.col("d")))
    of_drift = F.when(F.col("what") == "drift", F.col("d"))
    far = placed.groupBy(*own).agg(when("start").alias("_d0"), when("end").alias("_d1"), when("metric").alias("_d2"), F.sum(F.col("sign") * of_drift).alias("_active"), (F.max(of_drift) - F.min(of_drift)).alias("_span"))

    near = temporal.nearest(asked.where("sign is null"), r, keys, "at", "t", "_i").groupBy(*own).agg(*[F.max(F.when(F.col("what") == n, F.col("near"))).alias(f"_i_{n}") for n in ("start", "end", "metric")])
    reach = near.withColumn("_until", F.greatest("_i_end", "_i_metric"))
    p = r.select(*keys, F.col("_i").alias("_at"), "_v", "_m")
    held = temporal.range_join(p, reach, keys, "_at", "_i_start", "_until", width)
    fast = held.groupBy(*own).agg(
        F.max(F.when(F.col("_at") == F.col("_i_start"), F.col("_m"))).alias("_entry"), F.max(F.when(F.col("_at") == F.col("_i_end"), F.col("_m"))).alias("_at_end"),
        F.min(F.when(F.col("_at") <= F.col("_i_end"), F.col("_v"))).alias("_low"), F.max(F.when(F.col("_at") >= F.col("_i_end"), F.col("_v"))).alias("_peak"),
    )
    out = w.join(far, own, "left").join(fast, own, "left")
    lasts = F.col("metric_end") > F.col("drift_end") + 1e-6
    exit_source = F.when(lasts & F.col("_peak").isNotNull(), "own_recovery_window_peak").when(F.col("_at_end").isNotNull(), "native_drift_end_median_fallback")
    figures = {
        "entry_speed": F.col("_entry"), "min_speed": F.col("_low"), "exit_speed": F.when(lasts, F.coalesce("_peak", "_at_end")).otherwise(F.col("_at_end")), "drift_distance": F.col("_active"),
        "gap_distance": F.greatest(F.col("_span") - F.col("_active"), F.lit(0.0)), "recovery_distance": F.when(F.col("_d2") >= F.col("_d1"), F.col("_d2") - F.col("_d1")), "total_distance": F.when(F.col("_d2") >= F.col("_d0"), F.col("_d2") - F.col("_d0")),
    }
    out = out.withColumns({n: round_even(c, 3) for n, c in figures.items()} | {"exit_source": exit_source})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def strategy_deltas(windows: DataFrame, equal: float = 0.0005) -> DataFrame:
    """Core, final and recovery-strategy differences of windows (``subject_core, baseline_core, subject_final, baseline_final``).

    A difference is subject minus baseline; ``subject_gain`` is what the subject gains from the core's
    end to the final end. Each is NULL, its direction ``unavailable``, where a side is.
    """
    core, final = F.col("subject_core") - F.col("baseline_core"), round_even(F.col("subject_final") - F.col("baseline_final"), 4)

    def told(d: str, more: str, less: str) -> Column:
        return F.when(F.col(d).isNull(), "unavailable").when(F.abs(d) <= equal, "equal").when(F.col(d) > 0, more).otherwise(less)

    w = windows.withColumns({"core_delta": core, "final_delta": final, "subject_tail": round_even(F.col("subject_final") - F.col("subject_core"), 4), "baseline_tail": round_even(F.col("baseline_final") - F.col("baseline_core"), 4)})
    w = w.withColumn("subject_gain", round_even(F.col("core_delta") - F.col("final_delta"), 4))
    return w.withColumns({"core_direction": told("core_delta", "slower", "faster"), "final_direction": told("final_delta", "slower", "faster"), "gain_direction": told("subject_gain", "subject_gain", "subject_loss")})
