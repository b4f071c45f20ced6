"""Comparison of laps: one route, a shared axis, windows, deltas that add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparison as cmp
from ..operators import matching, sets, temporal
from ..operators import sequences as seq


def lap_sides(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of one side of each comparison: ``pairs`` has ``pair`` and the side's stream and lap."""
    p = pairs.select("pair", F.col(f"{side}_sha").alias("replay_sha"), F.col(f"{side}_stream").alias("stream"), F.col(f"{side}_lap").alias("lap_index"))
    return rows.join(p, ["replay_sha", "stream", "lap_index"])


def fastest_pairs(rows: DataFrame, laps: DataFrame) -> DataFrame:
    """Every lap against the fastest of its stream."""
    best = laps.withColumn("t", F.coalesce("race_time_estimate", "span")).groupBy("replay_sha", "stream").agg(F.min(F.struct("t", "lap_index")).alias("m"))
    j = laps.join(best, ["replay_sha", "stream"]).where(F.col("lap_index") != F.col("m.lap_index"))
    return j.select(
        F.concat_ws("/", "replay_sha", "stream", "lap_index").alias("pair"), F.col("replay_sha").alias("a_sha"), F.col("stream").alias("a_stream"), F.col("lap_index").alias("a_lap"),
        F.col("replay_sha").alias("b_sha"), F.col("stream").alias("b_stream"), F.col("m.lap_index").alias("b_lap"),
    )


def compare(rows: DataFrame, pairs: DataFrame, marks: DataFrame | None = None, custom: tuple[float, float] | None = None, least_m: float = 8.0, top: int = 5) -> dict[str, DataFrame]:
    """Comparison tables of each pair: correspondence, windows with deltas, top changes, coverage, totals.

    ``marks`` (``pair, shared``) add boundaries; ``custom`` is one interval of the shared axis instead,
    which is refused (no window) where it leaves the shared route. Deltas are subject minus baseline.
    """
    k = ["pair"]
    order = ["i"]
    a, b = (lap_sides(rows, pairs, s) for s in ("a", "b"))
    pa, pb = (seq.control_points(x, k, order) for x in (a, b))
    found = matching.align_trajectories(pa, pb, k)
    ends = found.groupBy("pair", "component_no").agg(F.min("shared").alias("lo"), F.max("shared").alias("hi"), (F.max("a_d") - F.min("a_d")).alias("length"))
    if custom is None:
        points = ends.select("pair", "component_no", F.explode(F.array("lo", "hi")).alias("m"))
        if marks is not None:
            inside = marks.join(ends, k).where((F.col("shared") > F.col("lo") + 1e-9) & (F.col("shared") < F.col("hi") - 1e-9))
            points = points.unionByName(inside.select("pair", "component_no", F.col("shared").alias("m")))
        spans = found.groupBy("pair").agg((F.max("a_d") - F.min("a_d")).alias("lap_m"))
        points = points.join(spans, k)
        bounds = cmp.boundaries(points, k, "component_no", "m", F.lit(least_m) / F.greatest(F.col("lap_m"), F.lit(1e-9)))
        windows = cmp.windows_between(bounds, k, "component_no")
    else:
        lo, hi = custom
        windows = ends.where((F.col("lo") <= lo) & (F.col("hi") >= hi)).select("pair", "component_no", F.lit(1).alias("window_no"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(hi - lo).alias("span"))
    axis = found.select(F.concat_ws("#", "pair", "component_no").alias("c"), "shared", "a_t", "b_t")
    at = windows.withColumn("c", F.concat_ws("#", "pair", "component_no"))
    for side in ("a", "b"):
        for end in ("lo", "hi"):
            at = temporal.value_at(at, axis, ["c"], end, "shared", f"{side}_t", f"_{side}_{end}")
    at = at.withColumns({"subject_time": F.col("_a_hi") - F.col("_a_lo"), "baseline_time": F.col("_b_hi") - F.col("_b_lo"), "matched": F.lit(True)})
    measured = cmp.window_deltas(at.drop("c", "_a_lo", "_a_hi", "_b_lo", "_b_hi"))
    changes = sets.top_changes(measured, k, "delta", "window_no", top)
    points_n = pa.groupBy("pair").agg(F.count("*").alias("subject_points")).join(pb.groupBy("pair").agg(F.count("*").alias("baseline_points")), k)
    coverage = cmp.comparison_coverage(found, points_n, k)
    span = lambda x, n: x.groupBy("pair").agg((F.max("time_s") - F.min("time_s")).alias(n), ((F.max("time_s") - F.min("time_s")) / F.count("*")).alias(f"{n}_step"))
    totals = span(a, "_a").join(span(b, "_b"), k).join(coverage.select("pair", "subject_coverage", "baseline_coverage"), k, "left")
    totals = totals.join(windows.groupBy("pair").agg(F.count("*").alias("spans")), k, "left")
    totals = totals.select("pair", (F.col("_a") - F.col("_b")).alias("total_delta"), F.coalesce("spans", F.lit(0)).alias("spans"), F.greatest("_a_step", "_b_step").alias("sample_interval"), "subject_coverage", "baseline_coverage")
    return {"pairs": found, "windows": measured, "top_changes": changes, "observations": sets.observation_budget(changes, k), "coverage": coverage, "totals": cmp.reconcile(measured, totals, k)}


def gate(sides: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """Comparisons whose sides ``a`` and ``b`` (structs of map identities) are on one map."""
    return sides.withColumn("same_by", cmp.same_map()).where(F.col("same_by").isin("resource_id", "game_id", "name_key"))
