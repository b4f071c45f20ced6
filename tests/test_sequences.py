"""Sequence operators on small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalar
from tracewright.operators import aggregates, comparison, matching, sections, sets, temporal
from tracewright.operators import sequences as seq

K = ["s"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_logical_groups_of_short_neighbours(spark):
    iv = [(80667, 81084), (81084, 81101), (81101, 81118), (81118, 81134), (81134, 81151), (81218, 81234), (81234, 81284)]
    other = [(40304, 40920), (41137, 42237)]
    df = frame(spark, [(1, *x) for x in iv] + [(2, *x) for x in other], "s int, start_t long, end_t long")
    got = {(r.s, r.start_t, r.end_t) for r in seq.logical_groups(df, K).collect()}
    assert got == {(1, 80667, 81284), (2, 40304, 40920), (2, 41137, 42237)}


@pytest.mark.parametrize("gap, n", [(0.150, 2), (0.149, 1)])
def test_segments_merge_below_the_gap_only(spark, gap, n):
    df = frame(spark, [(1, 0.0, 1.0), (1, 1.0 + gap, 2.0)], "s int, start_t double, end_t double")
    assert seq.merge_segments(df, K, 0.15).count() == n


def recovery(spark, segments, effects, cuts=None):
    seg = frame(spark, [(1, k, a, b) for k, (a, b) in enumerate(segments)], "s int, segment int, start_t double, end_t double")
    eff = frame(spark, [(1, a, b, kind) for a, b, kind in effects], "s int, start_t double, end_t double, semantic string")
    cut = frame(spark, [(1, a, b) for a, b in cuts], "s int, start_t double, end_t double") if cuts else None
    return {r.segment: r for r in seq.recovery_end(seg, eff, K, cut).collect()}


def test_recovery_without_effect_ends_with_the_drift(spark):
    r = recovery(spark, [(10.0, 11.5)], [(11.6, 12.2, "nitro")])[0]
    assert (r.recovery_available, r.recovery_end, r.end_reason) == (False, 11.5, "no_native_recovery_effect")


def test_recovery_takes_the_last_boost_and_the_cuts(spark):
    boosts = [(11.55, 11.95, "drift_small_boost"), (12.10, 12.50, "air_boost")]
    assert recovery(spark, [(10.0, 11.5)], boosts)[0].recovery_end == 12.5
    r = recovery(spark, [(10.0, 11.0), (11.5, 12.5)], [(11.05, 13.0, "drift_small_boost")])[0]
    assert (r.recovery_end, r.end_reason) == (11.5, "next_drift_hard_cut")
    r = recovery(spark, [(10.0, 11.5)], [(11.55, 12.5, "drift_small_boost")], [(12.0, 12.4)])[0]
    assert (r.recovery_end, r.end_reason) == (12.0, "airborne_hard_cut")


def test_movement_window_of_a_parked_start_and_end(spark):
    speed = [0.0] * 500 + [12.0] * 1000 + [0.0] * 400
    df = frame(spark, [(1, i / 100, v) for i, v in enumerate(speed)] + [(2, i / 100, 0.0) for i in range(200)], "s int, t double, v double")
    got = {r.s: r for r in seq.movement_window(df, K, "t", "v").collect()}
    assert [round(x, 2) for x in (got[1].start_t, got[1].end_t, got[1].head_idle, got[1].tail_idle)] == [5.0, 14.99, 5.0, 4.0]
    assert got[2].reason == "no_movement_evidence" and got[2].duration is None
    laps = frame(spark, [(1, 0.0, 12.0)], "s int, start_t double, end_t double")
    lap = seq.lap_time_semantics(laps, seq.movement_window(df, K, "t", "v"), K).first()
    assert (round(lap.race_time_estimate, 4), lap.span, lap.status) == (7.0, 12.0, "estimated_from_movement")


def test_runs_refuse_unknown_states(spark):
    df = frame(spark, [(1, 0, 1), (1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 1, None)], "s int, t int, lap int")
    assert [(r.s, r.n_rows) for r in seq.state_runs(df, K, ["t"], "lap", "t", refuse_null=True).orderBy("s", "run").collect()] == [(1, 2), (1, 1)]


def test_fifo_pairs_mark_closes_before_opens(spark):
    rows = [(1, 1000, 1), (1, 1650, 0), (1, 2000, 1), (2, 500, 0), (2, 700, 1)]
    got = seq.fifo_pairs(frame(spark, rows, "s int, t int, o int"), K, ["t"], "t", F.col("o") == 1, F.col("o") == 0).orderBy("s", "n").collect()
    assert [(r.s, r.start_t, r.end_t, r.valid) for r in got] == [(1, 1000, 1650, True), (1, 2000, None, False), (2, 700, 500, False)]


def test_pose_break_and_repair(spark):
    rows = [(1, i, i / 10, 0.5 * i + (40 if i >= 20 else 0), 0.0, 0.0, 0.0, 5.0 if i not in (19, 20) else 400.0, "position_derived") for i in range(40)]
    df = frame(spark, rows, "s int, i int, time_s double, x double, y double, z double, yaw double, speed double, speed_source string")
    df = seq.pose_breaks(seq.steps(df, K, ["i"]), K, ["i"])
    assert [r.i for r in df.where("break_before").collect()] == [20]
    fixed = {r.i: r for r in seq.repair_breaks(df, K, ["i"]).collect()}
    assert not fixed[19].pose_valid and not fixed[20].pose_valid and fixed[18].pose_valid
    assert fixed[19].speed_fixed == 5.0 and fixed[20].speed_fixed == 5.0


def test_resampling_has_equal_steps_and_exact_ends(spark):
    df = frame(spark, [(1, i, 3.0 * i, 6.0 * i) for i in range(5)], "s int, i int, d double, v double")
    got = seq.resample(df, K, ["i"], "d", ["v"], 2.0).orderBy("k").collect()
    assert [r["at"] for r in got] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    assert all(math.isclose(r.v, 2 * r["at"]) for r in got)


def test_preview_keeps_first_last_and_breaks(spark):
    df = frame(spark, [(1, i, i == 5) for i in range(10)], "s int, i int, b boolean")
    got = [(r.i, r.b) for r in seq.preview(df, K, ["i"], most=3, broken="b").orderBy("i").collect()]
    assert got == [(0, False), (4, False), (8, True), (9, False)]


def test_one_sample_streams_and_empty_tables(spark):
    one = frame(spark, [(1, 0, 1.0, 2.0)], "s int, i int, t double, v double")
    assert seq.derivative(one, K, ["i"], "v", "t", "d").first().d == 0.0
    assert seq.resample(one, K, ["i"], "t", ["v"], 1.0).count() == 0
    none = one.where("false")
    assert seq.state_runs(none, K, ["i"], "v", "t").count() == 0
    assert temporal.nearest(none, one, K, "t", "t", "v").count() == 0


def test_nearest_prefers_the_earlier_on_a_tie(spark):
    left = frame(spark, [(1, 5.0)], "s int, t double")
    right = frame(spark, [(1, 4.0, "a"), (1, 6.0, "b")], "s int, rt double, v string")
    assert temporal.nearest(left, right, K, "t", "rt", "v").first().near == "a"
    assert temporal.nearest(left, right, K, "t", "rt", "v", later_on_tie=True).first().near == "b"
    assert temporal.nearest(left, right, K, "t", "rt", "v", tolerance=0.5).first().near is None


def test_range_join_buckets_change_nothing(spark):
    points = frame(spark, [(1, float(i)) for i in range(50)], "s int, t double")
    iv = frame(spark, [(1, 3.5, 20.0, "a"), (1, 20.0, 21.0, "b")], "s int, start_t double, end_t double, name string")
    plain = temporal.range_join(points, iv, K, "t").collect()
    assert sorted(temporal.range_join(points, iv, K, "t", width=4.0).collect()) == sorted(plain) and len(plain) == 19


def test_greedy_pairs_and_their_blockers(spark):
    def run(times, codes):
        df = frame(spark, [(1, i, t, c) for i, (t, c) in enumerate(zip(times, codes))], "s int, i int, t int, c int")
        c = F.col("c")
        return matching.greedy_pairs(df, K, "i", "t", c == 25, c == 24, c.isin(24, 19), 500).collect()

    assert run([1000, 1850], [24, 25])[0].right_index is None
    assert run([1000, 1283], [24, 25])[0].distance == 283
    assert run([1000, 1100, 1283], [24, 19, 25])[0].right_index is None


def test_combo_labels(spark):
    nitro = frame(spark, [(1, 10000)], "s int, t int")
    small = lambda *t: frame(spark, [(1, x, 7) for x in t], "s int, t int, drift_id int")
    label = lambda *t: [r.label for r in matching.combo_sequences(nitro, small(*t), K).collect()]
    assert label(9217, 10067) == ["WCW"] and label(10684, 11242) == ["CWW"] and label(10067) == ["CW"] and label(10500) == []


def control(spark, y, reverse=False):
    pts = [(1, 0, 10.0 * i, float(i), 10.0 * (60 - i if reverse else i), float(y)) for i in range(61)]
    return frame(spark, pts, "s int, block int, d double, time_s double, x double, y double")


def test_alignment_of_twin_reversed_and_distant_routes(spark):
    a = control(spark, 0)
    twin = matching.align_trajectories(a, control(spark, 2), K).collect()
    assert len(twin) == 61 and {r.component_no for r in twin} == {1} and {r.separation for r in twin} == {2.0}
    assert matching.align_trajectories(a, control(spark, 0, True), K).count() == 0
    assert matching.align_trajectories(a, control(spark, 200), K).count() == 0


def test_monotone_pairs_against_brute_force():
    import itertools
    import random

    import numpy as np

    random.seed(3)
    for _ in range(60):
        n, m = random.randint(1, 5), random.randint(1, 5)
        cost = np.array([[random.randint(0, 9) for _ in range(m)] for _ in range(n)], float)
        ok = np.array([[random.random() < 0.6 for _ in range(m)] for _ in range(n)])
        best = (0, 0.0)
        for size in range(1, min(n, m) + 1):
            for i in itertools.combinations(range(n), size):
                for j in itertools.combinations(range(m), size):
                    if all(ok[a, b] for a, b in zip(i, j)):
                        best = min(best, (-size, sum(cost[a, b] for a, b in zip(i, j))))
        got = matching.monotone_pairs(cost, ok, np.ones((n + 1, m + 1), bool))
        assert (-len(got), sum(cost[a, b] for a, b in got)) == best


def test_stitching_continues_the_best_open_vehicle(spark):
    parts = [(1, 1, 0.0, 10.0, 60.0, 0, 0, 0, 100, 0, 0), (1, 2, 10.1, 20.0, 60.2, 101, 0, 0, 200, 0, 0), (1, 3, 10.1, 20.0, 20.0, 101, 0, 0, 9, 0, 0)]
    df = frame(spark, [tuple(float(v) if i > 1 else v for i, v in enumerate(p)) for p in parts], "s int, part_id int, t0 double, t1 double, hz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert {r.part_id: r.vehicle for r in matching.stitch_parts(df, K).collect()} == {1: 0, 2: 0, 3: 1}


def test_hysteresis_bridges_and_drops(spark):
    signal = [0.0] * 10 + [7.0] * 4 + [3.0] * 3 + [5.0] * 3 + [0.0] * 20 + [-20.0] * 6 + [0.0] * 10
    df = frame(spark, [(1, float(i), v, True) for i, v in enumerate(signal)], "s int, at double, signal double, ok boolean")
    got = sections.hysteresis_sections(df, K).orderBy("section").collect()
    assert [(r.start_d, r.end_d, r.direction) for r in got] == [(6.5, 22.5, "left"), (36.5, 48.5, "right")]


def test_points_on_triangles(spark):
    tri = frame(spark, [(1, 1, 0.0, 0.0, 60.0, 0.0, 0.0, 60.0)], "s int, tri_id int, ax double, ay double, bx double, by double, cx double, cy double")
    pts = frame(spark, [(1, 10.0, 10.0), (1, 55.0, 2.0), (1, 50.0, 50.0)], "s int, x double, y double")
    assert {(r.x, r.on_surface) for r in sections.on_surface(pts, tri, K).collect()} == {(10.0, True), (55.0, True), (50.0, False)}


def test_windows_and_swap(spark):
    marks = frame(spark, [(1, 1, x) for x in (0.0, 0.01, 0.4, 0.41, 1.0)], "s int, c int, x double")
    b = comparison.boundaries(marks, K, "c", "x", F.lit(0.05))
    assert b.first().boundaries == [0.0, 0.4, 1.0]
    w = comparison.windows_between(b, K, "c").withColumns({"subject_time": F.lit(2.0), "baseline_time": F.lit(1.5)})
    one, other = comparison.window_deltas(w), comparison.swap(comparison.window_deltas(w))
    assert [r.delta for r in one.collect()] == [0.5, 0.5] and [r.delta for r in other.collect()] == [-0.5, -0.5]


def test_corner_windows_are_clipped_in_order(spark):
    rows = [(1, 0.1, 0.3, 0.4, 0.25, "p"), (1, 0.2, 0.5, None, None, "p"), (1, 0.2, 0.24, None, None, "p")]
    got = comparison.corner_windows(frame(spark, rows, "s int, s_lo double, s_hi double, final_hi double, next_start double, source string"), K).orderBy("window_no").collect()
    assert [(r.s_start, r.s_end, r.final_end) for r in got] == [(0.1, 0.25, 0.25), (0.25, 0.5, 0.5)]


def test_complement_and_dedupe(spark):
    spans = frame(spark, [(1, 0, 10)], "s int, lo int, hi int")
    iv = frame(spark, [(1, -5, 2), (1, 3, 4), (1, 4, 6)], "s int, start_t int, end_t int")
    assert [(r.gap_start, r.gap_end) for r in sets.complement(spans, iv, K).orderBy("gap_start").collect()] == [(2, 3), (6, 10)]


def test_absent_is_not_zero(spark):
    df = frame(spark, [(1, None), (1, float("nan"))], "s int, v double")
    r = aggregates.stats(df, K, F.col("v")).first()
    assert (r.n, r.total, r.median) == (0, None, None)
    row = df.select(scalar.to_double(F.col("v")).alias("a"), scalar.delta(F.col("v"), F.lit(None).cast("double")).alias("d"), scalar.signed_text(F.lit(None).cast("double")).alias("t")).first()
    assert (row.a, row.d, row.t) == (None, None, None)


def test_float_bits_and_names(spark):
    from tracewright import functions as fn

    df = frame(spark, [(2001.0, " Ａ  b ", "data12.vfs")], "v float, n string, a string")
    r = df.select(fn.float_bits(F.col("v")).alias("b"), fn.normalize_name(F.col("n"), compatible=True, lower=True).alias("n"), fn.archive_rank(F.col("a")).alias("r")).first()
    assert (r.b, r.n, r.r) == (1157242880, "a b", 12)
