"""Figures of intervals, windows and laps on small fixtures."""

from pyspark.sql import functions as F

from tracewright.operators import measures

ROWS = "s string, t double, v double, d double, slip double"


def rows(spark):
    return spark.createDataFrame([("a", float(i), 10.0 + i, 2.0 * i, -0.1 * i) for i in range(11)] + [("still", 0.0, 0.0, 5.0, 0.0)], ROWS)


def test_intervals_take_the_nearest_rows_at_their_ends(spark):
    iv = spark.createDataFrame([("a", 1, 2.4, 5.6), ("a", 2, 20.0, 21.0), ("a", 3, 3.5, 3.5), ("still", 4, 0.0, 0.0), ("none", 5, 0.0, 1.0)], "s string, id int, start_t double, end_t double")
    for width in (None, 2.0):
        got = {r.id: r for r in measures.measure_intervals(iv, rows(spark), ["s"], "id", "t", "v", "d", "slip", width).collect()}
        one = got[1]
        assert (one.entry_speed, one.exit_speed, one.min_speed, one.max_speed, one.n_rows, one.length) == (12.0, 16.0, 13.0, 15.0, 3, 8.0)
        assert (one.start_progress, one.end_progress) == (0.2, 0.6) and abs(one.peak_slip - 0.5) < 1e-9 and abs(one.mean_slip - 0.4) < 1e-9
        assert (got[2].entry_speed, got[2].min_speed, got[2].n_rows) == (20.0, None, 0)
        assert got[3].entry_speed == 13.0 and got[3].n_rows == 0
        assert got[4].start_progress is None and got[4].n_rows == 1
        assert got[5].entry_speed is None and got[5].length is None
    assert measures.measure_intervals(iv.where("false"), rows(spark), ["s"], "id", "t", "v", "d", "slip").count() == 0


def test_only_the_last_window_holds_its_end(spark):
    w = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 5.0, 10.0), ("b", 3, 0.0, 1.0)], "s string, w int, start_t double, end_t double")
    ep = spark.createDataFrame([("a", 0.0, 1.0), ("a", 5.0, 9.0), ("a", 10.0, 12.0), ("a", 10.5, 12.0)], "s string, start_t double, end_t double")
    got = {r.w: r for r in measures.measure_windows(w, rows(spark), ep, ["s"], "w", ["t"], "v").collect()}
    assert (got[1].entry_speed, got[1].exit_speed, got[1].avg_speed, got[1].episodes, got[1].closed_end) == (10.0, 14.0, 12.0, 1, False)
    assert (got[2].entry_speed, got[2].exit_speed, got[2].episodes, got[2].episode_time) == (15.0, 20.0, 2, 6.0)
    assert (got[3].entry_speed, got[3].episodes, got[3].closed_end) == (None, 0, True)


def test_segments_belong_to_the_lap_of_their_start(spark):
    s = spark.createDataFrame([("a", 1, 1, 1, 2), ("a", 2, 1, 2, 1), ("a", 3, 2, None, 1)], "s string, seg int, lap int, lap_end int, members int")
    got = {r.lap: r for r in measures.segments_by_owner(s, ["s"], "lap", "lap_end", "seg", "members").collect()}
    assert (got[1].segments, got[1].n_members, got[1].n_crossing) == ([1, 2], 3, 1) and got[2].n_crossing == 0


def test_starts_medians_differences_and_summaries(spark):
    iv = spark.createDataFrame([("a", 3, "x"), ("a", 1, "x"), ("a", 2, "z")], "s string, start_t int, kind string")
    one = measures.starts_by_kind(iv, ["s"], {"x": F.col("kind") == "x", "y": F.col("kind") == "y"}).first()
    assert (one.x_starts, one.n_x, one.y_starts, one.n_y) == ([1, 3], 2, [], 0)
    e = spark.createDataFrame([(1, 20.0, 10.0, 18.0, 1.0), (1, 22.0, 12.0, 20.0, 2.0)], "lap int, a double, b double, c double, d double")
    m = measures.episode_medians(e, ["lap"], "a", "b", "c", "d").first()
    assert (m.episodes, m.duration, m.entry, m.recovery) == (2, 3.0, 21.0, 8.0)
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sorted(measures.differences(a, spark.createDataFrame([(1,), (3,)], "x int")).collect()) == [(1, "stored"), (2, "stored"), (3, "derived")]
    assert measures.differences(a, a).count() == 0
    s = spark.createDataFrame([("p", "ok"), ("p", "ok"), ("q", None), ("r", "ok")], "id string, status string")
    assert {(r.status, r.n_rows, r.n_ids, r.share) for r in measures.summary(s, "id", "status").collect()} == {("ok", 3, 2, 0.75), ("unknown", 1, 1, 0.25)}
