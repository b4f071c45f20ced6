"""Results and plans that only larger tables showed to be wrong."""

import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tracewright import queries_python
from tracewright.functions import scalar
from tracewright.operators import matching
from tracewright.sources import native_tables, recordings, synthetic


def test_recordings_are_never_broadcast(spark, tmp_path):
    # the file is small, what is made of it is not
    spark.range(3000).select(F.col("id").alias("replay"), F.concat(F.lit("room"), F.col("id") % 7, F.lit("-lap-of-someone")).alias("hint")).write.parquet(str(tmp_path / "r"))
    replays = spark.read.parquet(str(tmp_path / "r"))
    rooms = spark.createDataFrame([("room", 1), ("room2", 2), ("room3", 3), ("room3", 4)], "room string, game_id long")
    bindings = spark.createDataFrame([(1, 11, True), (2, 12, True), (3, 13, True)], "game_id long, resource_id long, authoritative boolean")
    confirmed = replays.where("replay < 10").select("replay", F.lit(5).cast("long").alias("resource_id"))
    names = spark.createDataFrame([("room3-lap-of-someone", 9)], "name string, resource_id long")
    got = matching.resolve_tiers(replays, rooms, bindings, confirmed, names)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("SortMergeJoin") >= 3
    by = {r.replay: (r.resource_id, r.method) for r in got.collect()}
    assert len(by) == 3000 and (by[0], by[2], by[3], by[10]) == ((11, "room_prefix"), (12, "room_prefix"), (5, "user_confirmed"), (9, "exact_name"))
    # a repeated recording goes by the longest room of all its hints
    twice = matching.resolve_tiers(spark.createDataFrame([(1, "room2x"), (1, "roomy"), (1, ""), (2, None)], "replay long, hint string"), rooms, bindings, confirmed.where("false"), names)
    assert sorted((r.replay, r.hint or "", r.resource_id) for r in twice.collect()) == [(1, "", 12), (1, "room2x", 12), (1, "roomy", 12), (2, "", None)]


def test_a_user_of_one_click_has_no_corners(spark, tmp_path):
    rows = [(k, u, k * 10.0) for k, u in enumerate([0, 0, 0, 1, 1, 1, 2, 3, 3, 3])]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    e = e.select("event_id", F.timestamp_seconds(F.col("value")).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value", F.lit('{"k": 1}').alias("props"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = queries_python.corner_pairing(spark, str(tmp_path)).collect()
    assert {(r.pair, r.left_corner, r.right_corner) for r in got} == {(0, 0, 3), (0, 1, 4), (0, 2, 5)}


def test_signed_text_rounds_the_exact_value(spark):
    values = [0.0375, 0.0125, -0.0375, 0.2385, 1.0005, -0.0001, 2.5, 0.0, 123456.7895, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.t for r in df.select(scalar.signed_text(F.col("v")).alias("t")).collect()]
    assert got == [duckdb.execute("SELECT printf('%+.3f', ?::DOUBLE)", [v]).fetchone()[0] for v in values] and got[0] == "+0.037"


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_scan_holds_few_bytes_for_each_of_a_file():
    data = np.frombuffer(synthetic.vehicle_records(4000) + b"\xff" * 512, np.uint8)
    assert len(list(recordings.lane_runs(data, 230))) == 1
    assert peak(lambda: list(recordings.lane_runs(data, 230))) < 20 * len(data)
    assert peak(lambda: list(native_tables.drift_candidates(bytes(data), len(data)))) < 10 * len(data)


def test_pairs_keep_a_move_a_cell_and_totals_of_two_rows():
    u = np.linspace(0, 1, 500)
    edge = np.concatenate(([0.0], u))
    cost, band = np.abs(u[:, None] - u[None]), np.abs(edge[:, None] - edge[None]) <= 0.02
    ok = cost <= 0.01
    assert matching.monotone_pairs(cost, ok, band) == [(i, i) for i in range(500)]
    assert peak(lambda: matching.monotone_pairs(cost, ok, band)) < 4 * cost.size


def test_laps_are_aligned_once_for_their_shared_progress(spark):
    plan = queries_python.shared_progress(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 0


def test_files_travel_once_and_are_never_broadcast(spark):
    car = synthetic.vehicle_records(120) + b"\xff" * 512
    files = spark.createDataFrame([(f"r{k}", bytearray(car + car)) for k in range(4)] + [("none", None)], "replay_sha string, content binary").repartition(4)
    found = recordings.streams(recordings.stream_candidates(files))
    rows = recordings.decode(files, found, ["replay_sha", "stream", "i", "time_ms"])
    assert rows.columns == ["replay_sha", "stream", "i", "time_ms"]
    assert {(r.replay_sha, r.stream): r["count"] for r in rows.groupBy("replay_sha", "stream").count().collect()} == {(f"r{k}", s): 120 for k in range(4) for s in (0, 1)}
    assert "LeftOuter" in rows._jdf.queryExecution().optimizedPlan().toString()
