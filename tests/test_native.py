"""Tables of vehicles, states, semantics, the native cache and concurrent writers on made recordings."""

import threading

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import comparison, matching, meshes, semantics
from tracewright.plans import native_cache
from tracewright.plans.catalog import Catalog
from tracewright.sources import native_tables, recordings, synthetic

RISES = "replay_sha string, stream int, t long"


def found(spark, *tables):
    data = b"\xff" * 200 + b"".join(t + b"\xff" * 40 for t in tables) + b"\xff" * 400
    return native_tables.drift_tables(spark.createDataFrame([("r", bytearray(data))], "replay_sha string, content binary"))


def marked(*intervals):
    return synthetic.toggle_table(list(intervals)) + synthetic.effect_table([])


def test_claims_in_order_pass_over_what_is_taken(spark):
    rows = [("a", 0, "x", 9), ("a", 0, "y", 8), ("a", 1, "x", 9), ("a", 2, "x", 5), ("a", 2, "y", 1), ("b", 3, "z", 1), (None, 0, "w", 1)]
    df = spark.createDataFrame(rows, "k string, who int, item string, score int")
    got = {(r.k, r.who): r.item for r in matching.claim_in_order(df, ["k"], "who", "item", [-F.col("score")]).collect()}
    assert got == {("a", 0): "x", ("a", 1): None, ("a", 2): "y", ("b", 3): "z", (None, 0): "w"}


def test_each_vehicle_has_its_own_table_and_a_missing_one_is_not_empty(spark):
    tables = found(spark, marked((500, 900), (2500, 2900), (4500, 4900)), marked((1500, 1800), (3300, 3600)), marked((340, 700), (1020, 1400), (2040, 2400)))
    vehicles = spark.createDataFrame([("r", k, k) for k in range(4)] + [("other", 0, 0)], "replay_sha string, stream int, shadow int")
    rises = spark.createDataFrame([("r", 0, 350), ("r", 0, 1020), ("r", 0, 1200), ("r", 0, 5000), ("r", 1, 520), ("r", 1, 2534)], RISES)
    got = {(r.replay_sha, r.stream): r for r in native_tables.assign_tables(tables, vehicles, rises).collect()}
    assert [got["r", k].intervals and got["r", k].intervals[0][0] for k in range(4)] == [340, 500, 1500, None]
    first = got["r", 0]
    assert (first.matches, first.retriggers, first.outside, first.n_rises, first.eligible) == (2, 1, 1, 4, 3)
    assert got["r", 3].status == native_tables.TABLE_REFUSED and got["r", 3].retriggers is None and got["r", 3].eligible == 0
    assert got["other", 0].status == native_tables.TABLE_MISSING
    drifts = native_tables.vehicle_drifts(native_tables.assign_tables(tables, vehicles, rises)).groupBy("stream").count().collect()
    assert {r.stream: r["count"] for r in drifts} == {0: 3, 1: 3, 2: 2}


def test_a_marked_empty_table_is_a_table(spark):
    tables = found(spark, synthetic.toggle_table([]) + synthetic.effect_table([]))
    vehicles = spark.createDataFrame([("r", 0, 0)], "replay_sha string, stream int, shadow int")
    r = native_tables.assign_tables(tables, vehicles, spark.createDataFrame([], RISES)).first()
    assert r.status == native_tables.TABLE_EMPTY and r.intervals == [] and r.n_rises == 0 and r.share == 1.0


def test_alias_and_repeated_path_are_no_vehicles(spark):
    alias = synthetic.vehicle_records(200, second_phase=recordings.ALIAS_PHASE, second_shift=3.0)
    other = synthetic.vehicle_records(200, second_phase=90, second_shift=3.0)
    twice = synthetic.vehicle_records(200, layout="2025", second_phase=100)
    r = spark.createDataFrame([(n, bytearray(c + b"\xff" * 512)) for n, c in (("alias", alias), ("other", other), ("twice", twice))], "replay_sha string, content binary")
    seen = {x.replay_sha: x.n for x in recordings.stream_candidates(r).groupBy("replay_sha").agg(F.count("*").alias("n")).collect()}
    kept = {x.replay_sha: (x.n, x.p) for x in recordings.streams(recordings.stream_candidates(r)).groupBy("replay_sha").agg(F.count("*").alias("n"), F.first("profile").alias("p")).collect()}
    assert seen == {"alias": 2, "other": 2, "twice": 2} and kept == {"alias": (1, "2026"), "other": (2, "2026"), "twice": (1, "2025")}


def test_state_lanes_add_up_over_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    stride, n, start = 230, 500, 300
    data = rng.integers(8, 256, start + stride * n + 200).astype(np.uint8)
    at = start + stride * np.arange(n)
    data[at + 5] = (np.arange(n) // 10) % 3  # a state
    data[at - 90] = (np.arange(n) // 40) % 8  # eight values, changes enough
    data[at + 6] = 1  # constant
    data[at + 7] = np.arange(n) % 2  # changes too often
    data[at + 8] = np.arange(n) > 250  # changes once
    data[at + 9] = np.where(np.arange(n) == 499, 9, (np.arange(n) // 10) % 3)  # one value too large
    want = [(-90, 12, list(range(8))), (5, 49, [0, 1, 2])]
    for stretch in (1 << 16, 64):
        monkeypatch.setattr(recordings, "LANE_RECORDS", stretch)
        got = recordings.state_lanes(data, start, stride, n)
        assert [(x["lane"], x["changes"], x["states"]) for x in got] == want and sum(got[1]["counts"]) == n


def test_greedy_pairs_in_small_batches(spark):
    rows = [(u, i, float(10 * i + (3 if k == "r" else 0)), k) for u in (1, 2, None) for i, k in enumerate("lrlbrlrrllr" * 6)]
    df = spark.createDataFrame(rows, "u int, i int, t double, k string")
    go = lambda: sorted(map(str, matching.greedy_pairs(df, ["u"], "i", "t", F.col("k") == "l", F.col("k") == "r", F.col("k") != "l", 12.0).collect()))
    want = go()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert go() == want and len(want) == 3 * 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_keep_their_number_of_tasks(spark):
    df = spark.range(100).selectExpr("id % 10 AS u", "id", "0 AS _block")
    out = matching.blockwise(df.distinct(), ["u"], lambda c: {"n": [len(c["id"])]}, "n long", ["id"])
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and [r.n for r in out.collect()] == [10] * 10


def test_semantics_of_missing_tables_are_null(spark):
    streams = spark.createDataFrame([("a", True, True), ("b", False, False)], "k string, drift_table boolean, effect_table boolean")
    actions = spark.createDataFrame([("a", None, None, None), ("b", 0, 100, 8), ("b", 1, 200, 77)], "k string, record_index int, time_ms long, action_code long")
    effects = spark.createDataFrame([], "k string, ordinal int, code double, start_t long")
    drifts = spark.createDataFrame([], "k string, start_t long, end_t long, members long")
    got = {r.k: r for r in semantics.action_semantics(streams, actions, effects, drifts, drifts, ["k"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.status, a.game_facing, a.air_boost, a.combo.n24, a.drift.raw_intervals, a.small_boost.raw_count) == (semantics.UNAVAILABLE, False, None, None, 0, 0)
    assert (b.status, b.air_boost, b.combo.cw, b.drift.raw_intervals, b.small_boost.unresolved, b.nitro) == (semantics.READY, 1, 0, None, None, None)
    assert b.alignment.status == semantics.NO_EFFECTS and [(x.action_code, x["count"]) for x in b.unknown_codes] == [(77, 1)] and b.histogram == {"8": 1, "77": 1}


def test_tail_only_where_effects_cannot_be_seen(spark):
    rows = spark.createDataFrame([("s", t / 10, 10.0 + t, 2.0 * t, True) for t in range(60)], "k string, t double, speed double, distance double, pose_valid boolean")
    w = [("native", 2.5, None, True, False, 0), ("seen", None, None, True, False, 0), ("unseen", None, None, False, False, 0), ("cut", None, 2.1, False, False, 0), ("low", None, None, True, True, 0), ("low_boost", None, None, True, True, 2)]
    w = spark.createDataFrame([("s", n, 1.0, 2.0, r, x, o, low, b, 0) for n, r, x, o, low, b in w], "k string, w string, drift_start double, drift_end double, recovery_end double, next_drift double, observable boolean, low_frequency boolean, boosts int, nitros int")
    drifts = w.select("k", "w", F.lit(1.0).alias("start_t"), F.lit(2.0).alias("end_t"))
    got = {r.w: r for r in comparison.corner_metrics(w, drifts, rows, ["k"], "w").collect()}
    assert {n: (r.metric_end, r.metric_source) for n, r in got.items()} == {
        "native": (2.5, comparison.TAIL_NATIVE), "seen": (2.0, comparison.TAIL_NONE), "unseen": (2.25, comparison.TAIL_GAMEPLAY), "cut": (2.1, comparison.TAIL_GAMEPLAY), "low": (2.25, comparison.TAIL_GAMEPLAY), "low_boost": (2.0, comparison.TAIL_NONE),
    }
    assert (got["unseen"].recovery_distance, got["unseen"].exit_speed, got["seen"].recovery_distance, got["seen"].exit_speed) == (5.0, 32.0, 0.0, 30.0)


def test_projection_of_nothing_and_of_a_line(spark):
    kinds = "k string, " + ", ".join(f"{c}{x} double" for c in "abc" for x in "xyz") + ", hidden boolean"
    df = spark.createDataFrame([("hidden", *[1.0] * 9, True), ("point", *[2.0] * 9, False), ("flat", 0.0, 0.0, 0.0, 10.0, 0.0, 0.1, 0.0, 10.0, 0.0, None)], kinds)
    got = {r.k: r for r in meshes.best_projection(meshes.mesh_projections(df, ["k"]), ["k"]).collect()}
    assert got["hidden"].vertices == 0 and got["hidden"].thickness == got["point"].thickness == float("inf") and got["flat"].plane == "xy" and not got["flat"].flat
    t = {r.k: r.status for r in meshes.map_transform(meshes.best_projection(meshes.mesh_projections(df, ["k"]), ["k"]), ["k"]).collect()}
    assert t == {"hidden": "no_visible_geometry", "point": "official", "flat": "official"}


def test_cache_outcomes_without_a_query(spark):
    content = b"\xff" * 300_000 + marked((500, 900), (2500, 2900)) + b"\xff" * 400
    src = spark.createDataFrame([("a", bytearray(content)), ("b", None)], "replay_sha string, content binary").withColumn("size_bytes", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    stored = native_cache.scan_rows(src.withColumn("base", F.lit(0).cast("long")))
    row = {r.replay_sha: r for r in stored.collect()}
    assert (row["a"].n_tables, row["b"].n_tables, row["a"].tail_start) == (1, 0, len(content) - native_tables.TAIL - 4)
    modes = lambda *a, **k: {r.replay_sha: (r.mode, r.status) for r in native_cache.checked(*a, **k).collect()}
    assert modes(src, stored) == {x: (native_cache.REUSE, native_cache.USABLE) for x in "ab"}
    assert modes(src.where("replay_sha = 'a'"), stored)["b"] == (native_cache.ORPHAN, "native_action_cache_without_source")
    assert modes(src, stored, force=True)["a"] == (native_cache.REBUILT, native_cache.FORCED)
    assert modes(src, stored, scanner="v9")["a"] == (native_cache.FROM_TAIL, "native_action_scanner_contract_mismatch")
    assert modes(src, stored, scanner="v9", tail_bytes=250_000)["a"] == (native_cache.REBUILT, "native_action_cache_tail_window_too_small")
    again = native_cache.refreshed(src, stored, scanner="v9").where("replay_sha = 'a'").first()
    assert again.tables == row["a"].tables and again.scanner_contract == "v9" and again.mode == native_cache.FROM_TAIL
    assert {r.agrees for r in native_cache.audit(src, stored).collect()} == {True}


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    errors = []

    def write(side):
        try:
            c = Catalog(spark, path)
            for k in range(6):
                c.add(spark.createDataFrame([(f"{side}{k}",)], "replay_sha string"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(s,)) for s in "xy"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    c = Catalog(spark, path)
    assert not errors and sorted(r.replay_sha for r in c.entries().collect()) == sorted(f"{s}{k}" for s in "xy" for k in range(6))
    commits = c.commits.read()
    assert [x["version"] for x in commits] == list(range(1, 13)) and len({x["data"] for x in commits}) == 12
    assert len(list((tmp_path / "catalog" / "data").iterdir())) == 12 and not list((tmp_path / "catalog" / "commits").glob("*.draft"))
    assert not c.commits.put(12, {"data": "late", "full": False})


def test_a_full_commit_keeps_all_entries(spark, tmp_path, monkeypatch):
    from tracewright.plans import catalog

    monkeypatch.setattr(catalog, "FULL_EVERY", 3)
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    for k in range(8):
        c.add(spark.createDataFrame([(f"r{k}",)], "replay_sha string"))
    c.change(["r0"], label="first")
    assert c.entries().count() == 8 and len(c._folders()[1]) < 5 and [r.label for r in c.entries().where("replay_sha = 'r0'").collect()] == ["first"]
