"""Whole plans on recordings made in memory."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import catalogs
from tracewright.plans import analysis, compare
from tracewright.plans.catalog import Catalog
from tracewright.sources import native_tables, synthetic, tabular
from tracewright.streaming import landing


def files(spark):
    cars = [synthetic.vehicle_records(600), synthetic.vehicle_records(120, 60, 30, 0.5, 40.0)]
    data = synthetic.recording(cars, [(2000, 2400), (2450, 2800), (4000, 4600)], [(2850, 1, 2001.0), (3200, 0, 2001.0), (5000, 1, 1.0), (5600, 0, 1.0)], [2850, 3000, 3283], [8, 24, 25])
    return spark.createDataFrame([("r0", bytearray(data))], "replay_sha string, content binary")


def test_analysis_of_a_recording(spark):
    s = analysis.silver(files(spark))
    assert {r.role: r.n for r in s.rows.groupBy("role").agg(F.count("*").alias("n")).collect()} == {"local_high_frequency": 600, "network_low_frequency": 120}
    assert [(r.start_t, r.end_t, r.members) for r in s.drifts.orderBy("start_t").collect()] == [(2000, 2800, 2), (4000, 4600, 1)]
    assert {(r.code, r.semantic) for r in s.effects.collect()} == {(2001.0, "drift_small_boost"), (1.0, "nitro")}
    got = analysis.segments(s).orderBy("start_t").collect()
    assert [(r.start_t, r.recovery_end, r.end_reason) for r in got] == [(2000, 3200, "native_small_boost_end"), (4000, 4600, "no_native_recovery_effect")]
    e = analysis.episodes(s).orderBy("start_t").collect()
    assert e[0].first_boost_ms == 50 and e[1].first_boost_ms is None and e[0].episode_id == "L1-D01" and abs(e[0].avg_speed - 11.765) < 1e-3
    a = analysis.action_semantics(s).first()
    assert (a.gate, a.cw.value, a.cww.value, a.n24) == ("aligned", 1, 0, 1)
    laps = analysis.laps(s.rows).where("stream = 0").orderBy("run").collect()
    assert [r.lap_index for r in laps] == [1, 2] and all(r.status == "estimated_from_movement" for r in laps)
    table = {(r.stream, r.lap_index): r for r in analysis.lap_table(s).collect()}
    assert table[0, 1].drifts == 2 and table[1, 1].drifts is None and table[0, 2].drifts == 0
    doc = analysis.documents(s).first()
    assert len(doc.segments) == 2 and doc.schema_version == 1


def test_documents_are_rebuilt_bucket_by_bucket(spark, tmp_path):
    one = files(spark).first().content
    both = spark.createDataFrame([("r0", one), ("r1", one + b"\xff")], "replay_sha string, content binary")
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.add(both)
    got = analysis.rebuild_documents(catalog, both, f"file://{tmp_path}/out", buckets=2).collect()
    assert {r.status for r in got} == {"rebuilt"} and sum(r.recordings for r in got) == 2
    docs = {r.replay_sha: r for r in spark.read.parquet(f"{tmp_path}/out/data").collect()}
    local = next(x for x in docs["r0"].streams if x.role == "local_high_frequency")
    other = next(x for x in docs["r0"].streams if x.role != "local_high_frequency")
    assert local.n_rows == 600 and local.table_status == native_tables.TABLE_FOUND and other.table_status == native_tables.TABLE_REFUSED and abs(local.hz - 1000 / 17) < 1e-6
    assert docs["r0"].actions.combo.cw == 1 and len(docs["r1"].segments) == 2
    assert all(x.analysed for x in catalog.entries().collect())
    assert {r.status for r in analysis.rebuild_documents(catalog, both, f"file://{tmp_path}/out", buckets=2).collect()} == {"kept"}


def test_sections_hold_what_began_in_them(spark):
    s = analysis.silver(files(spark))
    rows = lap_rows(spark, {1: 0.1}).withColumns({"replay_sha": F.lit("r0"), "time_ms": (F.col("time_s") * 1000).cast("long"), "speed": F.lit(20.0), "role": F.lit("local_high_frequency")})
    bend = rows.withColumns({"x": F.when(F.col("distance") < 300, F.col("distance")).otherwise(300 + 8 * F.sin((F.col("distance") - 300) / 8)), "y": F.when(F.col("distance") < 300, 0.0).otherwise(8 - 8 * F.cos((F.col("distance") - 300) / 8))})
    bend = bend.where("distance < 315")
    turned = analysis.Silver(bend, s.tables, s.drifts, s.effects, s.air, s.actions)
    (got,) = analysis.training_sections(turned).collect()
    assert got.representative and (got.drifts, got.boosts, got.nitros) == (0, 0, 0) and got.start_d > 280
    moved = s.drifts.withColumns({"start_t": F.col("start_t") - F.col("start_t") + got.start_t, "end_t": F.lit(got.end_t).cast("long")})
    (got,) = analysis.training_sections(analysis.Silver(bend, s.tables, moved, s.effects, s.air, s.actions)).collect()
    assert got.drifts == 2 and got.boosts == 0
    (got,) = analysis.training_sections(analysis.Silver(bend, s.tables.withColumn("count_offset", F.lit(None).cast("long")), moved, s.effects, s.air, s.actions)).collect()
    assert got.drifts is None


def test_key_presses_decide_between_tables(spark):
    right, wrong = [(2000, 2400), (2450, 2800), (4000, 4600)], [(150, 400), (500, 900), (1100, 1700)]
    tables = b"".join(synthetic.toggle_table(t) + synthetic.effect_table([]) + b"\xff" * 40 for t in (wrong, right))
    df = spark.createDataFrame([("r", bytearray(b"\xff" * 200 + tables + b"\xff" * 400))], "replay_sha string, content binary")
    found = native_tables.drift_tables(df)
    starts = lambda rises: [r.start_t for r in native_tables.drift_intervals(found, rises).orderBy("ordinal").collect()]
    rises = lambda *t: spark.createDataFrame([("r", x) for x in t], "replay_sha string, t long")
    assert starts(None) == starts(rises(99999)) == [150, 500, 1100]
    assert starts(rises(2034, 3990)) == [2000, 2450, 4000]
    assert starts(rises(150, 535)) == [150, 500, 1100]


def test_parts_of_a_vehicle_are_one_stream(spark):
    cars = [synthetic.vehicle_records(300), synthetic.vehicle_records(300, 17, 17 * 300, 0.2, 60.0)]
    data = synthetic.recording(cars, [(2000, 2400), (2450, 2800)], [], [1000], [8])
    s = analysis.silver(spark.createDataFrame([("r0", bytearray(data))], "replay_sha string, content binary"))
    got = s.rows.groupBy("stream", "role").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.countDistinct("i").alias("order"), F.max("distance").alias("d")).collect()
    assert [(r.stream, r.role, r.n, r.parts, r.order) for r in got] == [(0, "local_high_frequency", 600, 2, 600)] and got[0].d > 110


def lap_rows(spark, pace):
    rows = []
    for lap, p in pace.items():
        for i in range(301):
            a = 2 * math.pi * i / 300
            rows.append(("r", 0, lap, i + 1000 * lap, lap * 1000 + i * p, 100 * math.cos(a), 100 * math.sin(a), 2.094 * i, True, False))
    return spark.createDataFrame(rows, "replay_sha string, stream int, lap_index int, i int, time_s double, x double, y double, distance double, pose_valid boolean, break_before boolean")


def test_comparison_adds_up_and_negates_on_swap(spark):
    rows = lap_rows(spark, {1: 0.1, 2: 0.12})
    one = spark.createDataFrame([("p", "r", 0, 2, "r", 0, 1)], "pair string, a_sha string, a_stream int, a_lap int, b_sha string, b_stream int, b_lap int")
    marks = spark.createDataFrame([("p", x / 10) for x in range(1, 10)], "pair string, shared double")
    got = compare.compare(rows, one, marks)
    t = got["totals"].first()
    assert t.status == "reconciled" and abs(t.total_delta - 6.0) < 1e-6 and t.n_windows == 10
    assert got["coverage"].first().coverage == 1.0 and not got["coverage"].first().degraded
    turned = one.select("pair", *[F.col(f"{o}_{c}").alias(f"{s}_{c}") for s, o in (("a", "b"), ("b", "a")) for c in ("sha", "stream", "lap")])
    other = {r.window_no: r.delta for r in compare.compare(rows, turned, marks)["windows"].collect()}
    for r in got["windows"].collect():
        assert abs(r.delta + other[r.window_no]) < 1e-6
    assert compare.compare(rows, one, custom=(0.2, 0.4))["windows"].count() == 1
    assert compare.compare(rows, one, custom=(0.2, 1.4))["windows"].count() == 0


def test_every_lap_meets_the_fastest(spark):
    laps = spark.createDataFrame([("r", 0, 1, 30.0, 31.0), ("r", 0, 2, 29.0, 33.0), ("r", 0, 3, None, 28.0)], "replay_sha string, stream int, lap_index int, race_time_estimate double, span double")
    assert {(r.a_lap, r.b_lap) for r in compare.fastest_pairs(None, laps).collect()} == {(1, 3), (2, 3)}


def test_catalog_keeps_the_last_version(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    assert c.entries().count() == 0
    c.add(spark.createDataFrame([("a",), ("b",), ("a",)], "replay_sha string"))
    c.add(spark.createDataFrame([("b",), ("c",)], "replay_sha string"))
    c.change(["a"], visible=False)
    c.change(["b"], state="removed", label="old")
    got = {r.replay_sha: (r.state, r.visible, r.label) for r in c.entries().collect()}
    assert got == {"a": ("active", False, None), "b": ("removed", True, "old"), "c": ("active", True, None)}
    src = spark.createDataFrame([("a",), ("c",), ("d",)], "replay_sha string")
    assert [r.replay_sha for r in c.to_rebuild(src).collect()] == ["c"]
    assert {(r.replay_sha, r.in_catalog, r.has_source) for r in c.reconcile(src, src.where("false")).collect()} == {("a", True, True), ("b", True, False), ("c", True, True), ("d", False, True)}


def test_arrivals_are_analysed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = files(spark).first().content
    (tmp_path / "in" / "one.sav").write_bytes(data)
    (tmp_path / "in" / "copy.sav").write_bytes(data)
    seen = []

    def write(df, batch):
        seen.append((batch, df.count()))

    for _ in range(2):
        landing.analyse_arrivals(landing.arrivals(spark, str(tmp_path / "in")), write, str(tmp_path / "ck")).awaitTermination(60)
    assert seen == [(0, 1)]


def test_sessions_of_a_stream(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (1, "2024-01-01 01:00:00")], "u int, t string").selectExpr("u", "cast(t as timestamp) as t")
    src.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("u int, t timestamp").parquet(str(tmp_path / "ev"))
    q = landing.merged_segments(stream, ["u"], "t", "10 seconds", "1 minute").writeStream.outputMode("append").format("memory").queryName("sessions").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert [r.members for r in spark.table("sessions").collect()] == [2]


def test_derived_tables_go_and_labels_stay(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/catalog")
    c.add(spark.createDataFrame([("a",), ("b",)], "replay_sha string"))
    c.change(["a"], analysed=True, label="kept")
    spark.range(3).write.parquet(f"file://{tmp_path}/gold")
    c.reset_derived(f"file://{tmp_path}/gold")
    assert {(r.replay_sha, r.label, r.analysed) for r in c.entries().collect()} == {("a", "kept", False), ("b", None, False)} and not (tmp_path / "gold").exists()


def test_outputs_of_the_map_catalog(spark, tmp_path):
    e = spark.createDataFrame([(1, "x", "exact"), (2, "x", "multiple"), (3, None, "unavailable")], "map_id int, primary_name string, name_status string")
    catalogs.write_catalog(e, f"file://{tmp_path}")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/duplicate_names").select("primary_name", "map_ids").collect()] == [("x", [1, 2])]
    assert sorted(r.map_id for r in spark.read.option("header", True).csv(f"{tmp_path}/unresolved_maps").collect()) == ["2", "3"]
    assert spark.read.json(f"{tmp_path}/map_index").count() == spark.read.option("header", True).csv(f"{tmp_path}/maps").count() == 3


def test_rows_that_lost_their_measures_are_refused(spark, tmp_path):
    head = "replay_sha,stream,time_s,x,y,z,contact_state,lap_index,vx\n"
    (tmp_path / "good.csv").write_text(head + "r,1,2,0,0,0,5,1,3\nr,0,0,0,0,0,5,1,3\nr,0,1,0,0,0,5,1,3\nr,0,,0,0,0,5,1,3\n")
    (tmp_path / "lost.csv").write_text(head + "r,0,0,0,0,0,,1,3\n")
    rows = tabular.physical_telemetry(spark, f"{tmp_path}/good.csv", "2026")
    assert sorted((r.stream, r.n, r.hz, r.part_no) for r in tabular.part_metadata(rows).collect()) == [("0", 2, 1.0, 1), ("1", 1, None, 2)]
    with pytest.raises(ValueError, match="contact_state"):
        tabular.physical_telemetry(spark, f"{tmp_path}/lost.csv", "2026")
    assert tabular.physical_telemetry(spark, f"{tmp_path}/lost.csv").count() == 1
