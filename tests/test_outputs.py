"""Catalog outputs, packages, rebuilds, text search and small functions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalar
from tracewright.operators import catalogs, sets
from tracewright.plans.catalog import Catalog
from tracewright.plans.rebuild import rebuild
from tracewright.sources import maps, native_tables, packages, tabular


def identities(spark):
    d = [(1, "Road-by-ann", "a", True), (1, "Old", "b", False), (2, "ROAD", "c", True), (3, "??", "d", True), (4, "x", "e", True), (4, "y", "f", True), (5, "stale", "g", True)]
    o = [(2, "Road", 2), (5, "fresh", 5), (6, "???", 6), (6, "???", 7)]
    return spark.createDataFrame(d, "map_id int, name string, md5 string, parsed boolean"), spark.createDataFrame(o, "map_id int, name string, game_id int")


def test_names_of_two_authorities(spark):
    d, o = identities(spark)
    e = catalogs.identity_entries(d, o)
    got = {r.map_id: r for r in e.collect()}
    assert {k: (r.primary_name, r.name_source, r.name_status, r.identity_status) for k, r in got.items()} == {
        1: ("Road-by-ann", "descriptor", "exact", "absent"), 2: ("Road", "declared", "declared", "unanimous"), 3: (None, "descriptor", "unavailable", "absent"),
        4: ("x", "descriptor", "multiple", "absent"), 5: ("fresh", "declared", "declared", "unanimous"), 6: (None, "descriptor", "unavailable", "conflicting"),
    }
    assert got[6].game_id is None and got[1].aliases == ["Road"] and got[1].failures == 1
    assert catalogs.duplicate_names(e).collect() == []
    assert [tuple(r) for r in catalogs.alias_collisions(e).collect()] == [("road", [1, 2])]


def test_all_outputs_and_a_changed_source(spark, tmp_path):
    d, o = identities(spark)
    path = f"file://{tmp_path}/out"
    catalogs.write_identities(catalogs.identity_entries(d, o), d, o, "SIG", path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["alias_collisions", "catalog_meta", "descriptor_versions", "duplicate_names", "map_index", "maps", "unresolved_maps"]
    meta = spark.read.json(f"{path}/catalog_meta").first().asDict()
    assert len(meta) == 14 and (meta["map_id_count"], meta["alias_collision_count"], meta["descriptor_name_stale_map_count"], meta["declared_identity_conflict_count"], meta["descriptor_exact_parse_count"]) == (6, 1, 2, 1, 6)
    assert sorted(r.map_id for r in spark.read.option("header", True).csv(f"{path}/unresolved_maps").collect()) == ["3", "4", "6"]
    assert catalogs.load_or_fail(spark, path, "SIG").count() == 6
    with pytest.raises(ValueError, match="other sources"):
        catalogs.load_or_fail(spark, path, "ANOTHER")
    with pytest.raises(FileNotFoundError):
        catalogs.load_or_fail(spark, f"{path}/none", "SIG")


def test_repair_upsert_and_budget(spark):
    e = spark.createDataFrame([(1, None, "unavailable"), (2, "kept", "exact")], "map_id int, primary_name string, name_status string")
    fresh = spark.createDataFrame([(1, "b"), (1, "a"), (1, "??"), (2, "other")], "map_id int, name string")
    assert {tuple(r) for r in catalogs.repair_names(e, fresh).select("map_id", "primary_name", "name_status").collect()} == {(1, "a", "repaired"), (2, "kept", "exact")}
    change = spark.createDataFrame([(2, "new", "exact"), (3, "more", "exact")], e.schema)
    assert {(r.map_id, r.primary_name) for r in catalogs.upsert(e, change, "map_id").collect()} == {(1, None), (2, "new"), (3, "more")}
    ranked = spark.createDataFrame([("p", s, k) for s in ("gain", "loss") for k in range(1, 4)], "pair string, side string, rank int")
    assert [(r.side, r["rank"]) for r in sets.observation_budget(ranked, ["pair"], 4).orderBy("position").collect()] == [("loss", 1), ("loss", 2), ("loss", 3), ("gain", 1)]


def rows(spark):
    return spark.createDataFrame([("r0", 0, t / 2, float(t), "direct, \"x\"") for t in range(5)] + [("r1", 1, 0.0, None, None)], "replay_sha string, stream int, time_s double, x double, speed_source string")


def test_a_package_is_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    manifest = packages.write_package(rows(spark), path)
    assert manifest["rows"] == 6 and [(s["records"], s["hz"]) for s in manifest["streams"]] == [(5, 2.0), (1, None)] and not any(manifest["privacy"].values())
    assert sorted(map(str, packages.read_package(spark, path).select(*rows(spark).columns).collect())) == sorted(map(str, rows(spark).collect()))


def test_forbidden_columns_and_changed_files_are_refused(spark, tmp_path):
    with pytest.raises(packages.PackageError, match="nickname"):
        packages.write_package(rows(spark).withColumn("nickname", F.lit("n")), f"file://{tmp_path}/q")
    assert not (tmp_path / "q").exists()
    path = f"file://{tmp_path}/p"
    packages.write_package(rows(spark), path)
    data = next(p for p in (tmp_path / "p" / "data").rglob("part-*") if p.suffix == ".csv")
    before = data.read_bytes()
    for changed in (before + b"0,1,2,x\n", before.replace(b"0", b"1", 1)):
        data.write_bytes(changed)
        for crc in data.parent.glob(".*.crc"):
            crc.unlink()
        with pytest.raises(packages.PackageError, match="differ"):
            packages.read_package(spark, path)
    data.write_bytes(before)
    assert packages.read_package(spark, path).count() == 6
    (data.parent / "part-more.csv").write_bytes(before)
    with pytest.raises(packages.PackageError, match="part-more"):
        packages.read_package(spark, path)
    (data.parent / "part-more.csv").unlink()
    held = tmp_path / "p" / "manifest.json"
    private = json.loads(held.read_text())
    private["privacy"]["chat_exported"] = True
    for crc in held.parent.glob(".*.crc"):
        crc.unlink()
    held.write_text(json.dumps(private))
    with pytest.raises(packages.PackageError, match="private"):
        packages.read_package(spark, path)
    held.unlink()
    with pytest.raises(packages.PackageError, match="not finished"):
        packages.read_package(spark, path)


def test_a_broken_rebuild_goes_on_where_it_stopped(spark, tmp_path):
    shas = [f"s{k}" for k in range(12)]
    sources = spark.createDataFrame([(s, k) for k, s in enumerate(shas)], "replay_sha string, size int")
    catalog, out = Catalog(spark, f"file://{tmp_path}/catalog"), f"file://{tmp_path}/out"
    catalog.add(sources)
    made = []

    def analyse(df, fail_after=None):
        made.append(df)
        if fail_after is not None and len(made) > fail_after:
            raise RuntimeError("the run was killed")
        return df.select("replay_sha", F.lit(len(made)).alias("turn"))

    run = lambda f, **k: {r.bucket: r.status for r in rebuild(spark, catalog, sources, f, out, "v1", buckets=4, **k).collect()}
    with pytest.raises(RuntimeError):
        run(lambda df: analyse(df, 2))
    first = {r.replay_sha: r.turn for r in spark.read.parquet(f"{out}/data").collect()}
    assert 0 < len(first) < 12
    got = run(analyse)
    assert sorted(got.values()).count("kept") == 2 and len(made) == 2 + 1 + len(got) - 2
    after = {r.replay_sha: r.turn for r in spark.read.parquet(f"{out}/data").collect()}
    assert set(after) == set(shas) and all(after[s] == first[s] for s in first)
    assert set(run(analyse).values()) == {"kept"}
    gone = [r.replay_sha for r in spark.read.parquet(f"{out}/data").where("bucket = 1").collect()]
    catalog.change(gone, visible=False)
    assert run(analyse)[1] == "emptied" and not set(gone) & {r.replay_sha for r in spark.read.parquet(f"{out}/data").collect()}
    assert set(run(analyse, force=True).values()) == {"rebuilt"}


def test_texts_in_all_encodings_at_once(spark):
    names = ["赛道", "road", "oad", "é", "", " "]
    payloads = {1: "x赛道y".encode("gbk"), 2: "赛道".encode(), 3: "a road".encode("utf-16-le"), 4: b"a road", 5: None, 6: b"", 7: "赛".encode()}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in payloads.items()], "id int, payload binary")
    got = {(r.id, r.name): r.encodings for r in maps.search_texts(df, "id", "payload", names).collect()}
    want = {}
    for k, v in payloads.items():
        for n in names[:4]:
            held = sorted(e for e in maps.ENCODINGS if v and n.encode(e) in v)
            if held:
                want[k, n] = held
    assert got == want and len(got) == 6
    assert {r.id for r in maps.contains_text(df, "payload", "赛道").collect()} == {1, 2}
    assert maps.search_texts(df, "id", "payload", []).count() == 0


def test_documents_by_line_and_by_race(spark, tmp_path):
    doc = spark.createDataFrame([("a", None), ("b", [1, 2])], "k string, v array<int>")
    tabular.write_documents(doc, f"file://{tmp_path}/d")
    assert {(r.k, tuple(r.v or ()), r.status) for r in tabular.read_documents(spark, f"file://{tmp_path}/d", "k string, v array<int>").collect()} == {("a", (), "ok"), ("b", (1, 2), "ok")}
    for n in ("race_1.json", "race_2.json", "other.json"):
        (tmp_path / n).write_text(json.dumps({"name": n}, indent=1))
    assert sorted(r.name for r in tabular.race_documents(spark, f"file://{tmp_path}", "name string").collect()) == ["race_1.json", "race_2.json"]


def test_one_lost_stream_is_refused_beside_whole_ones(spark, tmp_path):
    head = "replay_sha,stream,time_s,x,y,z,contact_state,lap_index,vx\n"
    (tmp_path / "t.csv").write_text(head + "r,0,0,0,0,0,5,1,3\nr,1,0,0,0,0,5,1,\nr,1,1,0,0,0,5,1,\n")
    with pytest.raises(ValueError, match="r/1: vx"):
        tabular.physical_telemetry(spark, f"{tmp_path}/t.csv", "2026")
    assert tabular.physical_telemetry(spark, f"{tmp_path}/t.csv").count() == 3


def test_scalars_and_scans_left(spark):
    a = 0.7
    r = spark.range(1).select(scalar.quaternion_yaw(F.lit(0.0), F.lit(0.0), F.lit(math.sin(a / 2)), F.lit(math.cos(a / 2))).alias("yaw"), scalar.to_canvas(F.lit(2.0), F.lit(3.0), 10, 1, 5, 100).alias("c"), scalar.to_canvas(F.lit(2.0), F.lit(3.0), 10, 1, 5).alias("d")).first()
    assert abs(r.yaw - a) < 1e-12 and tuple(r.c) == (21.0, 65.0) and tuple(r.d) == (21.0, 35.0)
    rec = spark.createDataFrame([("a",), ("b",)], "replay_sha string")
    bronze = spark.createDataFrame([("a", "v1"), ("b", "v0")], "replay_sha string, contract string")
    assert [x.replay_sha for x in native_tables.needs_scan(rec, bronze, "v1").collect()] == ["b"]
