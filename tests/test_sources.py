"""Decoders on recordings made in memory."""

import struct

from tracewright.sources import maps, native_tables, recordings, synthetic, tabular


def made(spark, *contents):
    return spark.createDataFrame([(f"r{k}", bytearray(c)) for k, c in enumerate(contents)], "replay_sha string, content binary")


def test_vehicle_stream_round_trip(spark):
    r = made(spark, synthetic.vehicle_records() + b"\0" * 512)
    found = recordings.streams(recordings.stream_candidates(r))
    assert [(s.profile, s.records) for s in found.collect()] == [("2026", 240)]
    rows = {x.i: x for x in recordings.telemetry(recordings.decode(r, found)).collect()}
    assert len(rows) == 240 and rows[150].lap_index == 2 and rows[150].contact_state == 5 and rows[150].is_airborne is False
    assert rows[10].speed_source == "replay_linear_velocity" and abs(rows[10].speed - 11.765) < 1e-5
    assert rows[3].input_60 == 1 and rows[10].input_60 == 0


def test_frozen_and_still_lanes_are_rejected(spark):
    frozen = synthetic.vehicle_records(step_ms=0)
    still = synthetic.vehicle_records(scale=0.0)
    assert recordings.stream_candidates(made(spark, frozen, still, b"", b"\0" * 100)).count() == 0


def test_two_vehicles_are_two_streams(spark):
    data = synthetic.vehicle_records() + b"\xff" * 512 + synthetic.vehicle_records(120, 50, 30, 0.5, 40.0)
    got = recordings.streams(recordings.stream_candidates(made(spark, data))).orderBy("stream").collect()
    assert [s.records for s in got] == [240, 120]


def test_drift_and_effect_tables(spark):
    data = synthetic.recording([b"\xff" * 40000], [(5000, 5400), (5500, 5450), (9000, 9700)], [(5850, 1, 2001.0), (6200, 0, 2001.0)], [1000], [24])
    tables = native_tables.drift_tables(made(spark, data))
    got = [(r.start_t, r.end_t) for r in native_tables.drift_intervals(tables).orderBy("ordinal").collect()]
    assert got == [(5000, 5400), (5450, 5500), (9000, 9700)]
    e = native_tables.effect_intervals(tables).collect()
    assert [(r.code, r.start_t, r.end_t) for r in e] == [(2001.0, 5850, 6200)]


def test_backward_and_unclosed_tables_are_refused():
    assert native_tables.read_toggles(synthetic.toggle_table([(9000, 9400), (5000, 5400)], False), 0) is None
    assert native_tables.read_toggles(synthetic.toggle_table([], False), 0, empty=True).shape == (0, 2)
    assert native_tables.read_effects(synthetic.effect_table([(1, 1, 1.0)]), 0)[0] == "unclosed_effect_start"
    assert native_tables.read_effects(synthetic.effect_table([(1, 0, 1.0)]), 0)[0] == "effect_end_without_start"
    assert native_tables.read_effects(synthetic.effect_table([(5, 1, 1.0), (4, 0, 1.0)]), 0)[0] == "invalid_or_nonmonotonic_time"


def test_action_table_by_trailer_and_by_structure(spark):
    times, codes = [1000, 2000, 3000, 4000, 4100], [8, 9, 19, 24, 25]
    fixed = b"\xff" * 500 + synthetic.action_table(times, codes)
    moved = b"\xff" * 500 + synthetic.action_table(times, codes, trailer=400)
    got = native_tables.action_events(made(spark, fixed, moved, b"\0" * 10)).orderBy("replay_sha", "record_index").collect()
    assert [(r.time_ms, r.action_code) for r in got if r.replay_sha == "r0"] == list(zip(times, codes))
    assert {r.status for r in got if r.replay_sha == "r1"} == {"structural"}
    assert [r.status for r in got if r.replay_sha == "r2"] == ["file_smaller_than_container_trailer"]


def archive(files):
    """An archive with one folder and stored files below it."""
    import zlib

    digits = str.maketrans("0123456789abcdef", maps.DIGITS.decode())
    blocks, head = bytearray(b"\0" * 1024), []
    for name, data, packed in files:
        body = zlib.compress(data) if packed else data
        head.append((name, len(data), len(body), 1, len(blocks)))
        blocks += struct.pack("<IIII", maps.HEAD, 0, 0, len(body)) + body
    index = len(blocks)
    out, address = struct.pack("<I", 1 + len(head)), index + 4
    first = address
    for k, (name, original, stored, kind, at) in enumerate([("Map\\Common Map\\Map07", 0, 0, 2, 0), *head]):
        raw = name.encode()
        rec = struct.pack("<II", maps.HEAD, len(raw)) + raw + struct.pack("<5I", original, stored, kind, at, 0 if k == 0 else first)
        rec += b"\0" * (len(raw) + 60 - len(rec) - 4) + struct.pack("<I", maps.TAIL)
        coded = rec.hex().translate(digits).encode()
        out += struct.pack("<II", len(coded), len(rec)) + coded
    blocks[0:4] = b"vfs "
    blocks[0x18:0x1C] = struct.pack("<I", index)
    return bytes(blocks) + out


def test_archive_index_and_payload(spark, tmp_path):
    data = archive([("a.luc", b"hello" * 50, True), ("b.luc", b"plain", False)])
    (tmp_path / "data1.vfs").write_bytes(data)
    (tmp_path / "data2.vfs").write_bytes(b"not an archive")
    nodes = maps.read_archives(spark, str(tmp_path))
    got = {r.name: r.asDict() for r in maps.map_nodes(nodes).collect()}
    assert got["a.luc"]["full_path"] == "Map\\Common Map\\Map07\\a.luc" and got["a.luc"]["map_id"] == 7 and got["a.luc"]["relative_path"] == "a.luc"
    assert maps.extract(data, got["a.luc"]) == b"hello" * 50 and maps.extract(data, got["b.luc"]) == b"plain"


def test_file_lists_and_surfaces(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "FileList.dat").write_text("map\\common map\\MAP08\\a.nif|1|2|ab|cd|5|pkg\nshort|line\nother\\path|1|2|3|4|5|6\n")
    r = maps.read_file_lists(spark, str(tmp_path)).collect()
    assert [(x.map_id, x.relative_path, x.file_md5, x.package_path) for x in r] == [(8, "a.nif", "AB", "pkg")]
    (tmp_path / "s.svg").write_text('<svg><polygon points="0,0 1,0\n 0,1"/><polygon points="0,0 1,1"/><polygon points="0,0 x,1 2,2"/></svg>')
    assert [tuple(x)[2:] for x in maps.read_surfaces(spark, str(tmp_path / "s.svg")).collect()] == [(0.0, 0.0, 1.0, 0.0, 0.0, 1.0)]


def test_csv_keeps_absent_apart_from_zero(spark, tmp_path):
    import pytest

    p = tmp_path / "t.csv"
    p.write_text("﻿time_s,x,y,z,speed,distance,lap_index,pose_valid,pose_break_before\n0.0,1,2,3,,,1,True,0\n0.1,,2,3,4,5,,false,1\n")
    rows = tabular.driving_rows(spark, str(p)).orderBy("time_s").collect()
    assert (rows[0].speed, rows[0].pose_valid, rows[1].x, rows[1].lap_index) == (0.0, True, None, None)
    assert tabular.physical_telemetry(spark, str(p)).count() == 1
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        tabular.driving_rows(spark, str(tmp_path / "bad.csv"))
