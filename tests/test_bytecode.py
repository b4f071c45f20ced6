"""Fields of compiled scripts assembled by hand."""

import struct

from test_sources import archive

from tracewright.sources import bytecode


def s50(t):
    raw = t.encode("gbk") + b"\0"
    return struct.pack("<I", len(raw)) + raw


def script_50(constants, code):
    k = b"".join(b"\x03" + struct.pack("<d", c) if isinstance(c, float) else b"\x04" + s50(c) for c in constants)
    body = s50("@x") + struct.pack("<i", 0) + b"\0\0\0\x10" + struct.pack("<I", 2) + b"\0" * 8 + struct.pack("<I", 1) + s50("v") + b"\0" * 8 + struct.pack("<I", 0)
    return bytecode.MAGIC + b"\x50" + bytecode.HEADER_50 + b"\0" * 8 + body + struct.pack("<I", len(constants)) + k + struct.pack("<II", 0, len(code)) + struct.pack(f"<{len(code)}I", *code)


def v54(n):
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.insert(0, n & 0x7F)
    return bytes(out)


def s54(t):
    raw = t.encode("gbk")
    return v54(len(raw) + 1) + raw


def function_54(constants, code, children=()):
    k = b"".join(b"\x03" + struct.pack("<q", c) if isinstance(c, int) else b"\x04" + s54(c) for c in constants)
    return (
        v54(0) + v54(0) + v54(0) + b"\0\0\x02" + v54(len(code)) + struct.pack(f"<{len(code)}I", *code) + v54(len(constants)) + k
        + v54(1) + b"\1\0\0" + v54(len(children)) + b"".join(children) + v54(2) + b"\0\0" + v54(0) + v54(0) + v54(1) + s54("_ENV")
    )


def script_54(main):
    return bytecode.MAGIC + b"\x54" + bytecode.HEADER_54 + b"\x01" + main


def set_field(b, c, k=1):
    return 18 | k << 15 | b << 16 | c << 24


def test_constant_and_global_assignments_of_the_old_format():
    table = script_50(["map_name", "测试地图"], [9 | (251 << 6) | (250 << 15)])
    assert bytecode.field(table, "map_name", True) == ("测试地图", "assigned")
    glob = script_50(["mapId", 137.0], [1 | 1 << 6 | 3 << 24, 0 | 3 << 15 | 5 << 24, 7 | 0 << 6 | 5 << 24])
    assert bytecode.field(glob, "mapId") == (137.0, "assigned") and bytecode.field(glob, "mapId", True)[0] is None


def test_fields_of_nested_functions_of_the_new_format():
    child = function_54(["mapId", 153], [set_field(0, 1)])
    main = function_54(["mapName", "海边 小镇"], [3 | 2 << 7 | 1 << 15, set_field(0, 2, 0)], [function_54(["x"], []), child])
    data = script_54(main)
    assert bytecode.field(data, "mapName", True) == ("海边 小镇", "assigned") and bytecode.field(data, "mapId") == (153, "assigned")
    assert bytecode.field(data, "other") == (None, "not assigned")
    assert bytecode.field(data[:-30], "other")[1] == "bytecode ends early" and bytecode.field(b"x" * 9, "a")[1] == "not bytecode"
    assert bytecode.field(bytecode.MAGIC + b"\x53....", "a")[1] == "unsupported version 0x53"
    assert [bytecode.game_id(v) for v in (5, 5.0, 0, -1, 2.0**40, "5", None, True)] == [5, 5, None, None, None, None, None, None]


def test_descriptors_of_archives(spark, tmp_path):
    lap = script_54(function_54(["mapName", "甲", "mapId", 137], [set_field(0, 1), set_field(2, 3)]))
    old = script_50(["map_name", "旧名"], [9 | (251 << 6) | (250 << 15)])
    (tmp_path / "data1.vfs").write_bytes(archive([("LapDistanceFile.luc", lap, True), ("map_desc.luc", old, False), ("x.luc", b"zz", False)]))
    d = bytecode.read_descriptors(spark, str(tmp_path))
    assert {(r.map_id, r.map_name, r.declared_game_map_id) for r in d.collect()} == {(7, "甲", 137), (7, "旧名", None)}
    one = bytecode.declared_identities(d).first()
    assert (one.primary_name, one.declared_game_map_id, sorted(one.all_names)) == ("甲", 137, sorted(["甲", "旧名"]))
