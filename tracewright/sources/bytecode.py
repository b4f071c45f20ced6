"""One field of a compiled script: a constant that the script assigns to a name.

Nothing is run. Instructions are read in order; registers follow moves and constant loads only.
Strings are in GBK. Formats 5.0 and 5.4 of the script language's public bytecode are known.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .maps import MAP_PATH, archive_nodes, extract

MAGIC = b"\x1bLua"
#: Fixed values of the headers after the version byte.
HEADER_50 = bytes((1, 4, 4, 4, 6, 8, 9, 9, 8))
HEADER_54 = bytes((0, 0x19, 0x93, 0x0D, 0x0A, 0x1A, 0x0A, 4, 8, 8)) + struct.pack("<qd", 0x5678, 370.5)


class _Bytes:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("bytecode ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def varint(self) -> int:
        x = 0
        for _ in range(10):
            b = self.number("B")
            x = x << 7 | b & 0x7F
            if b & 0x80:
                return x
        raise ValueError("number too long")

    def text(self, new: bool) -> str | None:
        n = self.varint() if new else self.number("I")
        if not n:
            return None
        raw = self.take(n - 1) if new else self.take(n).removesuffix(b"\0")
        return raw.decode("gbk")


def _usable(value, text_only: bool) -> bool:
    if isinstance(value, str):
        return bool(value.strip())
    return not text_only and isinstance(value, (int, float)) and not isinstance(value, bool)


def _constants(r: _Bytes, n: int, new: bool) -> list:
    fixed = {0x00: None, 0x01: False, 0x11: True} if new else {0: None}
    forms = {0x03: "q", 0x13: "d"} if new else {3: "d"}
    texts = (0x04, 0x14) if new else (4,)
    out = []
    for _ in range(n):
        kind = r.number("B")
        if kind in fixed:
            out.append(fixed[kind])
        elif kind in forms:
            out.append(r.number(forms[kind]))
        elif kind in texts:
            out.append(r.text(new))
        else:
            raise ValueError(f"constant type {kind}")
    return out


def _assigned_50(r: _Bytes) -> Iterator[tuple[object, object]]:
    """(name, value) of global and constant table assignments of a script without nested functions."""
    r.take(8)  # a number in the header
    r.text(False), r.take(4 + 4)
    r.take(4 * r.number("I"))
    for _ in range(r.number("I")):
        r.text(False), r.take(8)
    for _ in range(r.number("I")):
        r.text(False)
    known = _constants(r, r.number("I"), False)
    if r.number("I"):
        raise ValueError("nested functions")
    register: dict[int, object] = {}
    constant = lambda k: known[k] if 0 <= k < len(known) else None
    for _ in range(r.number("I")):
        word = r.number("I")
        op, c, b, a, wide = word & 63, word >> 6 & 511, word >> 15 & 511, word >> 24, word >> 6 & 0x3FFFF
        if op == 0:
            register[a] = register.get(b)
        elif op == 1:
            register[a] = constant(wide)
        elif op == 7:
            yield constant(wide), register.get(a)
        elif op == 9 and b >= 250 and c >= 250:
            yield constant(b - 250), constant(c - 250)


def _assigned_54(r: _Bytes, depth: int = 0) -> Iterator[tuple[object, object]]:
    """(name, value) of field assignments of a function, then of the functions in it."""
    if depth > 64:
        raise ValueError("functions nested too deep")
    r.text(True), r.varint(), r.varint(), r.take(3)
    code = [r.number("I") for _ in range(r.varint())]
    known = _constants(r, r.varint(), True)
    register: dict[int, object] = {}
    constant = lambda k: known[k] if 0 <= k < len(known) else None
    for word in code:
        op, a, k, b, c = word & 0x7F, word >> 7 & 0xFF, word >> 15 & 1, word >> 16 & 0xFF, word >> 24
        if op == 0:
            register[a] = register.get(b)
        elif op == 3:
            register[a] = constant(word >> 15)
        elif op in (15, 18):
            yield constant(b), constant(c) if k else register.get(c)
    r.take(3 * r.varint())
    for _ in range(r.varint()):
        yield from _assigned_54(r, depth + 1)
    r.take(r.varint())
    for _ in range(r.varint()):
        r.varint(), r.varint()
    for _ in range(r.varint()):
        r.text(True), r.varint(), r.varint()
    for _ in range(r.varint()):
        r.text(True)


def field(data: bytes | None, name: str, text_only: bool = False) -> tuple[str | int | float | None, str]:
    """(value, status): the first usable value assigned to ``name``."""
    if not data or data[:4] != MAGIC or len(data) < 5:
        return None, "not bytecode"
    found = {0x50: (HEADER_50, _assigned_50, 0), 0x54: (HEADER_54, _assigned_54, 1)}.get(data[4])
    if found is None:
        return None, f"unsupported version 0x{data[4]:02X}"
    header, assigned, more = found
    if data[5 : 5 + len(header)] != header:
        return None, "unexpected header"
    try:
        for key, value in assigned(_Bytes(data, 5 + len(header) + more)):
            if key == name and _usable(value, text_only):
                return value, "assigned"
    except (ValueError, struct.error) as e:
        return None, str(e)
    return None, "not assigned"


def game_id(value) -> int | None:
    """A whole number from 1 to 2^31 - 1, or None: anything else declares nothing."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    n = round(value)
    return n if 0 < n < 1 << 31 else None


_DESCRIPTORS = "archive string, map_id int, full_path string, md5 string, map_name string, declared_game_map_id long, status string"
_FILES = r"(?i)^Map\\Common Map\\Map(\d+)\\(map_desc|LapDistanceFile)\.luc$"


def read_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """Names and declared game ids from the descriptor files of all archives of a folder."""
    import hashlib
    import re

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("map_id", pa.int32()), ("full_path", pa.string()), ("md5", pa.string()), ("map_name", pa.string()), ("declared_game_map_id", pa.int64()), ("status", pa.string())])
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                try:
                    nodes = archive_nodes(data)
                except (struct.error, ValueError):
                    nodes = []
                for node in nodes:
                    hit = re.match(_FILES, node["full_path"] or "")
                    if not hit:
                        continue
                    payload = extract(data, node)
                    lap = hit[2].lower() == "lapdistancefile"
                    text, status = field(payload, "mapName" if lap else "map_name", True)
                    declared = game_id(field(payload, "mapId")[0]) if lap else None
                    rows.append({"archive": name.rsplit("/", 1)[-1], "map_id": int(hit[1]), "full_path": node["full_path"], "md5": hashlib.md5(payload).hexdigest() if payload else None,
                                 "map_name": text, "declared_game_map_id": declared, "status": status})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vfs").load(path)
    return files.select("path", "content").mapInArrow(scan, _DESCRIPTORS)


def declared_identities(descriptors: DataFrame) -> DataFrame:
    """One row a map: its preferred name (declared ones first) and declared game id, if only one."""
    lap = F.col("declared_game_map_id").isNotNull()
    g = descriptors.where(F.col("full_path").rlike(MAP_PATH)).groupBy("map_id")
    return g.agg(
        F.max_by(F.when(F.trim("map_name") != "", F.col("map_name")), F.struct(F.col("map_name").isNotNull(), lap, "archive")).alias("primary_name"),
        F.array_sort(F.collect_set("map_name")).alias("all_names"),
        F.when(F.countDistinct("declared_game_map_id") == 1, F.max("declared_game_map_id")).alias("declared_game_map_id"),
    )
