"""Map resources: archive indexes, file lists, surfaces and documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the archive format: the hexadecimal digits' alphabet and the record marks.
DIGITS = b"QSPEDIKJHMNATOGC"
HEAD, TAIL = 0x68656164, 0x7461696C
_TO_HEX = bytes.maketrans(DIGITS, b"0123456789abcdef")
MAP_PATH = r"(?i)^Map\\Common Map\\Map(\d+)(?:\\(.*))?$"

_NODES = "archive string, address long, name string, original_size long, stored_size long, type long, data_offset long, parent long, full_path string"


def archive_nodes(data: bytes) -> list[dict]:
    """Records of an archive's index with their paths; a record without a sound parent has none."""
    if len(data) < 64 or data[:4] != b"vfs ":
        return []
    index = struct.unpack_from("<I", data, 0x18)[0]
    if index < 512 or index + 4 > len(data):
        return []
    nodes, p, address = {}, index + 4, index + 4
    for _ in range(struct.unpack_from("<I", data, index)[0]):
        coded, plain = struct.unpack_from("<II", data, p)
        if coded != 2 * plain or plain < 60 or coded > 2 << 20:
            return []
        raw = bytes.fromhex(data[p + 8 : p + 8 + coded].translate(_TO_HEX).decode("latin-1"))
        size = struct.unpack_from("<I", raw, 4)[0]
        if struct.unpack_from("<I", raw)[0] != HEAD or struct.unpack_from("<I", raw, plain - 4)[0] != TAIL or size + 60 != plain:
            return []
        name = "".join(chr(c) if 32 <= c < 127 else "?" for c in raw[8 : 8 + size])
        original, stored, kind, offset, parent = struct.unpack_from("<5I", raw, 8 + size)
        nodes[address] = {"address": address, "name": name, "original_size": original, "stored_size": stored, "type": kind, "data_offset": offset, "parent": parent}
        p, address = p + 8 + coded, address + plain
    for node in nodes.values():
        parts, at, seen = [], node, set()
        while at and at["address"] not in seen:
            seen.add(at["address"])
            parts.append(at["name"])
            if at["parent"] == 0:
                break
            at = nodes.get(at["parent"])
        else:
            parts = []
        node["full_path"] = "\\".join(reversed(parts)) or None
    return list(nodes.values())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index records of all archives of a folder; one bad archive doesn't hinder the others."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = archive_nodes(content)
                except (struct.error, ValueError):
                    found = []
                if found:
                    yield pa.RecordBatch.from_pylist([{"archive": name.rsplit("/", 1)[-1]} | n for n in found])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vfs").load(path)
    return files.select("path", "content").mapInArrow(scan, _NODES)


def map_nodes(nodes: DataFrame) -> DataFrame:
    """Records of map folders with their map's number and the rest of the path."""
    found = nodes.where(F.col("full_path").rlike(MAP_PATH))
    return found.withColumns({"map_id": F.regexp_extract("full_path", MAP_PATH, 1).cast("int"), "relative_path": F.regexp_extract("full_path", MAP_PATH, 2)})


def extract(data: bytes, node: dict) -> bytes | None:
    """A record's payload: linked blocks, stored, deflated as one or block by block; else None."""
    if node["type"] != 1 or not node["stored_size"] or not node["data_offset"]:
        return None
    index, left, at, seen, blocks = struct.unpack_from("<I", data, 0x18)[0], node["stored_size"], node["data_offset"], set(), []
    while left > 0:
        if at <= 0 or at + 16 > index or at in seen:
            return None
        seen.add(at)
        mark, _, link, size = struct.unpack_from("<IIII", data, at)
        if mark != HEAD or not 0 < size <= left or at + 16 + size > index:
            return None
        blocks.append(data[at + 16 : at + 16 + size])
        left -= size
        if left and not link:
            return None
        at = link
    for attempt in (lambda: b"".join(blocks), lambda: zlib.decompress(b"".join(blocks)), lambda: b"".join(map(zlib.decompress, blocks))):
        try:
            got = attempt()
        except zlib.error:
            continue
        if len(got) == node["original_size"]:
            return got
    return None


def read_file_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines of package file lists that belong to map folders; lines of under 7 fields are left out."""
    f = F.split("value", "\\|")
    rows = spark.read.text(path, pathGlobFilter="FileList.dat", recursiveFileLookup=True).where(F.size(f) >= 7)
    rows = rows.select(f[0].alias("full_path"), F.upper(f[3]).alias("file_md5"), F.upper(f[4]).alias("package_md5"), f[6].alias("package_path"))
    rows = rows.where(F.col("full_path").rlike(MAP_PATH))
    return rows.withColumns({"map_id": F.regexp_extract("full_path", MAP_PATH, 1).cast("int"), "relative_path": F.regexp_extract("full_path", MAP_PATH, 2)})


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """Triangles ``(path, tri_id, ax .. cy)`` of SVG surfaces; polygons of other sizes are left out."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    points = F.regexp_extract_all("value", F.lit(r"(?s)<polygon[^>]*\bpoints\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    rows = files.select("path", F.posexplode(points).alias("tri_id", "p"))
    xy = F.transform(F.split(F.trim(F.regexp_replace("p", r"\s+", " ")), "[ ,]"), lambda v: v.try_cast("double"))
    pairs = F.size(F.split(F.trim(F.regexp_replace("p", r"\s+", " ")), " "))
    rows = rows.withColumns({"xy": xy, "pairs": pairs}).where("pairs = 3 and size(xy) = 6 and not exists(xy, v -> v is null)")
    return rows.select("path", "tri_id", *[F.col("xy")[k].alias(c) for k, c in enumerate(("ax", "ay", "bx", "by", "cx", "cy"))])


def union_index(**tables: DataFrame) -> DataFrame:
    """All map ids with a flag and a count for each table that knows them."""
    out = None
    for name, table in tables.items():
        n = table.groupBy("map_id").agg(F.count("*").alias(f"{name}_count"))
        out = n if out is None else out.join(n, "map_id", "full_outer")
    return out.withColumns({f"{name}_count": F.coalesce(f"{name}_count", F.lit(0)) for name in tables} | {f"has_{name}": F.coalesce(f"{name}_count", F.lit(0)) > 0 for name in tables})


def contains_text(nodes: DataFrame, payload: str, text: str) -> DataFrame:
    """Rows whose payload holds ``text`` in GBK, UTF-8 or UTF-16."""
    forms = [text.encode(e) for e in ("gbk", "utf-8", "utf-16-le")]
    hit = None
    for form in forms:
        one = F.expr(f"position(X'{form.hex()}', `{payload}`) > 0")
        hit = one if hit is None else hit | one
    return nodes.where(hit)


#: Encodings in which a name may stand in a payload.
ENCODINGS = ("gbk", "utf-8", "utf-16-le")


def search_texts(nodes: DataFrame, ident: str, payload: str, names: Sequence[str]) -> DataFrame:
    """``(ident, name, encodings)``: which of ``names`` the payload of each row holds, and in which encodings.

    All names in all encodings are one Aho-Corasick automaton, so a payload is read once however many
    there are. A name that an encoding can't write is looked for in the others; an encoding that gives the same bytes as
    another is told under both. Blank names and null payloads hold nothing. ``names`` are a query, held by each task.
    """
    forms: dict[bytes, list[tuple[str, str]]] = {}
    for name in dict.fromkeys(n for n in names if n and n.strip()):
        for encoding in ENCODINGS:
            try:
                forms.setdefault(name.encode(encoding), []).append((name, encoding))
            except UnicodeEncodeError:
                continue
    kind = dict(nodes.dtypes)[ident]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for form, told in forms.items():
            automaton.add_word(form.decode("latin-1"), told)
        automaton.make_automaton()
        for batch in batches:
            source, found, encodings = [], [], []
            for i, content in enumerate(batch.column("payload")):
                held: dict[str, set[str]] = {}
                for _, told in automaton.iter((content.as_py() or b"").decode("latin-1")) if forms else ():
                    for name, encoding in told:
                        held.setdefault(name, set()).add(encoding)
                for name in sorted(held):
                    source.append(i)
                    found.append(name)
                    encodings.append(sorted(held[name]))
            ids = batch.column("ident").take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string()), pa.array(encodings, pa.list_(pa.string()))], names=[ident, "name", "encodings"])

    rows = nodes.select(F.col(ident).alias("ident"), F.col(payload).cast("binary").alias("payload"))
    return rows.mapInArrow(search, f"`{ident}` {kind}, name string, encodings array<string>")
