"""Media columns: signature sniffing, format checks, corrected types and carved media.

An automaton locates magic bytes anywhere in a blob; a check for the format then follows its
structure from there and gives its length, or rejects it. What stands at offset 0 decides the
blob's type; what stands elsewhere is embedded and can be carved out by offset and length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, slices

UNKNOWN = "application/octet-stream"


def _png(b: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or (p == at + 8 and name != b"IHDR"):
            return None
        if zlib.crc32(b[p + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return end - at
        p = end
    return None


def _gif(b: bytes, at: int) -> int | None:
    def sub_blocks(p: int) -> int | None:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1 if p < len(b) else None

    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = sub_blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = sub_blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        mark, size = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2:
            return None
        frame |= 0xC0 <= mark <= 0xC3
        p += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that isn't stuffing or a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return None
        if b[p : p + 2] == b"\xff\xd9":
            return p + 2 - at if frame else None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, _, data, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    rows = (abs(width) * depth + 31) // 32 * 4 * abs(height)
    good = planes == 1 and depth in (1, 4, 8, 16, 24, 32) and header in (40, 108, 124) and data >= 14 + header
    return size if good and size >= data + rows and at + size <= len(b) else None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    p = at + 12
    while p + 8 <= end <= len(b):
        p += 8 + int.from_bytes(b[p + 4 : p + 8], "little")
        p += p - at & 1
        if p >= end:
            return end - at if p <= end + 1 else None
    return None


def _gzip(b: bytes, at: int) -> int | None:
    reader, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not reader.eof:
            reader.decompress(b[p : p + 65536])
            p = min(p + 65536, len(b))
    except zlib.error:
        return None
    return p - len(reader.unused_data) - at if reader.eof else None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before the next header: files saved several times have one for each save."""
    limit = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, limit if limit > 0 else len(b))
    return end + 5 - at if end > 0 and b"startxref" in b[max(at, end - 64) : end] else None


#: Magic bytes, type, check. RIFF types are told apart by their form type.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
)
_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(SIGNATURES):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(blob: bytes | None, automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all valid media, by offset; those within another one are left out.

    A container's own chunks may hold media too: a RIFF file's contents are looked into.
    """
    out, until = [], 0
    for end, k in automaton.iter((blob or b"").decode("latin-1")):
        magic, kind, check = SIGNATURES[k]
        at = end + 1 - len(magic)
        if at < until:
            continue
        kind = _FORMS.get(blob[at + 8 : at + 12]) if magic == b"RIFF" else kind
        if kind and (size := check(blob, at)) is not None:
            out.append((kind, at, size))
            until = at + (12 if magic == b"RIFF" else size)
    return out


_FOUND = "struct<type:string,offset:bigint,length:bigint>"


def sniff_media(blobs: DataFrame, blob: str = "blob", declared: str = "declared_type", out: str = "media") -> DataFrame:
    """``blobs`` with a struct: ``type`` (what is there, else the generic one), ``corrected``,
    ``complete`` (the medium spans the whole blob) and ``found`` (all media with offset, length).

    Null and empty blobs are of the generic type and hold nothing. A null declared type is
    corrected wherever something is found.
    """
    schema = f"struct<type:string,complete:boolean,found:array<{_FOUND}>>"

    @F.arrow_udf(schema)
    def look(column: pa.Array) -> pa.Array:
        automaton, rows = _automaton(), []
        for value in column:
            b = value.as_py()
            found = sniff(b, automaton)
            first = found[0] if found and found[0][1] == 0 else None
            rows.append(
                {
                    "type": first[0] if first else UNKNOWN,
                    "complete": bool(first and first[2] == len(b)),
                    "found": [dict(zip(("type", "offset", "length"), f)) for f in found],
                }
            )
        kind = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        return pa.array(rows, pa.struct([("type", pa.string()), ("complete", pa.bool_()), ("found", pa.list_(kind))]))

    seen = blobs.withColumn(out, look(F.col(blob)))
    corrected = ~F.col(f"{out}.type").eqNullSafe(F.col(declared)) & (F.col(f"{out}.type") != UNKNOWN)
    return seen.withColumn(out, F.col(out).withField("corrected", corrected))


def carve(sniffed: DataFrame, blob: str = "blob", media: str = "media") -> DataFrame:
    """One row for each embedded medium: all columns, ``part_type``, ``part_offset`` and ``part``."""
    one = sniffed.withColumn("_part", F.explode(F.filter(f"{media}.found", lambda x: x["offset"] > 0)))
    part = F.expr(f"substring(`{blob}`, cast(_part.offset + 1 as int), cast(_part.length as int))")
    return one.withColumns({"part_type": F.col("_part.type"), "part_offset": F.col("_part.offset"), "part": part}).drop("_part")


_WAV_HEADER = 44


def wav_blob(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of 8-bit samples, byte by byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(blob: bytes) -> bytes:
    """The samples of a RIFF/WAVE blob, found by walking its chunks."""
    p = 12
    while p + 8 <= len(blob):
        name, size = struct.unpack_from("<4sI", blob, p)
        if name == b"data":
            return blob[p + 8 : p + 8 + size]
        p += 8 + size + (size & 1)
    raise ValueError("no samples")


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


def store_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write every whole text as a WAVE blob with the generic declared type, at ``path``."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t.as_py() or b"" for t in batch.column("raw")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav_blob(padded(r)) for r in raw], pa.binary())],
                names=["doc_id", "n_bytes", "blob"],
            )

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    stored = rows.mapInArrow(store, f"doc_id {kind}, n_bytes long, blob binary")
    stored.withColumn("declared_type", F.lit(UNKNOWN)).write.option("compression", "zstd").parquet(path)


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media, sniff what was stored and read the payload back from it.

    The payload is the text's UTF-8 (null: none) and zero bytes up to a positive multiple of 64.
    ``feature`` names the sniffed type, whether it spans the blob, the type's correction, the mean
    sample and the embedded media, so it depends on the text alone. Repeated rows each get a row.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "media")
    store_texts(docs, path, doc_id, text)
    seen = sniff_media(spark.read.parquet(path))

    @F.arrow_udf("struct<samples:binary,tail:bigint,mean:double>")
    def read(blobs: pa.Array, types: pa.Array) -> pa.Array:
        rows = []
        for blob, kind in zip(blobs, types):
            if kind.as_py() != "audio/wav":
                raise ValueError("a stored blob isn't what was written")
            samples = wav_samples(blob.as_py())
            rows.append({"samples": samples, "tail": zlib.crc32(samples[-64:]), "mean": float(np.frombuffer(samples, np.uint8).mean())})
        return pa.array(rows, pa.struct([("samples", pa.binary()), ("tail", pa.int64()), ("mean", pa.float64())]))

    back = seen.withColumn("_read", read(F.col("blob"), F.col("media.type")))
    inner = F.array_join(F.transform(F.filter("media.found", lambda x: x["offset"] > 0), lambda x: F.concat_ws("@", x["type"], x["offset"])), ",")
    feature = F.concat_ws(";", "media.type", F.col("media.complete").cast("string"), F.col("media.corrected").cast("string"), F.format_string("%.3f", "_read.mean"), inner)
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("_read.samples").cast("long").alias("payload_bytes"),
        F.sha2("_read.samples", 256).alias("payload_sha256"),
        F.col("_read.tail").alias("tail_crc32"),
        F.length("blob").cast("long").alias("media_bytes"),
        F.sha2("blob", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
