"""Media signatures, checks, carving and the exact round trip of texts."""

import gzip
import hashlib
import struct
import zlib

from tracewright.llm import media
from tracewright.llm.common import documents

AUTO = media._automaton()


def png(w=2, h=2):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + b"\xff\xc0\x00\x0b\x08\0\x01\0\x01\x01\x01\x11\0" + b"\xff\xda\x00\x08\x01\x01\0\0\x3f\0" + b"\x12\xff\x00\x34" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
GZ = gzip.compress(b"some text" * 20)
WAV = media.wav_blob(b"\1\2" * 32)
ALL = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/gzip": GZ, "audio/wav": WAV}


def test_each_format_alone_broken_and_embedded():
    for kind, blob in ALL.items():
        assert media.sniff(blob, AUTO) == [(kind, 0, len(blob))]
        assert media.sniff(b"text before " + blob + b" and after", AUTO) == [(kind, 12, len(blob))]
        assert media.sniff(blob[:-1], AUTO) == [], kind
    assert media.sniff(png()[:20] + b"\7" + png()[21:], AUTO) == []
    assert media.sniff(None, AUTO) == media.sniff(b"", AUTO) == media.sniff(b"BM GIF89a RIFF %PDF-", AUTO) == []


def test_media_in_a_container_are_found_too():
    blob = media.wav_blob(b"x" * 10 + png() + b"y" * 5 + GIF)
    kinds = media.sniff(blob, AUTO)
    assert kinds[0] == ("audio/wav", 0, len(blob)) and kinds[1][:2] == ("image/png", 54) and kinds[2][0] == "image/gif"


def test_types_are_corrected_and_media_carved(spark):
    rows = [(1, "image/png", bytearray(GIF)), (2, None, bytearray(b"doc " + png() + b" " + JPEG)), (3, "text/plain", bytearray(b"nothing")), (4, "x", None), (5, "image/gif", bytearray(GIF)), (6, None, bytearray(b""))]
    df = spark.createDataFrame(rows, "k int, declared_type string, blob binary")
    seen = media.sniff_media(df)
    got = {r.k: r.media for r in seen.collect()}
    assert (got[1].type, got[1].corrected, got[1].complete) == ("image/gif", True, True)
    assert (got[5].corrected, got[3].type, got[3].corrected, got[4].type, got[6].type) == (False, media.UNKNOWN, False, media.UNKNOWN, media.UNKNOWN)
    parts = {(r.k, r.part_type): bytes(r.part) for r in media.carve(seen).collect()}
    assert parts == {(2, "image/png"): png(), (2, "image/jpeg"): JPEG}


def test_round_trip_of_documents(spark, sf, odd_documents, no_documents):
    for docs in (documents(spark, sf), odd_documents):
        want = sorted(((r.doc_id or -1), (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
        got = media.media_digests(docs).collect()
        digests = []
        for i, raw in want:
            p = raw + bytes(-len(raw) % 64 if raw else 64)
            w = media.wav_blob(p)
            digests.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(w), hashlib.sha256(w).hexdigest()))
        assert sorted((r.doc_id or -1, *r[1:7]) for r in got) == sorted(digests)
        features = {}
        for r in got:
            assert features.setdefault(r.payload_sha256, r.feature) == r.feature
            assert r.feature.startswith("audio/wav;true;true;")
    assert media.media_digests(no_documents).count() == 0


def test_documents_saved_several_times():
    one = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    saved = one + b"\nmore\nstartxref\n20\n%%EOF"
    assert media._pdf(b"ab" + saved + b"tail" + one, 2) == len(saved) and media._pdf(b"%PDF-1.4 no end %PDF-", 0) is None
