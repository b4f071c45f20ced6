"""Token ids, packing and token files against the tokenizers library itself and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import packing, tokenfile
from tracewright.llm.common import documents
from tracewright.llm.tokens import default_vocabulary, encoder

import public_tokenizers
from tokenizers import Tokenizer

ENCODER = encoder(default_vocabulary())
LIBRARY = Tokenizer.from_file(default_vocabulary())  # never the encoder's own object


def plain(text, tokenizer=LIBRARY):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


PARTS = ["a", "Z", "word", "é", "ß", " ", "  ", "\n", "\t", "'s", "'re", "'", "12", "²", "!", "...", "\xa0", "\x85", "\x1c", "\x00", "ª", "×", "…", "　", "中", "😀", "<|endoftext|>", "\r\n", "​", "\xad"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=40))
def test_chunks_give_the_library_s_ids(text):
    assert ENCODER.encode(text) == plain(text)


def test_strings_of_special_tokens():
    text = "a <|endoftext|> b<|endoftext|>"
    assert ENCODER.encode(text) == plain(text) == np.array([64, 220, 50256, 275, 50256], "<u4").tobytes()
    library = Tokenizer.from_file(default_vocabulary())
    library.encode_special_tokens = True
    assert encoder(default_vocabulary(), True).encode(text) == plain(text, library) != plain(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*PARTS, "<|startoftext|>"]), max_size=25).map("".join))
def test_a_vocabulary_of_another_make(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(path).encode(text) == plain(text, Tokenizer.from_file(path))


def test_more_symbols_than_codes_of_16_bits():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 1000, 70_000)
    lengths = tokenfile.code_lengths(counts)
    assert lengths.max() > 16 and (0.5 ** lengths.astype(float)).sum() <= 1
    ids, sizes = rng.integers(0, 70_000, 5000), np.array([1, 700, 0 + 4299])
    data, doc_bytes, checks, n = tokenfile.encode_ids(ids, sizes, lengths, tokenfile.canonical_codes(lengths))
    assert (tokenfile.decode_ids(data, doc_bytes, sizes, checks, n, tokenfile.decoding_table(lengths)) == ids).all()


def test_documents_give_the_library_s_ids(spark, sf):
    for r in documents(spark, sf).select("text").collect():
        assert ENCODER.encode(r.text) == plain(r.text)


def test_packing_is_whole_gapless_and_tight(spark, sf):
    docs = documents(spark, sf)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = plain(r.text) + b"\0\0\0\0"
        n, first = len(ids) // 4, (len(ids) // 4) % 2048 or 2048
        edges = [0, *range(first, n, 2048), n]
        want |= {(r.doc_id, k): (a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))}
    got = packing.pack_documents(docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * sum(r.length for r in got) / 2048 + 2


def test_shards_are_packed_together_in_the_end(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([100, 300, 500, 900, 1100, 1500, 2048])) for i in range(2000)]
    df = spark.createDataFrame(rows, "_row long, length long")
    got = packing.pack_pieces(df, shard_pieces=250).toPandas()
    assert len(got) == 2000 and got.groupby("sequence_id").length.sum().max() <= 2048
    one = packing.pack_pieces(df, shard_pieces=10_000).toPandas()
    assert got.sequence_id.nunique() <= 1.01 * one.sequence_id.nunique() + 2


def test_sum_of_squares_takes_the_smallest_sum():
    sizes = np.array([5, 5, 4, 3, 3, 2, 2, 1])
    bins, offsets, fill = packing.sum_of_squares(sizes, 10)
    gaps = {}
    for i in np.argsort(-sizes, kind="stable"):
        counts = lambda g: sum(len([1 for x in g.values() if x == v]) ** 2 for v in set(g.values()) if v)
        options = {b: counts(gaps | {b: gaps[b] - sizes[i]}) for b in gaps if gaps[b] >= sizes[i]}
        if options:
            assert options[bins[i]] == min(options.values())
        else:
            assert bins[i] not in gaps
        gaps[bins[i]] = gaps.get(bins[i], 10) - sizes[i]
    assert fill.tolist() == [int(sizes[bins == b].sum()) for b in bins]


def test_odd_documents_are_packed_and_filed(spark, odd_documents, no_documents):
    pieces = packing.pack_documents(odd_documents).collect()
    assert sum(r.piece == 0 for r in pieces) == 12
    for name in (None, ""):
        n = [r.length for r in pieces if r.doc_id == (1 if name is None else 2)]
        assert n == [1]
    assert packing.pack_documents(no_documents).count() == 0
    got = tokenfile.token_file_digests(odd_documents).collect()
    assert len(got) == 12
    ordered = sorted(got, key=lambda r: r.start)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in ordered]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert tokenfile.token_file_digests(no_documents).count() == 0


def test_token_file_round_trip(spark, sf, tmp_path):
    docs, path = documents(spark, sf), f"file://{tmp_path}/file"
    tokenfile.write_token_file(docs, path)
    got = {r.doc_id: r for r in tokenfile.read_token_file(spark, path).collect()}
    start = 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        ids = plain(r.text) + b"\2\0\0\0"
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32, bytes(g.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_ids_that_fill_whole_parts_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "PART_IDS", 200)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    rows = [(7, f"word {i} " * 5) for i in range(60)] + [(i, f"other {i} " * 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tokenfile.token_file_digests(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


@pytest.mark.parametrize("symbols, n", [(1, 50), (2, 9), (40, 3000), (50257, 60000)])
def test_coding_round_trip(symbols, n):
    rng = np.random.default_rng(symbols)
    ids = np.minimum((rng.pareto(0.5, n) * 2).astype(np.int64), symbols - 1)
    cut = np.sort(rng.choice(np.arange(1, n), min(20, n - 1), replace=False))
    sizes = np.diff(np.concatenate(([0], cut, [n])))
    lengths = tokenfile.code_lengths(np.bincount(ids, minlength=symbols))
    data, size, checks, per = tokenfile.encode_ids(ids, sizes, lengths, tokenfile.canonical_codes(lengths))
    back = tokenfile.decode_ids(data, size, sizes, checks, per, tokenfile.decoding_table(lengths))
    assert (back == ids).all() and lengths.max() <= 16 and per.tolist() == ((sizes - 1) // tokenfile.CHECK).tolist()


def test_code_lengths_are_optimal_under_their_limit():
    import heapq
    import itertools

    rng = random.Random(2)
    for _ in range(30):
        counts = [rng.randint(1, 60) for _ in range(rng.randint(2, 7))]
        for limit in (3, 4, 8):
            got = tokenfile.code_lengths(np.array(counts), limit)
            assert sum(2.0 ** -int(x) for x in got) <= 1 and got.max() <= limit
            best = min(
                (sum(c * x for c, x in zip(counts, ls)) for ls in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-x for x in ls) <= 1)
                if len(counts) <= 5 and limit <= 4
                else [sum(c * int(x) for c, x in zip(counts, got))]
            )
            assert sum(c * int(x) for c, x in zip(counts, got)) == best
        heap = sorted(counts)
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        assert sum(c * int(x) for c, x in zip(counts, tokenfile.code_lengths(np.array(counts), 16))) == total
