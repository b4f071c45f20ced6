"""Shards against an exhaustive search over cuts, on drawn sizes, hot groups and odd documents."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import sharding
from tracewright.llm.common import documents


def smallest(sizes, shards):
    """The least possible size of the largest of ``shards`` contiguous runs, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


class Sums:
    """Stands for the table of running sums: cells of a plain list, few at a time."""

    def __init__(self, sizes):
        self.ends, at = [], 0
        for s in sizes:
            at += s
            self.ends.append(at)


def looked_into(sums, spans):
    cells = {}
    for above, upto, n in spans:
        width = -(-(upto - above) // min(n, 3))  # few cells, so that many looks are needed
        for e in sums.ends:
            if above < e <= upto:
                cells.setdefault((above, (e - above - 1) // width), []).append(e)
    return [(min(c), max(c), len(c)) for c in cells.values()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30) | st.integers(1, 1000), min_size=1, max_size=40), st.integers(1, 9))
def test_capacity_is_the_least_and_cuts_keep_it(sizes, shards):
    sums, total, before = Sums(sizes), sum(sizes), sharding._looked_into
    sharding._looked_into = looked_into
    try:
        giants = [(e, s) for e, s in zip(sums.ends, sizes) if s * shards > total]
        capacity, cuts = sharding.minimax_cuts(sums, shards, total, giants)
    finally:
        sharding._looked_into = before
    assert capacity == smallest(sizes, shards)
    edges = [0, *cuts, total]
    assert edges == sorted(edges) and set(edges[1:]) <= set(sums.ends)
    assert max(b - a for a, b in zip(edges[:-1], edges[1:])) == capacity


def held(rows, docs, shards):
    """The result's rows agree with a plain reading of ``docs`` (doc_id, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=lambda r: (key(r), r[1:]))
    assert got == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs), key=lambda r: (key(r), r[1:]))
    first, sizes = {}, {}
    for i, t in docs:
        t = t or ""
        first[t] = min([x for x in (first.get(t), i) if x is not None], default=None)
        sizes[t] = sizes.get(t, 0) + len(t.encode()) + 1
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for k, own in by.items():
        assert 0 <= k < shards and sorted(r["slot"] for r in own) == list(range(len(own)))
    distinct = sorted({s: None for s in first.values()}, key=lambda x: (x is not None, x or 0))
    if len(distinct) == len(first):  # else groups of one id stand in the order of their hashes
        least = smallest([sizes[t] for t in sorted(first, key=lambda t: key((first[t],)))], shards)
        assert {r["capacity"] for r in rows} == {least} == {max(sum(r["size"] for r in own) for own in by.values())}
    of = {}
    for r in rows:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    return by


@pytest.mark.parametrize("shards", [1, 8])
def test_documents(spark, sf, shards):
    docs = documents(spark, sf)
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    by = held(sharding.shard_documents(docs, shards).collect(), plain, shards)
    assert len(by) == shards


def test_a_text_of_a_third_of_all_rows(spark):
    rows = [(i, "x" * 40 if i % 3 == 0 else f"text {i}") for i in range(3000)]
    by = held(sharding.shard_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect(), rows, 8)
    assert len(by) == 8  # the shard of the hot text sets the capacity; the others share the rest


def test_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.withColumnRenamed("n", "slot")
    out = sharding.shard_documents(docs, 3)
    assert out.columns == [c for c in docs.columns if c != "slot"] + ["size", "text_crc32", "shard", "slot", "capacity"]
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    held(out.collect(), plain, 3)
    assert sharding.shard_digests(no_documents).collect() == []


def test_written_shards_hold_their_slots(spark, sf, tmp_path):
    found = sharding.shard_documents(documents(spark, sf), 4)
    sharding.write_shards(found, str(tmp_path / "s"), file_rows=16)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("shard", "slot", "text").collect())) == sorted(map(str, found.select("shard", "slot", "text").collect()))
    for file in (tmp_path / "s").rglob("*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots) and slots[-1] - slots[0] == len(slots) - 1 < 16
