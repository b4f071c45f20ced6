"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import simhash
from tracewright.llm.common import documents
from tracewright.llm.components import connected_components


def slow_fingerprint(text):
    import re

    import xxhash

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = {f: f for f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[top(a)] = top(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[top(f)] = min(least.get(top(f), i), i)
    return [least.get(top(f)) for f in fps]


def test_query_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: r for r in simhash.simhash_near_duplicates(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    assert {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps)} == {i: r.fingerprint for i, r in got.items()}
    assert {r.doc_id: c for r, c in zip(rows, brute_components([r.doc_id for r in rows], fps))} == {i: r.component_id for i, r in got.items()}


def neighbours(rng, n):
    """Fingerprints in chains and balls: some a few bits from an earlier one, some far."""
    out = [rng.getrandbits(64)]
    for _ in range(n - 1):
        base = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            base ^= 1 << b
        out.append(base)
    return out


@pytest.mark.parametrize(("block", "depth"), [(4, 2), (50, 2), (1000, 2), (50, 3), (1000, 4)])
def test_links_of_dense_groups_are_whole(spark, block, depth):
    rng = random.Random(block)
    fps = neighbours(rng, 400)
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    links = simhash.simhash_links(df.select("fp").distinct(), block=block, depth=depth)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(range(len(fps)), fps)
    label = [got.get(s, s) for s in signed]
    groups = {}
    for a, b in zip(label, want):
        groups.setdefault(a, set()).add(b)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


@pytest.mark.parametrize("depth", simhash.DEPTHS)
def test_every_link_within_the_budget_shares_a_key(spark, depth):
    rng = random.Random(depth)
    flips = [(rng.getrandbits(64), rng.sample(range(64), 4)) for _ in range(400)]
    pairs = np.array([(a, a ^ sum(1 << b for b in bits)) for a, bits in flips], np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([tuple(p) for p in pairs], "a long, b long")
    both = df.select(simhash.bucket_keys(F.col("a"), depth).alias("x"), simhash.bucket_keys(F.col("b"), depth).alias("y"))
    assert both.where("not arrays_overlap(x, y)").count() == 0
    assert len(both.first().x) == 5 * len(simhash.agreeing_halves(depth))


def test_depth_grows_with_the_number_of_fingerprints():
    depths = [simhash.key_depth(10**n) for n in range(13)]
    assert depths == sorted(depths) and set(depths) == set(simhash.DEPTHS) and depths[6] == 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3), (0, 1)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert len(got) == 303 and {got[i] for i in range(301)} == {0} and got[1001] == 1000
    assert connected_components(edges.where("false")).count() == 0


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    got = simhash.simhash_near_duplicates(odd_documents).collect()
    assert len(got) == 12
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[7].component_id == by[8].component_id == 7 and by[3].component_id == 3
    assert simhash.simhash_near_duplicates(no_documents).count() == 0


def test_one_document_of_each_component_stays(spark, odd_documents, no_documents):
    kept = simhash.keep_one_per_component(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 3, 4, 5, 7, 9]
    assert simhash.keep_one_per_component(no_documents).count() == 0
    nameless = odd_documents.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one_per_component(nameless).count() == 6
