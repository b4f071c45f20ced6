"""Order-dependent matching against plain versions, and the splitting of long streams."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import comparison as cmp
from tracewright.operators import matching
from tracewright.sources import recordings, tabular


def test_banded_pairs_equal_the_full_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.sort(rng.random(rng.integers(0, 14))) for _ in range(2))
        got = matching.banded_pairs(a, b, 0.1)
        apart = np.abs(a[:, None] - b[None])
        want = matching.monotone_pairs(apart, apart <= 0.1, np.ones((len(a) + 1, len(b) + 1), bool)) if len(a) and len(b) else []
        assert len(got) == len(want) and abs(sum(apart[p] for p in got) - sum(apart[p] for p in want)) < 1e-9
        assert all(apart[p] <= 0.1 for p in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_corners_of_two_sides(spark):
    rng = random.Random(2)
    sides = [[(k, i, round(rng.random(), 3)) for k in range(3) for i in range(40)] for _ in range(2)]
    left, right = (spark.createDataFrame(s, "k int, corner int, s_start double") for s in sides)
    got = matching.pair_corners(left, right, ["k"], 0.004).collect()
    for k in range(3):
        a, b = (np.sort([s for q, _, s in side if q == k]) for side in sides)
        apart = np.abs(a[:, None] - b[None])
        want = matching.monotone_pairs(apart, apart <= 0.004, np.ones((41, 41), bool))
        mine = [r for r in got if r.k == k]
        assert len(mine) == len(want) and abs(sum(abs(r.anchor_delta) for r in mine) - sum(apart[p] for p in want)) < 1e-9


def slow_greedy(rows, tolerance):
    lefts, rights, walls = ([r for r in rows if r[2] in kinds] for kinds in ("l", "r", "rb"))
    order = sorted(lefts, key=lambda x: (min((abs(x[1] - y[1]) for y in rights), default=float("inf")), x[0]))
    free, out = set(y[0] for y in rights), {}
    for x in order:
        fit = [y for y in rights if y[0] in free and abs(y[1] - x[1]) <= tolerance and not any(min(x[0], y[0]) < z[0] < max(x[0], y[0]) for z in walls)]
        best = min(fit, key=lambda y: (abs(y[1] - x[1]), y[0]), default=None)
        out[x[0]] = best and best[0]
        if best:
            free.discard(best[0])
    return out


def test_greedy_pairs_equal_brute_force_across_gaps(spark):
    rng = random.Random(3)
    for shuffled in (False, True):
        t, rows = 0.0, []
        for _ in range(120):
            t += rng.choice([1, 2, 5, 40])
            rows.append((len(rows), t, rng.choice("llrrb")))
        if shuffled:
            index = list(range(len(rows)))
            rng.shuffle(index)
            rows = [(i, t, k) for i, (_, t, k) in zip(index, rows)]
        df = spark.createDataFrame([(1, *r) for r in rows], "k int, i long, t double, kind string")
        kind = F.col("kind")
        got = matching.greedy_pairs(df, ["k"], "i", "t", kind == "l", kind == "r", kind.isin("r", "b"), 6.0)
        assert {r.left_index: r.right_index for r in got.collect()} == slow_greedy(rows, 6.0)


def test_vehicles_are_numbered_through_blocks(spark):
    at = dict(hz=50.0, x0=0.0, y0=0.0, z0=0.0, x1=0.0, y1=0.0, z1=0.0)
    spans = [(1, 0.0, 1.0), (2, 1.1, 2.0), (3, 1.5, 1.9), (4, 5.0, 6.0), (5, 6.1, 7.0), (6, 9.0, 9.5)]
    df = spark.createDataFrame([("a", p, t0, t1, *at.values()) for p, t0, t1 in spans], "k string, part_id int, t0 double, t1 double, " + ", ".join(f"{c} double" for c in at))
    got = {r.part_id: r.vehicle for r in matching.stitch_parts(df, ["k"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3}


def test_progress_on_the_shared_axis(spark):
    pairs = spark.createDataFrame([(1, 1, n, u, s) for n, u, s in [(0, 0.0, 0.0), (1, 0.02, 0.01), (2, 0.04, 0.04)]] + [(1, 2, 3, 0.5, 0.5), (1, 2, 4, 0.52, 0.54)],
                                  "k int, component_no int, pair_no int, a_progress double, shared double")
    points = spark.createDataFrame([(1, 0.01), (1, 0.03), (1, 0.2), (1, 0.51), (1, None), (2, 0.01)], "k int, u double")
    got = {(r.k, r.u): (r.component_no, r.shared and round(r.shared, 6)) for r in cmp.to_shared(points, pairs, ["k"], "u").collect()}
    assert got == {(1, 0.01): (1, 0.005), (1, 0.03): (1, 0.025), (1, 0.2): (None, None), (1, 0.51): (2, 0.52), (1, None): (None, None), (2, 0.01): (None, None)}


def test_large_files_and_broken_documents_have_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("a", 10), ("b", 10), ("c", 2000)):
        (tmp_path / "in" / name).write_bytes(b"x" * n)
    got = recordings.landing(spark, f"file://{tmp_path}/in", 1000).collect()
    assert sorted((r.status, r.length, r.content is None) for r in got) == [("ready", 10, False), ("too_large", 2000, True)]
    (tmp_path / "d.json").write_text('{"a": 1}\n{broken\n{"a": 3}\n')
    docs = tabular.read_documents(spark, f"file://{tmp_path}/d.json", "a int").collect()
    assert [(r.a, r.status) for r in docs] == [(1, "ok"), (None, "malformed"), (3, "ok")] and docs[1].broken == "{broken"
