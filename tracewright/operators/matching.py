"""Order-dependent matching, a group's columns at a time, and the joins of identities.

A group is a stretch of a stream that no pair crosses. Groups are dealt by number to as many
tasks as the session has shuffle partitions, each of which works through many small ones in order.
Candidates come from joins wherever they can.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import range_join


def blockwise(rows: DataFrame, keys: Sequence[str], work: Callable[[dict[str, np.ndarray]], dict[str, Sequence]], results: str, order: Sequence[str]) -> DataFrame:
    """``keys`` and ``results`` (DDL), as ``work`` makes them of the columns of each group of ``keys`` and ``_block``.

    Groups are dealt by hash over the session's number of shuffle partitions, which is not merged
    afterwards as tiny data would be, and sorted, so that a task holds one batch and one group.
    """
    group, kinds = [*keys, "_block"], dict(rows.dtypes)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(n, F.xxhash64(*group)).sortWithinPartitions(*group, *order)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {results}"

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        for c in group:
            before = pdf[c].shift()
            new |= ((pdf[c] != before) & ~(pdf[c].isna() & before.isna())).to_numpy()
        return np.flatnonzero(new)

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        edges, columns = [0, *starts(pdf)[1:].tolist(), len(pdf)], {c: pdf[c].to_numpy() for c in pdf.columns}
        made, sizes = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            made.append(work({c: v[a:b] for c, v in columns.items()}))
            sizes.append(len(next(iter(made[-1].values()))))
        out = pdf[list(keys)].take(np.repeat(edges[:-1], sizes)).reset_index(drop=True)
        for c in made[0]:
            out[c] = pd.array([v for m in made for v in m[c]], dtype="Int64") if c.endswith("_index") else [v for m in made for v in m[c]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            join = pd.concat([held[-1].tail(1), pdf]) if held else pdf
            last = starts(join)[1:] - (1 if held else 0)
            if not len(last):
                held.append(pdf)
                continue
            yield done(pd.concat([*held, pdf.iloc[: last[-1]]], ignore_index=True))
            held = [pdf.iloc[last[-1] :]]
        if held:
            yield done(pd.concat(held, ignore_index=True))

    return spread.mapInPandas(run, schema)


def greedy_pairs(events: DataFrame, keys: Sequence[str], index: str, time: str, left: Column, right: Column, blocks: Column, tolerance: float) -> DataFrame:
    """One-to-one pairs of ``left`` and ``right`` events, nearest first.

    Left events are served by their smallest distance to any right event, then by index; each takes
    the nearest free right event within ``tolerance`` unless a blocking event lies between the two
    by index. Left events without one are returned with NULLs.
    """
    rows = events.select(*keys, F.col(index).cast("long").alias("i"), F.col(time).cast("double").alias("t"), left.alias("l"), right.alias("r"), blocks.alias("b"))
    rows = rows.where("l or r or b")
    # no pair crosses a gap in time above the tolerance; where indexes keep to that order too, no blocking event does
    w = Window.partitionBy(*keys).orderBy("t", "i")
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t"), F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_low": F.min("i").over(ahead), "_high": F.max("i").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    apart = (F.col("t") - F.lag("t").over(w) > tolerance) & (F.col("_low") > F.col("_high"))
    rows = rows.withColumn("_block", F.sum(F.coalesce(apart, F.lit(False)).cast("long")).over(w)).drop("_low", "_high")

    # blocks without a left event have no row, those without a right one no pair; the others are matched
    own = Window.partitionBy(*keys, "_block")
    rows = rows.withColumns({"_l": F.max("l").over(own), "_r": F.max("r").over(own)}).where("_l")
    results = "left_index long, left_t double, right_index long, right_t double, distance double"
    alone = rows.where("l and not _r").select(*keys, F.col("i").alias("left_index"), F.col("t").alias("left_t"), *[F.lit(None).cast(k).alias(c) for c, k in (("right_index", "long"), ("right_t", "double"), ("distance", "double"))])

    def match(c: dict[str, np.ndarray]) -> dict[str, Sequence]:
        i, t = c["i"], c["t"]
        wall = np.sort(i[c["b"]])
        la, lb = np.flatnonzero(c["l"]), np.flatnonzero(c["r"])
        la, lb = la[np.argsort(i[la], kind="stable")], lb[np.argsort(i[lb], kind="stable")]
        (ai, at), (ii, ti) = (i[la], t[la]), (i[lb], t[lb])
        by_time = np.argsort(ti, kind="stable")
        times = ti[by_time]
        # the nearest right event in time, before or after, orders the left ones
        after = np.searchsorted(times, at)
        edge = np.concatenate(([-np.inf], times, [np.inf]))
        first = np.minimum(at - edge[after], edge[after + 1] - at)
        free, out = np.ones(len(ii), bool), []
        for k in np.lexsort((ai, first)):
            near = by_time[np.searchsorted(times, at[k] - tolerance) : np.searchsorted(times, at[k] + tolerance, side="right")]
            near = np.sort(near[free[near]])
            if len(near):
                lo, hi = np.minimum(ii[near], ai[k]), np.maximum(ii[near], ai[k])
                near = near[np.searchsorted(wall, hi, side="left") == np.searchsorted(wall, lo, side="right")]
            if len(near):
                j = near[np.abs(ti[near] - at[k]).argmin()]
                free[j] = False
                out.append((ai[k], at[k], ii[j], ti[j], abs(ti[j] - at[k])))
            else:
                out.append((ai[k], at[k], None, None, None))
        return dict(zip(("left_index", "left_t", "right_index", "right_t", "distance"), zip(*out)))

    return blockwise(rows.where("_r").drop("_l", "_r"), keys, match, results, ["i"]).union(alone)


def combo_sequences(nitros: DataFrame, boosts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labelled sequences of a nitro with small boosts around it, boosts used once, nitros in time order.

    ``WCW``: a boost 900 to 600 ms before and one 20 to 120 ms after, in one drift. ``CWW``: boosts 100
    to 850 and 600 to 1400 ms after, 450 to 900 ms apart, in one drift. ``CW``: one 20 to 120 ms
    after, in a drift. The first kind that fits is taken, with the boosts nearest the usual places.
    ``nitros``: ``t`` in ms; ``boosts``: ``t, drift_id``.
    """
    kinds = dict(nitros.dtypes)
    both = nitros.select(*keys, F.col("t").cast("double").alias("t"), F.lit(True).alias("nitro"), F.lit(None).cast("long").alias("drift_id")).unionByName(
        boosts.select(*keys, F.col("t").cast("double").alias("t"), F.lit(False).alias("nitro"), F.col("drift_id").cast("long").alias("drift_id"))
    )

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        small = pdf[~pdf.nitro].sort_values("t").reset_index(drop=True)
        st, drift, used, out = small.t.to_numpy(), small.drift_id, np.zeros(len(small), bool), []
        for n in np.sort(pdf.t[pdf.nitro].to_numpy()):
            d = st - n
            # a window's ends are inside; ties go to the boost nearer in time before, earlier after
            pick = lambda lo, hi: [int(k) for k in np.flatnonzero(~used & (d >= lo) & (d <= hi)) if pd.notna(drift[k])]
            same = lambda a, b: drift[a] == drift[b]
            options = [("WCW", abs(d[a] + 783) + abs(d[b] - 67), (a, b)) for a in reversed(pick(-900, -600)) for b in pick(20, 120) if same(a, b)]
            if not options:
                options = [
                    ("CWW", abs(d[a] - 684) + abs(d[b] - 1242) + abs(d[b] - d[a] - 542), (a, b))
                    for a in pick(100, 850) for b in pick(600, 1400) if b > a and 450 <= d[b] - d[a] <= 900 and same(a, b)
                ]
            if not options:
                options = [("CW", abs(d[a] - 67), (a,)) for a in pick(20, 120)]
            if options:
                kind, _, chosen = min(options, key=lambda o: o[1])
                used[list(chosen)] = True
                out.append((kind, n, int(drift[chosen[0]]), [float(d[k]) for k in sorted(chosen)]))
        got = pd.DataFrame(out, columns=["label", "nitro_t", "drift_id", "boost_deltas"])
        for c in reversed(list(keys)):
            got.insert(0, c, pdf[c].iloc[0])
        return got

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", label string, nitro_t double, drift_id long, boost_deltas array<double>"
    return both.groupBy(*keys).applyInPandas(label, schema)


def stitch_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Physical parts joined to logical vehicles: ``keys, part_id, vehicle``.

    ``parts``: ``part_id, t0, t1, hz, x0, y0, z0, x1, y1, z1``, taken by start. A part continues the open
    vehicle of the best score whose end is -0.06 to 0.35 s before, whose rate differs by at most 1.5
    and which is within 3 and 30 a second of gap; else it begins a new one. The score adds
    distance, five times the gap and the rate's difference; a vehicle's rate is averaged on the way.
    Parts are cut into blocks where one begins over 0.35 s after all before it have ended, as no
    vehicle goes on from there; vehicles are numbered through the blocks.
    """
    kinds = dict(parts.dtypes)
    w = Window.partitionBy(*keys).orderBy("t0", "t1", "part_id")
    ended = F.col("t0") - F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0.35
    parts = parts.withColumn("_block", F.sum(F.coalesce(ended, F.lit(False)).cast("long")).over(w))

    def join(c: dict[str, np.ndarray]) -> dict[str, Sequence]:
        ends, rates, owner = np.zeros((0, 4)), np.zeros(0), []
        for t0, t1, hz, x0, y0, z0, x1, y1, z1 in zip(*(c[n].astype(float) for n in ("t0", "t1", "hz", "x0", "y0", "z0", "x1", "y1", "z1"))):
            best = None
            if len(ends):
                gap, dhz = t0 - ends[:, 0], np.abs(hz - rates)
                away = np.sqrt(((ends[:, 1:] - np.array([x0, y0, z0])) ** 2).sum(axis=1))
                fits = (gap >= -0.06) & (gap <= 0.35) & (dhz <= 1.5) & (away <= 3 + 30 * np.maximum(gap, 0))
                if fits.any():
                    best = int(np.where(fits, away + 5 * np.abs(gap) + dhz, np.inf).argmin())
            end = np.array([t1, x1, y1, z1])
            if best is None:
                best, ends, rates = len(ends), np.vstack((ends, end)), np.append(rates, hz)
            else:
                ends[best], rates[best] = end, (rates[best] + hz) / 2
            owner.append(best)
        return {"part_id": c["part_id"], "_block": c["_block"], "vehicle": owner}

    local = blockwise(parts, keys, join, f"part_id {kinds['part_id']}, _block long, vehicle long", ["t0", "t1", "part_id"])
    # a block's vehicles come after all of the blocks before it
    order = Window.partitionBy(*keys).orderBy("_block", "vehicle")
    first = F.coalesce(~F.col("_block").eqNullSafe(F.lag("_block").over(order)) | (F.col("vehicle") != F.lag("vehicle").over(order)), F.lit(True))
    return local.withColumn("vehicle", F.sum(first.cast("long")).over(order) - 1).drop("_block")


def _turn(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    short = (np.hypot(ax, ay) < 1e-9) | (np.hypot(bx, by) < 1e-9)
    return np.where(short, 0.0, np.degrees(np.arctan2(ax * by - ay * bx, ax * bx + ay * by)))


def _tangents(x: np.ndarray, y: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chord over both neighbours; none where a neighbour belongs to another block."""
    k = np.arange(len(x))
    p, q = np.maximum(k - 1, 0), np.minimum(k + 1, len(x) - 1)
    inside = (block[p] == block) & (block[q] == block)
    return np.where(inside, x[q] - x[p], 0.0), np.where(inside, y[q] - y[p], 0.0)


def monotone_pairs(cost: np.ndarray, allowed: np.ndarray, band: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), both increasing: as many allowed ones as can be, then of the least total cost.

    Cells of ``band`` (one larger each way) may be passed. On equal terms a row is skipped before a
    column, and both before a pair. Only cells of the band are computed; their totals are kept for two rows.
    """
    n, m = cost.shape
    if not band[0, 0]:
        return []
    moves: list[bytearray] = []
    above, above_total = [-1] * (m + 1), [np.inf] * (m + 1)
    for i in range(n + 1):
        count, total, move = [-1] * (m + 1), [np.inf] * (m + 1), bytearray(m + 1)
        ok, costs = (allowed[i - 1].tolist(), cost[i - 1].tolist()) if i else ([False] * m, [0.0] * m)
        for j in np.flatnonzero(band[i]).tolist():
            if i == j == 0:
                count[0], total[0] = 0, 0.0
                continue
            most, least, code = above[j], above_total[j], 1 if above[j] >= 0 else 0
            if j:
                c, t = count[j - 1], total[j - 1]
                if c > most or (c == most and t < least - 1e-12):
                    most, least, code = c, t, 2
                if ok[j - 1] and above[j - 1] >= 0:
                    c, t = above[j - 1] + 1, above_total[j - 1] + costs[j - 1]
                    if c > most or (c == most and t < least - 1e-12):
                        most, least, code = c, t, 3
            count[j], total[j], move[j] = most, least, code
        moves.append(move)
        above, above_total = count, total
    i, j, out = n, m, []
    if above[m] < 0:
        return []
    while i or j:
        code = moves[i][j]
        if code == 3:
            out.append((i - 1, j - 1))
        i, j = i - (code in (1, 3)), j - (code in (2, 3))
        if code == 0:
            break
    return out[::-1]


_PAIR_SCHEMA = "pair_no int, component_no int, a_d double, b_d double, a_t double, b_t double, a_progress double, b_progress double, shared double, separation double, heading_delta double"


def align_trajectories(subject: DataFrame, baseline: DataFrame, keys: Sequence[str], band: float = 0.06, separation: float = 30.0, heading: float = 80.0, gap: float = 0.03) -> DataFrame:
    """Pairs of control points (``d, time_s, x, y, block``) of two laps that follow the same route.

    Both sides' progress only moves forward; a pair is within ``band`` of progress, ``separation`` metres
    and ``heading`` degrees. As many pairs as can be, then the least total separation. Time has no
    part in the cost. A gap of progress above ``gap`` on either side begins a new component.
    """
    kinds = dict(subject.dtypes)
    cols = [*keys, "d", "time_s", "x", "y", "block"]

    def align(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (p.sort_values(["d", "time_s"], kind="stable").reset_index(drop=True) for p in (a, b))
        none = pd.DataFrame({k: [] for k in [*keys, *[c.split()[0] for c in _PAIR_SCHEMA.split(", ")]]})
        if len(a) < 2 or len(b) < 2 or a.d.iloc[-1] <= a.d.iloc[0] or b.d.iloc[-1] <= b.d.iloc[0]:
            return none
        ua, ub = ((p.d - p.d.iloc[0]).to_numpy() / (p.d.iloc[-1] - p.d.iloc[0]) for p in (a, b))
        (ax, ay), (bx, by) = ((p.x.to_numpy(), p.y.to_numpy()) for p in (a, b))
        (hax, hay), (hbx, hby) = _tangents(ax, ay, a.block.to_numpy()), _tangents(bx, by, b.block.to_numpy())
        away = np.hypot(ax[:, None] - bx[None], ay[:, None] - by[None])
        bend = np.abs(_turn(hax[:, None], hay[:, None], hbx[None], hby[None]))
        edge = np.abs(np.concatenate(([0.0], ua))[:, None] - np.concatenate(([0.0], ub))[None]) <= band
        pairs = monotone_pairs(away, (away <= separation) & (bend <= heading), edge)
        if not pairs:
            return none
        i, j = map(np.array, zip(*pairs))
        jump = np.maximum(np.diff(ua[i]), np.diff(ub[j])) > gap
        out = pd.DataFrame({"pair_no": np.arange(len(i)), "component_no": np.concatenate(([0], np.cumsum(jump))) + 1, "a_d": a.d.to_numpy()[i], "b_d": b.d.to_numpy()[j],
                            "a_t": a.time_s.to_numpy()[i], "b_t": b.time_s.to_numpy()[j], "a_progress": ua[i], "b_progress": ub[j], "shared": (ua[i] + ub[j]) / 2,
                            "separation": away[i, j], "heading_delta": bend[i, j]})
        for c in reversed(list(keys)):
            out.insert(0, c, a[c].iloc[0])
        return out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _PAIR_SCHEMA
    return subject.select(*cols).toDF(*cols).groupBy(*keys).cogroup(baseline.select(*cols).toDF(*cols).groupBy(*keys)).applyInPandas(align, schema)


def banded_pairs(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs of two sorted arrays within ``tolerance``, in order: as many as can be, then the least total difference.

    Only cells within the tolerance are computed and kept. On equal terms a row is skipped before a
    column, and both before a pair.
    """
    lo, hi = np.searchsorted(b, a - tolerance, side="left"), np.searchsorted(b, a + tolerance, side="right")
    moves: list[bytearray] = []
    start, before = 0, [(0, 0.0)]  # the row above: best (pairs, -cost) for b's first start, start + 1, ... elements
    for i, x in enumerate(a):
        first, last = int(lo[i]), int(hi[i])
        above = lambda j: before[min(max(j - start, 0), len(before) - 1)]  # noqa: B023, E731
        row, move = [above(first)], bytearray([1])
        for j in range(first + 1, last + 1):
            best, code = above(j), 1
            if row[-1][0] > best[0] or (row[-1][0] == best[0] and row[-1][1] > best[1] + 1e-12):
                best, code = row[-1], 2
            d = abs(float(x) - float(b[j - 1]))
            n, cost = above(j - 1)
            if d <= tolerance and (n + 1 > best[0] or (n + 1 == best[0] and cost - d > best[1] + 1e-12)):
                best, code = (n + 1, cost - d), 3
            row.append(best)
            move.append(code)
        moves.append(move)
        start, before = first, row
    out, i, j = [], len(a) - 1, len(b)
    while i >= 0:
        j = min(j, int(hi[i]))
        code = moves[i][j - int(lo[i])] if j >= lo[i] else 1
        if code == 3:
            out.append((i, j - 1))
        i, j = i - (code != 2), j - (code != 1)
    return out[::-1]


def pair_corners(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 0.02) -> DataFrame:
    """Corners (``corner, s_start``) of two sides paired in order: most pairs, then least difference.

    Corners of both sides are cut into blocks wherever two neighbours are farther apart than the
    tolerance, which no pair crosses; within a block only cells within the tolerance are computed.
    """
    kinds = dict(left.dtypes)
    cols = [*keys, "corner", "s_start"]
    both = left.select(*cols, F.lit(True).alias("_left")).unionByName(right.select(*cols, F.lit(False).alias("_left"))).where("s_start is not null")
    w = Window.partitionBy(*keys).orderBy("s_start", "_left", "corner")
    wide = F.coalesce(F.col("s_start") - F.lag("s_start").over(w) > tolerance, F.lit(True))
    both = both.withColumn("_block", F.sum(wide.cast("long")).over(w))

    # a block of one side has no pair
    own = Window.partitionBy(*keys, "_block")
    both = both.withColumns({"_any": F.max("_left").over(own), "_all": F.min("_left").over(own)}).where("_any and not _all").drop("_any", "_all")

    def pair(c: dict[str, np.ndarray]) -> dict[str, Sequence]:
        (at, a), (bt, b) = ((c["s_start"][c["_left"] == side], c["corner"][c["_left"] == side]) for side in (True, False))
        got = banded_pairs(at, bt, tolerance)
        i, j = (np.array(x, int) for x in zip(*got)) if got else (np.zeros(0, int),) * 2
        return {"left_corner": a[i], "right_corner": b[j], "anchor_delta": at[i] - bt[j]}

    return blockwise(both, keys, pair, f"left_corner {kinds['corner']}, right_corner {kinds['corner']}, anchor_delta double", ["s_start", "corner"])


def claim_in_order(candidates: DataFrame, keys: Sequence[str], claimant: str, item: str, order: Sequence[Column]) -> DataFrame:
    """``keys, claimant, item``: claimants in ascending order, each with its first candidate that none before it has taken.

    ``candidates`` have a row for each item that a claimant may take; ``order`` puts a claimant's items
    in order, smallest first. A claimant whose items are all taken has a NULL item. A group of ``keys`` holds the
    few claimants and items of one recording; their lists are worked through as arrays, without Python.
    """
    kinds = dict(candidates.dtypes)
    ranked = candidates.groupBy(*keys, claimant).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)], F.col(item).alias("item")))).alias("_ranked"))
    whole = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(claimant).alias("claimant"), "_ranked"))).alias("_all"))

    def claim(done: Column, c: Column) -> Column:
        free = F.filter(c["_ranked"], lambda x: ~F.exists(done, lambda d: d["item"].eqNullSafe(x["item"])))
        return F.concat(done, F.array(F.struct(c["claimant"].alias("claimant"), F.get(free, F.lit(0))["item"].alias("item"))))

    none = F.array().cast(f"array<struct<claimant:{kinds[claimant]},item:{kinds[item]}>>")
    claims = whole.select(*keys, F.explode(F.aggregate("_all", none, claim)).alias("c"))
    return claims.select(*keys, F.col("c.claimant").alias(claimant), F.col("c.item").alias(item))


def unique_or_role(requests: DataFrame, table: DataFrame, ident: str, role: str, value: str) -> DataFrame:
    """``requests`` (``want_id, want_role``) with ``value``: by exact id, else by role if it is the only one."""
    by_id = table.select(F.col(ident).alias("_i"), F.col(value).alias("_by_id"))
    by_role = table.groupBy(F.col(role).alias("_r")).agg(F.count("*").alias("_n"), F.min(value).alias("_by_role")).where("_n = 1").drop("_n")
    j = requests.join(by_id, F.col("want_id") == F.col("_i"), "left").join(by_role, F.col("want_role") == F.col("_r"), "left")
    how = F.when(F.col("_i").isNotNull(), "id").when(F.col("_r").isNotNull(), "unique_role").otherwise("unresolved")
    return j.select(*requests.columns, F.coalesce("_by_id", "_by_role").alias(value), how.alias("resolved_by"))


def resolve_bindings(games: DataFrame, resources: DataFrame, anchors: DataFrame, offset: int = 100) -> DataFrame:
    """Game maps bound to resource folders; more than one candidate refuses.

    ``games``: ``game_id, name``; ``resources``: ``resource_id, name, declared_id``; ``anchors``: ``game_id,
    name, resource_id``. Names are compared as given, so normalise them first. In order: a verified
    anchor of id and name, the one folder that declares the id, refusal of a name that several games
    have, the one folder of the exact name, and the folder ``offset`` below as a mere candidate.
    """
    known = resources.select(F.col("resource_id").alias("rid")).distinct()
    a = anchors.groupBy("game_id", "name").agg(F.max("resource_id").alias("a_id")).join(known.withColumnRenamed("rid", "a_rid"), F.col("a_id") == F.col("a_rid"), "left")
    declared = resources.where("declared_id is not null").groupBy(F.col("declared_id").alias("game_id")).agg(F.countDistinct("resource_id").alias("d_n"), F.min("resource_id").alias("d_id"))
    named = resources.where("name is not null and name <> ''").groupBy("name").agg(F.countDistinct("resource_id").alias("n_n"), F.min("resource_id").alias("n_id"))
    twins = games.where("name is not null and name <> ''").groupBy("name").agg(F.count("*").alias("g_n"))
    j = games.join(a, ["game_id", "name"], "left").join(declared, "game_id", "left").join(twins, "name", "left").join(named, "name", "left")
    j = j.join(known, F.col("rid") == F.col("game_id") - offset, "left")
    status = (
        F.when(F.col("a_rid").isNotNull(), "verified_anchor")
        .when(F.col("a_id").isNotNull(), "verified_anchor_resource_missing")
        .when(F.col("d_n") == 1, "declared_id")
        .when(F.col("d_n") > 1, "ambiguous_declared_id")
        .when(F.col("g_n") > 1, "ambiguous_game_name")
        .when(F.col("n_n") == 1, "exact_name")
        .when(F.col("n_n") > 1, "ambiguous_resource_name")
        .when(F.col("rid").isNotNull(), "offset_candidate")
        .otherwise("unresolved")
    )
    j = j.withColumn("status", status)
    bound = (
        F.when(F.col("status") == "verified_anchor", F.col("a_id"))
        .when(F.col("status") == "declared_id", F.col("d_id"))
        .when(F.col("status") == "exact_name", F.col("n_id"))
        .when(F.col("status") == "offset_candidate", F.col("rid"))
    )
    return j.select("game_id", "name", bound.alias("resource_id"), "status", F.col("status").isin("verified_anchor", "declared_id", "exact_name").alias("authoritative"))


def resolve_tiers(replays: DataFrame, rooms: DataFrame, bindings: DataFrame, confirmed: DataFrame, names: DataFrame) -> DataFrame:
    """Recordings (``replay, hint``) to maps by trust: room prefix with an authoritative binding,
    user-confirmed, exact name, unresolved.

    The longest room name that begins the hint counts, if it is the only one of its length. ``rooms``:
    ``room, game_id``; ``confirmed``: ``replay, resource_id``; ``names``: ``name, resource_id``.
    """
    # a distinct hint meets rooms by its own prefixes: an equi-join, however many rooms there are. What grows with the
    # recordings is never broadcast: it is the left side of left joins, or a sorted side, whatever its file's size promises
    hints = replays.select("hint").distinct()
    prefixes = hints.select("hint", F.explode(F.transform(F.sequence(F.lit(1), F.length("hint")), lambda n: F.substring(F.col("hint"), F.lit(1), n))).alias("room"))
    met = prefixes.join(rooms.where("room <> ''").select("room", "game_id", F.length("room").alias("_l")), "room", "left")

    def longest(rows: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
        of = rows.groupBy(key, "_l").agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi")).groupBy(key)
        return of.agg(F.max("_l").alias("_l"), F.max_by(F.struct("_lo", "_hi"), "_l").alias("_b")).select(key, "_l", "_b._lo", "_b._hi")

    told = replays.join(longest(met, "hint", "game_id", "game_id").hint("merge"), "hint", "left")
    hit = longest(told, "replay", "_lo", "_hi").select("replay", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("game_id"))
    good = bindings.where("authoritative").select("game_id", F.col("resource_id").alias("_room"))
    by_room = hit.join(good, "game_id", "left").select("replay", "_room").hint("merge")
    users = confirmed.select("replay", F.col("resource_id").alias("_user")).hint("merge")
    one = names.groupBy(F.col("name").alias("hint")).agg(F.countDistinct("resource_id").alias("_n"), F.min("resource_id").alias("_name")).where("_n = 1").drop("_n")
    j = replays.join(by_room, "replay", "left").join(users, "replay", "left").join(one, "hint", "left")
    method = F.when(F.col("_room").isNotNull(), "room_prefix").when(F.col("_user").isNotNull(), "user_confirmed").when(F.col("_name").isNotNull(), "exact_name").otherwise("unresolved")
    return j.select("replay", "hint", F.coalesce("_room", "_user", "_name").alias("resource_id"), method.alias("method"))


def probe_names(probes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Each probe's (``name``) ids over several tables of ``(name, id)``, with the tables that know it."""
    out = None
    for source, table in tables.items():
        hit = probes.join(table, "name").select("name", "id", F.lit(source).alias("source"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("name", "id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def match_by_time(left: DataFrame, right: DataFrame, keys: Sequence[str], within: float = 1800, sure: float = 600, near: float = 120, clear: float = 120) -> DataFrame:
    """``left`` (``id, t``) with the row of ``right`` (``rid, t``) of a fitting time, with confidence.

    Within ``within`` seconds; ``high`` if exactly one is within ``sure``; ``medium`` if the nearest is
    within ``near`` and the next one at least ``clear`` farther; else none.
    """
    r = right.select(*keys, F.col("rid"), F.col("t").alias("_rt"), (F.col("t") - within).alias("_lo"), (F.col("t") + within).alias("_hi"))
    j = range_join(left, r, keys, "t", "_lo", "_hi", width=2 * within).withColumn("gap", F.abs(F.col("t") - F.col("_rt")))
    # the two nearest decide; of each left row no more is kept before or after the shuffle
    place = F.row_number().over(Window.partitionBy(*keys, "id").orderBy("gap", "rid"))
    two = j.withColumn("_n", place).where("_n <= 2").groupBy(*keys, "id")
    two = two.agg(F.max(F.when(F.col("_n") == 1, F.col("gap"))).alias("g1"), F.max(F.when(F.col("_n") == 2, F.col("gap"))).alias("g2"), F.max(F.when(F.col("_n") == 1, F.col("rid"))).alias("_rid"))
    alone = (F.col("g1") <= sure) & (F.col("g2").isNull() | (F.col("g2") > sure))
    conf = F.when(alone, "high").when((F.col("g1") <= near) & (F.col("g2").isNull() | (F.col("g2") - F.col("g1") >= clear)), "medium")
    best = two.select(*keys, "id", conf.alias("confidence"), F.when(conf.isNotNull(), F.col("_rid")).alias("rid"))
    return left.join(best, [*keys, "id"], "left")
