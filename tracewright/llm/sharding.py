"""Shards as contiguous runs of ordered groups, the largest shard as small as it can be.

A group is atomic: all rows of equal text. Groups stand in the order of their smallest id, each with
the running sum of sizes at its end. A capacity is feasible if filling shards one after the other,
each up to it, reaches the end; the smallest feasible one is found by binary search. The driver
never holds the sums themselves but cells of them, which are looked into only where a cut may fall.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SHARDS = 8
#: Cells that one pass over the sums gives the driver, at most.
CELLS = 1 << 16
#: Blocks of the sums up to which their totals are broadcast, some 30 bytes each.
BROADCAST_BLOCKS = 100_000
#: Rows in a file that ``write_shards`` writes.
FILE_ROWS = 1 << 20


class Cells:
    """What is known of the ends of groups: disjoint cells ``(low, high, count)`` in ascending order.

    ``low`` and ``high`` are ends; a cell of more than two has others in between, at unknown places.
    """

    def __init__(self, cells: list[tuple[int, int, int]]) -> None:
        self.cells = sorted(cells)
        self.lows = [c[0] for c in self.cells]
        self.known = sorted({x for c in self.cells for x in c[:2]})

    def unknown(self, at: int) -> tuple[int, int, int] | None:
        """The cell that may have an end at ``at`` which isn't known."""
        k = bisect_right(self.lows, at) - 1
        return self.cells[k] if k >= 0 and self.cells[k][2] > 2 and self.cells[k][0] < at < self.cells[k][1] else None

    def before(self, at: int) -> tuple[int, int]:
        """Least and largest place that the last end up to ``at`` may have; 0 stands before all groups."""
        k = bisect_right(self.known, at) - 1
        low = self.known[k] if k >= 0 else 0
        return low, at if self.unknown(at) else low

    def after(self, at: int) -> tuple[int, int]:
        """Least and largest place that the first end from ``at`` on may have."""
        k = bisect_left(self.known, at)
        high = self.known[k] if k < len(self.known) else self.known[-1]
        return at if self.unknown(at) else high, high


#: A walk gives, for cells, the least and largest place of each of its stops.
Walk = Callable[[Cells], list[tuple[int, int]]]


def _looked_into(sums: DataFrame, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Cells of the ends within ``spans`` (above, up to, cells at most), which are disjoint and in order."""
    above, upto = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    width = np.array([-(-(b - a) // n) for a, b, n in spans], np.int64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = batch.column("end").to_numpy()
            span = np.searchsorted(above, end, "left") - 1
            end, span = end[held := (span >= 0) & (end <= upto[span])], span[held]
            cell = (end - above[span] - 1) // width[span]
            order = np.lexsort((end, cell, span))
            end, span, cell = end[order], span[order], cell[order]
            if n := len(end):
                start = np.flatnonzero(np.r_[True, (np.diff(span) != 0) | (np.diff(cell) != 0)])
                stop = np.r_[start[1:], n]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (span[start], cell[start], end[start], end[stop - 1], stop - start)], names=["span", "cell", "low", "high", "n"])

    near = sums.where((F.col("end") > int(above.min())) & (F.col("end") <= int(upto.max()))).select("end")
    found = near.mapInArrow(look, "span long, cell long, low long, high long, n long")
    return [tuple(r) for r in found.groupBy("span", "cell").agg(F.min("low"), F.max("high"), F.sum("n")).drop("span", "cell").collect()]


def _settled(sums: DataFrame, cells: Cells, walk: Walk) -> Cells:
    """Cells in which every stop of ``walk`` is known: those that may hold one are looked into until none is open."""
    while True:
        stops = walk(cells)
        todo = [c for c in cells.cells if c[2] > 2 and any(c[0] < b and a < c[1] for a, b in stops)]
        if not todo:
            return cells
        n = max(2, CELLS // len(todo))
        inner = _looked_into(sums, [(a, b - 1, n) for a, b, _ in todo])
        kept = set(cells.cells) - set(todo)
        cells = Cells([*kept, *inner, *((x, x, 1) for a, b, _ in todo for x in (a, b))])


def _filled(cells: Cells, capacity: int, shards: int, surely: bool) -> list[int]:
    """Ends of shards that are filled up to ``capacity`` one by one, at the least or the largest places they may have."""
    at, stops = 0, []
    for _ in range(shards):
        at = cells.before(at + capacity)[0 if surely else 1]
        stops.append(at)
    return stops


def _smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def minimax_cuts(sums: DataFrame, shards: int, total: int, giants: list[tuple[int, int]]) -> tuple[int, list[int]]:
    """The smallest capacity and the ends of the first ``shards - 1`` shards of groups with running sums ``end``.

    ``giants`` are place and size of groups larger than the mean shard, of which there are fewer than
    shards. Filling every shard to the capacity could leave the last ones empty where a giant sets
    it. So each cut is, among those that keep all shards within the capacity, the end nearest to an
    equal share of what is left without the giants ahead.
    """

    def bracket(cells: Cells) -> tuple[int, int]:
        low = max(1, -(-total // shards))
        sure = _smallest(lambda c: _filled(cells, c, shards, True)[-1] >= total, low, total)
        return _smallest(lambda c: _filled(cells, c, shards, False)[-1] >= total, low, sure), sure

    def filling(cells: Cells) -> list[tuple[int, int]]:
        low, high = bracket(cells)
        return list(zip(_filled(cells, low, shards, True), _filled(cells, high, shards, False)))

    cells = _settled(sums, Cells(_looked_into(sums, [(0, total, CELLS)])), filling)
    capacity = bracket(cells)[0]

    def least(cells: Cells) -> list[tuple[int, int]]:
        """From each stop on, the rest fits into the shards that are left."""
        low = high = total
        stops = []
        for _ in range(shards - 1):
            low, high = (0 if x <= capacity else cells.after(x - capacity)[k] for k, x in enumerate((low, high)))
            stops.append((low, high))
        return stops[::-1]

    cells = _settled(sums, cells, least)
    floor = [a for a, _ in least(cells)]

    def cut(cells: Cells, at: int, left: int, least_end: int, k: int) -> int:
        ahead = [(end, size) for end, size in giants if end > at]
        first = ahead[0][0] - ahead[0][1] if ahead else total
        aim = at + max(1, (total - at - sum(s for _, s in ahead)) // max(1, left - len(ahead)))
        low, high = cells.before(aim)[k], cells.after(aim)[k]
        near = low if low > at and aim - low <= high - aim else high
        near = ahead[0][0] if ahead and first == at else min(near, first)
        return min(max(near, least_end), cells.before(at + capacity)[k])

    def balanced(cells: Cells) -> list[tuple[int, int]]:
        low = high = 0
        stops = []
        for k in range(shards - 1):
            low, high = (cut(cells, x, shards - k, floor[k], side) for side, x in enumerate((low, high)))
            stops.append((min(low, high), max(low, high)))
        return stops

    cells = _settled(sums, cells, balanced)
    return capacity, [a for a, _ in balanced(cells)]


_SUMS = "key binary, size long, n long, end long, row_end long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        end = size + np.cumsum(batch.column("size").to_numpy())
        row_end = rows + np.cumsum(batch.column("n").to_numpy())
        size, rows = int(end[-1]), int(row_end[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "size", "n")), pa.array(end), pa.array(row_end)], names=["key", "size", "n", "end", "row_end"])


def _group_sums(groups: DataFrame) -> DataFrame:
    """Groups in the order of ``first``, then key, with the sums of sizes and rows up to each one's end."""
    order = [F.col("first").asc_nulls_first(), F.col("key").asc()]
    blocks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = groups.repartitionByRange(blocks, *order).sortWithinPartitions(*order).select("key", "size", "n")
    runs = materialize(spread.mapInArrow(_running, _SUMS).withColumn("block", F.spark_partition_id()), "runs")
    sums = runs.groupBy("block").agg(F.max("end").alias("size_in"), F.max("row_end").alias("rows_in"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("size_in", "rows_in")])
    if sums.count() <= BROADCAST_BLOCKS:
        sums = F.broadcast(sums)
    whole = runs.join(sums, "block").select("key", "size", "n", (F.col("end") + F.col("size_in")).alias("end"), (F.col("row_end") + F.col("rows_in")).alias("row_end"))
    return materialize(whole, "sums", instead=runs)


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (all columns, or those named) with ``size, text_crc32, shard, slot, capacity``.

    ``size`` is the UTF-8 length of the text and 1 for its end. Rows of equal text share a shard; a
    null text counts as an empty one. ``capacity`` is the size of the largest shard, which no other
    contiguous partition undercuts. Slots count the rows of a shard from 0 without a gap, in the
    order of the groups, equal texts side by side. Groups without any id come first. Where there
    are fewer groups than shards, some shards stay empty. An empty table stays empty. Columns of
    ``docs`` named as the new ones give way to them.

    A text's rows meet only as one row for each part of the table, so that a text which a third of
    all rows hold is spread like any other.
    """
    new = ("size", "text_crc32", "shard", "slot", "capacity")
    kept = [c for c in (docs.columns if columns is None else columns) if c not in new]
    bytes_of = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(doc_id).alias("id"), (F.octet_length(bytes_of) + F.lit(1)).cast("long").alias("size"),
        F.crc32(bytes_of.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(bytes_of.cast("binary"), 256)).alias("key"), F.spark_partition_id().alias("part"),
    )
    rows = materialize(rows, "rows")
    parts = rows.groupBy("key", "part").agg(F.min("id").alias("first"), F.sum("size").alias("size"), F.count("*").alias("n"))
    within = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("earlier", F.coalesce(F.sum("n").over(within), F.lit(0))), "parts")
    sums = _group_sums(parts.groupBy("key").agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.sum("n").alias("n")))

    total = sums.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    giants = sorted((r["end"], r["size"]) for r in sums.where(F.col("size") * shards > total).collect())
    capacity, cuts = minimax_cuts(sums, shards, total, giants) if total else (0, [0] * (shards - 1))
    shard = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("end"))) if cuts else F.lit(0)
    placed = sums.select("key", shard.alias("shard"), (F.col("row_end") - F.col("n")).alias("row_start"))
    starts = {r["shard"]: r["start"] for r in placed.groupBy("shard").agg(F.min("row_start").alias("start")).collect()}
    start = F.array(*[F.lit(starts.get(k, 0)).cast("long") for k in range(shards)])[F.col("shard")]
    own = parts.join(placed, "key").select("key", "part", "shard", (F.col("row_start") - start + F.col("earlier")).alias("slot"))
    among = F.row_number().over(Window.partitionBy("key", "part").orderBy("id"))
    return rows.join(own, ["key", "part"]).select("row.*", "size", "text_crc32", "shard", (F.col("slot") + among - 1).alias("slot"), F.lit(capacity).cast("long").alias("capacity"))


def write_shards(sharded: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write rows of ``shard_documents`` as Parquet folders ``shard=<k>``, each file a run of ascending slots."""
    run = F.floor(F.col("slot") / file_rows)
    dealt = sharded.withColumn("_run", run).repartition("shard", "_run").sortWithinPartitions("shard", "_run", "slot")
    dealt.drop("_run").write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)


def shard_digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Of each document its size, checksum, shard and slot by the law ``bytes``, under which no shard is grown."""
    found = shard_documents(docs, shards, columns=["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "capacity")
