"""Packing documents into fixed-length training sequences by the sum-of-squares rule.

A piece goes into the open sequence whose choice leaves the sum of the squared numbers of open
sequences per residual gap smallest; a new one is opened only where none has room, as few sequences
are the aim: weighed as one more choice, new ones raise the 4,936 sequences of the sf0.1 documents,
which are also the bound of their tokens, to 4,947 longest first and to 4,998 as pieces come. Pieces are
dealt at random into shards, each packed longest first; sequences that a shard leaves with a gap
are then packed once more, as wholes, over groups of shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .tokens import TOGETHER, default_vocabulary, encoder

CAPACITY = 2048
#: Pieces in a shard, on average. Results do not depend on order; a shard's loss is about one sequence.
SHARD_PIECES = 16_384
#: Shards whose unfilled sequences are packed together in the second round.
SHARD_GROUP = 128


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and fill of the bin for each size (0 < size <= capacity), longest placed first.

    Placing size s into gap g changes the sum of squared counts by 2 (n[g-s] - n[g]) + 2 (a filled
    bin no longer counts). Equal changes go to the smallest gap; equal sizes keep their order.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        here = count[s:capacity]
        if here.any():
            after = count[: capacity - s].copy()
            after[0] = 0
            change = 2 * (after - here) + 2
            change[0] -= 1
            change[here == 0] = np.iinfo(np.int64).max
            g = s + int(change.argmin())
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if g > s:
            count[g - s] += 1
            open_bins[g - s].append(b)
    return bins, offsets, np.array(fill, np.int64)[bins] if n else bins


def _packer(length: str, capacity: int, tag: str, order: str):
    def pack(pdf):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        bins, offsets, fill = sum_of_squares(pdf[length].to_numpy(), capacity)
        pdf["_bin"] = bins + pdf[tag].to_numpy() * (1 << 32)
        pdf["_offset"], pdf["_fill"] = offsets, fill
        return pdf

    return pack


def pack_pieces(pieces: DataFrame, length: str = "length", row: str = "_row", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``row`` is a unique long, stable over rereads.

    Lengths are 1 to ``capacity``. Full pieces are sequences of their own. An empty table stays empty.
    """
    n = pieces.where(F.col(length) < capacity).count()
    shards = max(1, -(-n // shard_pieces))
    full = pieces.where(F.col(length) == capacity).withColumns({"sequence_id": -F.col(row) - 1, "offset": F.lit(0).cast("long")})
    part = pieces.where(F.col(length) < capacity).withColumn("_shard", F.pmod(F.xxhash64(row), F.lit(shards)).cast("long"))
    schema = ", ".join(f"`{c}` {t}" for c, t in part.dtypes) + ", _bin long, _offset long, _fill long"
    packed = materialize(part.groupBy("_shard").applyInPandas(_packer(length, capacity, "_shard", row), schema), "packed")
    # second round: whole sequences with a gap are the pieces, groups of shards the shards
    gaps = packed.where((F.col("_offset") == 0) & (F.col("_fill") < capacity))
    gaps = gaps.select(F.col("_bin").alias("_old"), F.col("_fill").alias("_size"), F.expr(f"_shard div {SHARD_GROUP}").alias("_group"))
    moved = gaps.groupBy("_group").applyInPandas(
        _packer("_size", capacity, "_group", "_old"), "_old long, _size long, _group long, _bin long, _offset long, _fill long"
    )
    moved = moved.select("_old", (F.col("_bin") + F.lit(1 << 62)).alias("_new"), F.col("_offset").alias("_base"))
    joined = packed.join(moved, packed["_bin"] == moved["_old"], "left")
    done = joined.withColumns(
        {
            "sequence_id": F.coalesce("_new", "_bin"),
            "offset": F.col("_offset") + F.coalesce("_base", F.lit(0)),
        }
    )
    columns = [*pieces.columns, "sequence_id", "offset"]
    return full.select(*columns).unionByName(done.select(*columns))


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, special_as_text: bool = False, stretches: int | None = None) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32)`` of each document's ids and its end id.

    Null and empty texts have the end id alone. A longer document is cut into full pieces, the
    first one taking the remainder, so that all but one are sequences of their own.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[doc_id]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, special_as_text, stretches)
        for batch in slices(batches, *TOGETHER):
            out, source = [], []
            for i, ids in enumerate(own.encode_all(batch.column("text"))):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    out.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    source.append(i)
            piece, start, length, crc = zip(*out) if out else ((), (), (), ())
            arrays = [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32())]
            arrays += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0, special_as_text: bool = False, stretches: int | None = None) -> DataFrame:
    """Tokenize, cut and pack: one row a piece with its ``sequence_id`` and ``offset``.

    Repeated rows and rows with null ids are packed like all others; other columns are ignored. A worker
    keeps two generations of so many ``stretches`` of text, by default those of the encoder; only speed and memory depend on it.
    """
    pieces = token_pieces(docs, doc_id, text, vocabulary, capacity, end_id, special_as_text, stretches)
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, capacity=capacity).drop("_row")
