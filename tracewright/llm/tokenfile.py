"""Token files: ids in canonical length-limited Huffman codes, in blocks that decode alone.

A file is a folder with two Parquet tables, so that any store Spark writes to can hold it:

* ``codebook``: ``symbol, bits``. Codes are canonical: by length, then by symbol.
* ``blocks``: whole documents in ascending id order. ``part, block`` order the blocks;
  ``part_start`` counts the ids before it in its part; ``payload`` holds each document's codes
  from a byte boundary on; ``doc_bytes`` their lengths; ``checks`` the bit offsets, within its
  document, of every ``CHECK``-th id but the first, so that long documents decode in parallel too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, slices
from .tokens import TOGETHER, default_vocabulary, encoder

#: Longest code, unless more symbols are used than such codes can tell apart.
MAX_BITS = 16
#: Longest code that decoding can look up in one window of four bytes.
WINDOW_BITS = 25
#: Parts of a file up to which their sums are broadcast, some 100 bytes each.
BROADCAST_PARTS = 100_000
CHECK = 256
#: Ids after which a block ends with the document at hand.
BLOCK_IDS = 1 << 20
#: Ids in a part at most, on average.
PART_IDS = 1 << 26


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for unused symbols.

    Where so many symbols are used that no such code exists, the limit is one bit above the least possible.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        max_bits = (len(used) - 1).bit_length() + 1
    if max_bits > WINDOW_BITS:
        raise ValueError(f"codes of {max_bits} bits are beyond the decoder's window of {WINDOW_BITS}")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    leaf_marks, level = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate((weights, level))
        order = np.argsort(merged, kind="stable")
        leaf_marks.append(order < len(weights))
        merged = merged[order]
        level = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, bits = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for marks in reversed(leaf_marks):
        leaves = int(marks[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[used] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.searchsorted(lengths[order], 1) :].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every window of as many bits as the longest code has, 16 at least."""
    max_bits = max(MAX_BITS, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[np.searchsorted(lengths[order], 1) :]
    repeat = 1 << (max_bits - lengths[order].astype(np.int64))
    fill = (1 << max_bits) - int(repeat.sum())
    symbols = np.concatenate((np.repeat(order, repeat), np.zeros(fill, np.int64))).astype(np.uint32)
    return symbols, np.concatenate((np.repeat(lengths[order], repeat), np.ones(fill, np.uint8))).astype(np.int64)


def encode_ids(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of documents one after another, each from a byte boundary on.

    Returns the bytes, each document's number of bytes, all checkpoints and their number by document.
    """
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    first = np.cumsum(sizes) - sizes
    doc_bits = np.add.reduceat(bits, first) if len(sizes) else bits
    doc_bytes = (doc_bits + 7) // 8
    shift = 8 * (np.cumsum(doc_bytes) - doc_bytes) - (ends[first] - bits[first])
    at = ends - bits + np.repeat(shift, sizes)
    # codes that begin in one 64-bit word add up there; at most one of them runs into the next word
    room = 64 - bits - (at & 63)
    value = codes[ids].astype(np.uint64)
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    word = at >> 6
    total = int(doc_bytes.sum())
    words = np.zeros(total // 8 + 2, np.uint64)
    if len(ids):
        begins = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
        words[word[begins]] = np.add.reduceat(high, begins)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    data = words.astype(">u8").view(np.uint8)
    pos = np.arange(len(ids)) - np.repeat(first, sizes)
    marks = np.flatnonzero((pos % CHECK == 0) & (pos > 0))
    owner = np.repeat(np.arange(len(sizes)), sizes)[marks]
    checks = at[marks] - 8 * (np.cumsum(doc_bytes) - doc_bytes)[owner]
    return data[:total], doc_bytes, checks, np.bincount(owner, minlength=len(sizes))


def decode_ids(data: np.ndarray, doc_bytes: np.ndarray, sizes: np.ndarray, checks: np.ndarray, n_checks: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of all documents, one table look-up a step for every stretch between checkpoints."""
    symbols, steps = table
    bits, mask = (len(symbols) - 1).bit_length(), np.uint32(len(symbols) - 1)
    window = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    if bits <= MAX_BITS:
        window, spare = (window[:-3] << 16) | (window[1:-2] << 8) | window[2:-1], 24 - bits
    else:
        window, spare = (window[:-3] << 24) | (window[1:-2] << 16) | (window[2:-1] << 8) | window[3:], 32 - bits
    lanes = 1 + n_checks
    of = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    p = 8 * (np.cumsum(doc_bytes) - doc_bytes)[of]
    p[nth > 0] += checks
    to = (np.cumsum(sizes) - sizes)[of] + nth * CHECK
    left = np.minimum(sizes[of] - nth * CHECK, CHECK)
    order = np.argsort(-left, kind="stable")
    p, to, left = p[order], to[order], left[order]
    out = np.zeros(int(sizes.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(CHECK), side="left")
    for k in range(CHECK):
        n = active[k]
        if not n:
            break
        q = p[:n]
        x = (window[q >> 3] >> (spare - (q & 7)).astype(np.uint32)) & mask
        out[to[:n] + k] = symbols[x]
        q += steps[x]
    return out


def _tokenized(docs: DataFrame, vocabulary: str, end_id: int, special_as_text: bool) -> DataFrame:
    """``(doc_id, ids)``: ids as 16-bit integers, or as 32-bit ones from the first above 65,535 on."""
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, special_as_text)
        wide = max(own.tokenizer.get_vocab().values(), default=0) >= 1 << 16 or end_id >= 1 << 16
        for batch in slices(batches, *TOGETHER):
            ids = (x + end for x in own.encode_all(batch.column("text")))
            if not wide:
                ids = (np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([wide] * batch.num_rows, pa.bool_()), pa.array(list(ids), pa.binary())],
                names=["doc_id", "wide", "ids"],
            )

    return docs.mapInArrow(tokenize, f"doc_id {kind}, wide boolean, ids binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and the number of each row."""
    raw = batch.column("ids").to_pylist()
    wide = bool(batch.num_rows and batch.column("wide")[0].as_py())
    ids = np.frombuffer(b"".join(raw), "<u4" if wide else "<u2").astype(np.int64)
    return ids, np.array([len(x) for x in raw], np.int64) // (4 if wide else 2)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in slices(batches, 1024):
        found = np.bincount(_flat(batch)[0])
        if len(found) > len(total):
            found, total = total, found
        total = total.copy()
        total[: len(found)] += found
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["symbol", "n"])


def write_token_file(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2, special_as_text: bool = False) -> None:
    """Encode every whole text with its end id and write the file at ``path``, ids ascending.

    Null and empty texts have the end id alone. Null document ids come first; equal ids stand
    next to each other in any order. ``doc_id`` is an integer column. The counts of ids (as many
    as the vocabulary) and the bounds of the parts are all that the driver receives.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = materialize(_tokenized(rows, vocabulary, end_id, special_as_text), "ids")
    counts = held.select("wide", "ids").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    size = max([r["symbol"] for r in counts], default=end_id) + 1
    tally = np.zeros(size, np.int64)
    for r in counts:
        tally[r["symbol"]] = r["n"]
    lengths = code_lengths(tally)
    used = np.flatnonzero(lengths)
    book = spark.createDataFrame([(int(s), int(lengths[s])) for s in used], "symbol int, bits int")
    book.coalesce(1).write.parquet(f"{path}/codebook")

    total = int(tally.sum())
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 20))), -(-total // PART_IDS), 1)
    at = [k / parts for k in range(1, parts)]
    bounds = held.agg(F.percentile_approx("doc_id", at, 10 * parts + 1000)).first()[0] if at else []
    bounds = np.array(bounds or [], np.int64)
    codes = canonical_codes(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in slices(batches):
            ids, sizes = _flat(batch)
            data, doc_bytes, checks, n_checks = encode_ids(ids, sizes, lengths, codes)
            key = batch.column("doc_id")
            value = key.fill_null(0).to_numpy(zero_copy_only=False)
            low = np.searchsorted(bounds, value, side="left")
            high = np.searchsorted(bounds, value, side="right")
            # an id that fills whole parts is dealt out over those parts
            part = np.where(key.is_null().to_numpy(zero_copy_only=False), 0, low + (seen + np.arange(len(value))) % (high - low + 1))
            seen += len(value)
            buf, cut, mark = data.tobytes(), np.concatenate(([0], np.cumsum(doc_bytes))), np.concatenate(([0], np.cumsum(n_checks)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    key,
                    pa.array(sizes),
                    pa.array([buf[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    pa.array([checks[a:b] for a, b in zip(mark[:-1], mark[1:])], pa.list_(pa.int64())),
                ],
                names=["part", "doc_id", "n", "payload", "checks"],
            )

    coded = held.mapInArrow(encode, "part int, doc_id long, n long, payload binary, checks array<long>")
    ordered = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_blocks, _BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


_BLOCK_SCHEMA = "part int, block int, part_start long, doc_ids array<long>, n_ids array<long>, doc_bytes array<long>, checks array<long>, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, done, rows, ids = None, 0, 0, [], 0

    def close() -> pa.RecordBatch:
        values = [
            [part], [block], [done], [[r[0] for r in rows]], [[r[1] for r in rows]], [[len(r[2]) for r in rows]],
            [[c for r in rows for c in r[3]]], [b"".join(r[2] for r in rows)],
        ]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]
        names = ["part", "block", "part_start", "doc_ids", "n_ids", "doc_bytes", "checks", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for p, doc, n, payload, checks in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if rows and (p != part or ids >= BLOCK_IDS):
                yield close()
                block, done, rows, ids = block + 1, done + ids, [], 0
            if p != part:
                part, block, done = p, 0, 0
            rows.append((doc, n, payload, checks))
            ids += n
    if rows:
        yield close()


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of each document, decoded block by block.

    ``start`` counts the ids of all documents before it. ``ids`` are little-endian 32-bit integers;
    a reader that does not select them never builds the column on the JVM side.
    """
    book = spark.read.schema("symbol int, bits int").parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max([r["symbol"] for r in book], default=0) + 1, np.uint8)
    for r in book:
        lengths[r["symbol"]] = r["bits"]
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return _with_start(blocks).mapInArrow(_decoder(lengths, True), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_file`` without the ids: only their checksums leave the Python workers."""
    book = spark.read.schema("symbol int, bits int").parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max([r["symbol"] for r in book], default=0) + 1, np.uint8)
    for r in book:
        lengths[r["symbol"]] = r["bits"]
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return _with_start(blocks).mapInArrow(_decoder(lengths, False), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _with_start(blocks: DataFrame) -> DataFrame:
    """Ids before each part; there is one row a part, so the running sum is over a small table."""
    n = F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.groupBy("part").agg(F.sum(n).alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("before"))
    if sums.count() <= BROADCAST_PARTS:
        sums = F.broadcast(sums)
    return blocks.join(sums, F.col("part") == F.col("_part")).withColumn("start", F.col("before") + F.col("part_start")).drop("_part", "before")


def _decoder(lengths: np.ndarray, with_ids: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in ("start", "doc_ids", "n_ids", "doc_bytes", "checks", "payload")}
                sizes = np.array(row["n_ids"].as_py(), np.int64)
                doc_bytes = np.array(row["doc_bytes"].as_py(), np.int64)
                data = np.frombuffer(row["payload"].as_py(), np.uint8)
                n_checks = (sizes - 1) // CHECK
                ids = decode_ids(data, doc_bytes, sizes, np.array(row["checks"].as_py(), np.int64), n_checks, table).astype("<u4")
                raw, ends = ids.tobytes(), np.cumsum(sizes)
                spans = [raw[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), sizes.tolist())]
                arrays = [
                    pa.array(row["doc_ids"].as_py(), pa.int64()),
                    pa.array(row["start"].as_py() + ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(spans, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return decode


def token_file_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 2, special_as_text: bool = False) -> DataFrame:
    """Write a new token file in the shared folder and read each document's digest back from it."""
    path = new_path(docs.sparkSession, "token-file")
    write_token_file(docs, path, doc_id, text, vocabulary, end_id, special_as_text)
    return read_token_digests(docs.sparkSession, path)
