"""Near-duplicate documents by SimHash, candidates filtered on a ring of segments.

Fingerprints of 64 bits are cut into five consecutive segments on a ring. If two fingerprints
differ in at most ``BUDGET`` bits, then some start on the ring has a chain of segments whose
cumulative differences stay within the proportional budget (length l: floor(l * BUDGET / 5)):
0, 0..., i.e. 0, 1, 2, 3, 4 for a budget of 4. So the first segment of that chain agrees
exactly and the second differs in one bit at most, hence one of its halves agrees too; of the
four halves of the second and third, two agree, and so on. A bucket key is (start, first segment,
as many halves of the ``depth - 1`` segments after it as must agree). A deeper key is longer and
there are more of them: 10, 25 or 70 keys a fingerprint of about 19, 26 or 32 bits for a depth of
2, 3 or 4. All depths find the same links; the depth grows with the number of fingerprints, so
that a bucket holds some hundred rows on average at most, whatever the corpus. Within a bucket
the chain is checked segment by segment before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

BUDGET = 4
#: Offset and width of the five segments of a fingerprint.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Rows of a bucket, on average over all possible keys, above which the next depth is taken.
BUCKET_ROWS = 256
#: Segments that a key looks at, from its start on.
DEPTHS = (2, 3, 4)
_TAG = 40

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of a text in UTF-8: bits set in over half the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k : k + _CHUNK], ends[k : k + _CHUNK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with the SimHash as a signed long. Null and empty texts get 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return docs.withColumn(out, of(F.col(text).cast("binary")))


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1))


def agreeing_halves(depth: int) -> list[tuple[int, ...]]:
    """The sets of halves, numbered along the chain after its first segment, of which one must agree.

    Up to the j-th segment after the first, j halves at most hold a differing bit.
    """
    halves = range(2 * (depth - 1))
    differing = (d for d in combinations(halves, depth - 1) if all(sum(h < 2 * j for h in d) <= j for j in range(1, depth)))
    return [tuple(h for h in halves if h not in d) for d in differing]


def key_depth(fingerprints: int) -> int:
    """The least depth whose keys are long enough for so many fingerprints, or the last one."""
    narrow = min(w for _, w in SEGMENTS)
    return next((d for d in DEPTHS if fingerprints <= BUCKET_ROWS << (narrow + (d - 1) * (narrow // 2))), DEPTHS[-1])


def bucket_keys(fp: Column, depth: int = DEPTHS[0]) -> Column:
    """Longs: set of halves and start in the upper bits, then the first segment and those halves."""
    keys = []
    for n, chosen in enumerate(agreeing_halves(depth)):
        for start, (at, width) in enumerate(SEGMENTS):
            key = _bits(fp, at, width)
            for h in chosen:
                to, wide = SEGMENTS[(start + 1 + h // 2) % 5]
                low = wide // 2
                to, wide = (to + low, wide - low) if h % 2 else (to, low)
                key = F.shiftleft(key, wide).bitwiseOR(_bits(fp, to, wide))
            keys.append(key.bitwiseOR(F.lit((5 * n + start) << _TAG)))
    return F.array(*keys)


_MASKS = [np.uint64(((1 << w) - 1) << a) for a, w in SEGMENTS]


def _chain_viable(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether XORs ``x`` keep every prefix of the chain from ``start`` in budget, then all of it."""
    masks = np.array(_MASKS)
    total = np.zeros(x.shape, np.uint8)
    ok = np.ones(x.shape, bool)
    for length in range(1, 6):
        total = total + np.bitwise_count(x & masks[(start + length - 1) % 5])
        ok &= total <= length * BUDGET // 5
    return ok


def _bucket_forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that span the components of one bucket; work is one row at a time."""
    rest, roots, members = np.sort(fps), [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = _chain_viable(rest ^ queue.pop(), start)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                members.append(found)
                roots.append(np.full(len(found), root))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(roots), np.concatenate(members)) if roots else (none, none)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, lo, hi, fp) sorted by (k, lo, hi) to links; a bucket may span batches."""
    held: list[np.ndarray] = []

    def bucketwise(g: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.any(g[1:] != g[:-1], axis=1)) + 1
        first = np.concatenate(([0], cut))
        size = np.diff(np.concatenate((first, [len(g)])))
        out = []
        small = size <= 32
        pos = np.arange(len(g)) - np.repeat(first, size)
        left = np.repeat(np.where(small, size, 0), size) - pos - 1
        start = (g[:, 0] >> _TAG) % 5
        idx = np.flatnonzero(left > 0)
        for d in range(1, 32):
            idx = idx[left[idx] >= d]
            if not len(idx):
                break
            a, b = fp[idx], fp[idx + d]
            ok = _chain_viable(a ^ b, start[idx]) & (a != b)
            out.append((a[ok], b[ok]))
        for k in np.flatnonzero(~small):
            out.append(_bucket_forest(np.unique(fp[first[k] : first[k] + size[k]]), int(start[first[k]])))
        src, dst = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.uint64) for i in (0, 1))
        if len(src):
            pairs = np.unique(np.stack([src.view(np.int64), dst.view(np.int64)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("k", "lo", "hi", "fp")], 1)
        held.append(rows)
        changed = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1))
        if not len(changed) and (len(held) == 1 or np.array_equal(held[-2][-1, :3], rows[0, :3])):
            continue
        whole = np.concatenate(held)
        last = np.flatnonzero(np.any(whole[1:, :3] != whole[:-1, :3], axis=1))[-1] + 1
        held = [whole[last:]]
        yield from bucketwise(whole[:last, :3], np.ascontiguousarray(whole[:last, 3]).view(np.uint64))
    if held:
        whole = np.concatenate(held)
        yield from bucketwise(whole[:, :3], np.ascontiguousarray(whole[:, 3]).view(np.uint64))


def simhash_links(fps: DataFrame, fp: str = "fp", block: int = BLOCK, depth: int | None = None) -> DataFrame:
    """Links (src, dst) that span the components of all distinct fingerprints within the budget.

    ``depth`` of the bucket keys is that for the number of rows of ``fps`` where none is given.

    A bucket above ``block`` rows is split into blocks by hash; every pair of its blocks is one
    group of two blocks at most, so no task gathers a whole bucket and no link is lost.
    """
    depth = depth or key_depth(fps.count())
    keys = fps.select(F.explode(bucket_keys(F.col(fp), depth)).alias("k"), F.col(fp).alias("fp"))
    counts = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keys.join(counts, "k").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.expr("filter(sequence(0, blocks - 1), o -> blocks = 1 or o <> own)")
    dealt = dealt.withColumn("own", own).select("k", "fp", "own", F.explode(other).alias("o"))
    dealt = dealt.select("k", F.least("own", "o").alias("lo"), F.greatest("own", "o").alias("hi"), "fp")
    spread = dealt.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi")
    return spread.mapInArrow(_links, "src long, dst long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", fp: str = "fp") -> DataFrame:
    """``docs`` (id and fingerprint) with ``component_id``: the smallest id reachable by links.

    Every row is returned. Equal fingerprints are one node, so copies cost no links. Rows with a
    null id take part as links and keep a null id; ``component_id`` is null only where a whole
    component has null ids. Repeated rows stay. ``component`` is the component's internal node.
    """
    nodes = materialize(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first_id")), "fps")
    comps = connected_components(simhash_links(nodes))
    labelled = nodes.join(comps, nodes["fp"] == comps["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    labelled = materialize(labelled, "labelled")
    first = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    table = labelled.join(first, "component").select(F.col("fp").alias("_fp"), "component", "component_id")
    return docs.join(table, docs[fp] == table["_fp"]).drop("_fp")


def simhash_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document.

    Words are runs without ASCII white space, A-Z lower-cased; shingles have 4 words, repeats
    count, shorter texts are one shingle. Null, empty and blank texts have fingerprint zero and
    link like any other. An empty table gives an empty result; other columns are ignored.
    """
    fps = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    fps = materialize(fps.select("doc_id", "fp"), "fingerprints")
    done = simhash_components(fps)
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the smallest id.

    A component whose ids are all null keeps one of its rows; repeated rows of the kept id stay once.
    Rows travel as one struct, so further columns may have any names.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    held = materialize(with_fingerprint(rows).drop("text"), "documents")
    return keep_smallest(held, simhash_components(held.select(F.col("id").alias("doc_id"), "fp")))


def keep_smallest(held: DataFrame, labelled: DataFrame) -> DataFrame:
    """The row with the smallest id of each component: ``held`` (row, id, fp), ``labelled`` (doc_id, fp, component, component_id)."""
    # the smallest id of a component may stand on several rows: the smallest fingerprint among them is kept
    chosen = (
        labelled
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min(F.struct("fp", "doc_id")).alias("at"))
        .select(F.col("at.fp").alias("kept_fp"), F.col("at.doc_id").alias("kept_id"))
    )
    chosen = materialize(chosen, "chosen")
    kept = held.join(chosen, (F.col("fp") == F.col("kept_fp")) & F.col("id").eqNullSafe(F.col("kept_id")))
    repeated = held.select("id", "fp").groupBy("id", "fp").agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select(F.col("id").alias("twice_id"), F.col("fp").alias("twice_fp")), "repeated")
    if repeated.isEmpty():
        return kept.select("row.*")
    twice = (F.col("fp") == F.col("twice_fp")) & F.col("id").eqNullSafe(F.col("twice_id"))
    single = kept.join(repeated, twice, "left_anti")
    several = kept.join(repeated, twice, "left_semi").dropDuplicates(["id", "fp"])
    return single.select("row.*").union(several.select("row.*"))
