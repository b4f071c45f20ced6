"""Benchmark passages in documents, found by pieces and verified by edit distance.

An item of w words may differ from a passage in ``floor(rate * w)`` words inserted, deleted or
replaced. Cut into one piece more than that budget, one piece at least must stand in the passage
unchanged. Benchmarks have sentences in common, so an item is cut into some more pieces yet, of
which as many more must stand: those that most items hold are not looked for, as one of the others
does all the same. One pass over the documents looks each run of as many words as some piece has up among
the hashes of all pieces; documents with hits meet the items by a join on those hashes, and around
each hit Myers' bit-parallel algorithm computes the smallest edit distance over words of the item
to any passage. Of the benchmark, only hashes of pieces (8 bytes for some 8 words) reach the driver
and the tasks of the pass; items and texts meet in joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .hashing import run_hashes, word_hashes

#: Share of an item's words that may differ; below 1.
RATE = 0.12
#: Pieces that one pass looks for (64 MB of hashes); larger benchmarks take a pass for each so many.
PASS_PIECES = 8_000_000
#: Items that a row's text is verified against at a time, and parts into which the rows that hold one piece are dealt.
ITEMS, SALTS = 64, 8
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def spare_pieces(n_words: int, budget: int) -> int:
    """Pieces beyond ``budget + 1`` into which an item is cut: half as many again and one, if it has the words for it."""
    return max(0, min(1 + budget // 2, n_words - budget - 1))


def pieces(item: list[str], budget: int, spare: int = 0) -> list[tuple[int, list[str]]]:
    """``budget + 1 + spare`` consecutive pieces with their first word's place, as equal as can be."""
    n = budget + 1 + spare
    edges = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def myers(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any stretch of ``passage``, and where that ends.

    The first such end is given. One bit a word of the item, in Python's long integers.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(passage):
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += (ph & top != 0) - (mh & top != 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def best_passage(item: list[str], budget: int, shown: list[str], origins: list[int]) -> tuple[int, int, int] | None:
    """The nearest passage (distance, first word, end word) around places where the item may begin; the first on a tie."""
    reach, best, stretches = len(item) + budget, None, []
    for at in sorted(origins):
        a, b = max(0, at - budget), at + reach
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    for a, b in stretches:
        distance, end = myers(item, shown[a:b])
        if distance <= budget and (best is None or distance < best[0]):
            back, length = myers(item[::-1], shown[a : a + end][::-1])
            best = (distance, a + end - (length if back == distance else len(item)), a + end)
    return best


def benchmark_pieces(items: DataFrame, rate: float) -> DataFrame:
    """``(item, h, at, n)``: hash, place and words of the pieces of ``items`` (item, text) that are looked for.

    Of an item's pieces one more than its budget, those that the fewest items hold: if at most so many words
    differ, the spare pieces can't be all that stand.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for key, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                item = words(t)
                budget = int(rate * len(item))
                for at, piece in pieces(item, budget, spare_pieces(len(item), budget)) if item else []:
                    _, h = next(run_hashes(word_hashes(piece), [len(piece)]))
                    rows.append((key, int(h.view(np.int64)[0]), at, len(piece), budget + 1))
            columns = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["item", "h", "at", "n", "needed"])

    cut_up = materialize(items.mapInArrow(cut, "item long, h long, at int, n int, needed int"), "cut")
    held = cut_up.groupBy("h", "n").agg(F.count_distinct("item").alias("items"))
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("items", "at"))
    return cut_up.join(held, ["h", "n"]).withColumn("rank", rarest).where("rank <= needed").select("item", "h", "at", "n")


class PieceIndex:
    """Looks up runs of words among piece hashes by number of words: a bitmap, then a sorted array."""

    def __init__(self, hashes: dict[int, np.ndarray]):
        self.hashes = {n: np.sort(h) for n, h in hashes.items()}
        bits = max(16, int(16 * sum(map(len, hashes.values()))).bit_length())
        self.shift = np.uint64(64 - bits)
        self.marked = np.zeros(1 << bits, bool)
        for h in hashes.values():
            self.marked[h >> self.shift] = True

    def hits(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Number of the text, place and hash of each run that is a piece."""
        ends = np.cumsum([len(t) for t in texts])
        h = word_hashes([w for t in texts for w in t])
        for n, runs in run_hashes(h, self.hashes):
            at = np.flatnonzero(self.marked[runs >> self.shift])
            known = self.hashes[n]
            found = runs[at]
            at = at[known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found]
            text = np.searchsorted(ends, at, side="right")
            whole = at + n <= ends[text]  # no run goes on into the next text
            text, at = text[whole], at[whole]
            yield text, at - np.concatenate(([0], ends))[text], runs[at]


_HITS = "array<struct<h:long,pos:int>>"


def _pieces_found(hashes: dict[int, np.ndarray]):
    made: list[PieceIndex] = []  # one index for each task

    @F.arrow_udf(_HITS)
    def found(column: pa.Array) -> pa.Array:
        if not made:
            made.append(PieceIndex(hashes))
        parts = []
        for part in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
            n = part.num_rows
            hits = list(made[0].hits([words(t) for t in part.column("text").to_pylist()]))
            text, pos, h = (np.concatenate([x[k] for x in hits]) if hits else np.zeros(0, np.int64) for k in range(3))
            order = np.argsort(text, kind="stable")
            inner = pa.StructArray.from_arrays([pa.array(h[order].astype(np.uint64).view(np.int64)), pa.array(pos[order].astype(np.int32))], names=["h", "pos"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), inner))
        kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))
        return pa.concat_arrays([p.cast(kind) for p in parts]) if parts else pa.array([], kind)

    return found.asNondeterministic()  # evaluated once, however often its result is used


_FOUND = "array<struct<item:long,v:struct<distance:int,first_word:int,end_word:int,item_words:int>>>"


def _verifier(rate: float):
    @F.arrow_udf(_FOUND)
    def verify(text: pa.Array, asked: pa.Array) -> pa.Array:
        out = []
        for t, items in zip(text, asked):  # texts become Python objects one by one
            shown, found = words(t.as_py()), []
            for i in items:
                own = words(i["item_text"].as_py())
                best = best_passage(own, int(rate * len(own)), shown, i["origins"].as_py())
                if best:
                    found.append({"item": i["item"].as_py(), "v": dict(zip(("distance", "first_word", "end_word", "item_words"), (*best, len(own))))})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("item", pa.int64()), ("v", pa.struct([(c, pa.int32()) for c in ("distance", "first_word", "end_word", "item_words")]))])))

    return verify.asNondeterministic()


def _passes(benchmark: DataFrame, item_id: str, item_text: str, rate: float, limit: int) -> Iterator[tuple[DataFrame, DataFrame, dict[int, np.ndarray]]]:
    """Distinct items (item, item_id, text), their pieces, and the distinct piece hashes by number of words, so many at a time."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    all_pieces = materialize(benchmark_pieces(items.select("item", "text"), rate), "pieces")
    parts = max(1, -(-all_pieces.count() // limit))
    for part in range(parts):
        own = all_pieces.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        rows = own.select("n", "h").distinct().toArrow()
        n, h = rows.column("n").to_numpy(), rows.column("h").to_numpy().view(np.uint64)
        yield items, own, {int(k): h[n == k] for k in np.unique(n)}


def _verified(marked: DataFrame, items: DataFrame, pieces_of: DataFrame, rate: float) -> DataFrame:
    """``(uid, item, v)``: the items that rows ``marked`` (uid, text, hits) hold.

    A piece that very many rows hold meets its items in salted parts. A row's text is joined once for
    every ``ITEMS`` items it may hold.
    """
    hits = marked.select("uid", F.explode("hits").alias("hit")).select("uid", "hit.h", "hit.pos", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).alias("salt"))
    salted = pieces_of.select("h", "item", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = hits.join(salted, ["h", "salt"]).groupBy("uid", "item").agg(F.collect_set(F.col("pos") - F.col("at")).alias("origins"))
    part = F.floor((F.row_number().over(Window.partitionBy("uid").orderBy("item")) - 1) / ITEMS)
    asked = met.withColumn("part", part).join(items.select("item", F.col("text").alias("item_text")), "item")
    asked = asked.groupBy("uid", "part").agg(F.collect_list(F.struct("item", "item_text", "origins")).alias("asked"))
    found = asked.join(marked.select("uid", "text"), "uid").select("uid", F.explode(_verifier(rate)("text", "asked")).alias("x"))
    return found.select("uid", "x.item", "x.v")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, pass_pieces: int = PASS_PIECES) -> DataFrame:
    """``(doc_id, item_id, distance, first_word, end_word, item_words)``: each item a document holds.

    Words are runs of letters, digits and underscores, lower-cased; places count them from 0. The
    nearest passage is given, the first one on a tie. Items without a word are never found; null
    and empty texts hold nothing. Repeated documents give repeated rows; repeated items one. Ids
    may have any type.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for items, pieces_of, hashes in _passes(benchmark, item_id, item_text, rate, pass_pieces):
        held = rows.withColumn("hits", _pieces_found(hashes)(F.col("text"))).where("size(hits) > 0")
        marked = materialize(held.withColumn("uid", F.monotonically_increasing_id()), "marked")
        found = _verified(marked, items, pieces_of, rate)
        found = found.join(items.select("item", "item_id"), "item").join(marked.select("uid", "doc_id"), "uid").select("doc_id", "item_id", "v.*")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, pass_pieces: int = PASS_PIECES) -> DataFrame:
    """``docs`` without the rows that hold any benchmark item; each row is judged by its own text.

    Rows travel as one struct, so further columns may have any names. Only rows with a piece of some
    item take part in joins.
    """
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    for items, pieces_of, hashes in _passes(benchmark, item_id, item_text, rate, pass_pieces):
        held = kept.withColumn("hits", _pieces_found(hashes)(F.col("text"))).withColumn("uid", F.monotonically_increasing_id())
        held = materialize(held.withColumn("text", F.when(F.size("hits") > 0, F.col("text"))), "documents")
        marked = held.where("size(hits) > 0")
        bad = materialize(_verified(marked, items, pieces_of, rate).select("uid").distinct(), "contaminated")
        clean = marked.join(bad, "uid", "left_anti").select("row").union(held.where("size(hits) <= 0").select("row"))
        kept = clean.select("row", F.col("row")[text].alias("text"))
    return kept.select("row.*")
