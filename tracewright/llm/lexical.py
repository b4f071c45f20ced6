"""Ranked lexical search by hierarchical maxima.

Documents are numbered within ranges as tasks read them. For each term of a query, a tree over a
range holds the largest impact of the term under each node. What the terms of a query sum to at a
node bounds every document below it, so the search opens the node of the highest bound first and
ends where no bound reaches the scores already found.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

TOP = 10
#: Children of a node, and levels below a range's root: a range has at most FAN ** LEVELS documents.
FAN, LEVELS = 32, 3
#: Terms of items, repeats in other items included, that a task holds at a time; more items take further passes.
PASS_TERMS = 1 << 20
#: Bytes of a text that are split into terms at a time.
SEGMENT = 1 << 22
#: Groups of ranges whose best documents are ranked before those of all meet.
MERGE_GROUPS = 64

#: Bytes of UTF-8: A-Z in lower case; digits, letters and what is beyond ASCII as they are; all else a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def term_counts(text: str) -> Counter[bytes]:
    """The terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, A-Z lower-cased, with their number."""
    data = text.encode().translate(_TERMS)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT) if len(data) - at > SEGMENT else -1
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, term, times)``: the terms of each item; repeated rows count once, further texts of an id add theirs."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            source, terms, times = [], [], []
            for i, t in enumerate(batch.column("text")):
                found = term_counts(t.as_py() or "")
                source += [i] * len(found)
                terms += [x.decode() for x in found]
                times += found.values()
            ids = batch.column("item_id").take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms, pa.string()), pa.array(times, pa.int64())], names=["item_id", "term", "times"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    found = rows.mapInArrow(split, f"item_id {dict(rows.dtypes)['item_id']}, term string, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, terms: list[tuple[str, int]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, length, terms, counts)`` of each row of ``docs``: its terms with repeats, and those of ``terms`` (term, number) it holds."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): k for t, k in terms}
        for batch in slices(batches):
            lengths, held, counts = [], [], []
            for t in batch.column("text"):
                found = term_counts(t.as_py() or "")
                here = number.keys() & found.keys()
                lengths.append(found.total())
                held.append([number[x] for x in here])
                counts.append([found[x] for x in here])
            arrays = [batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "length", "terms", "counts"])

    return rows.mapInArrow(find, f"doc_id {dict(rows.dtypes)['doc_id']}, length long, terms array<int>, counts array<long>")


class MaxTree:
    """Impacts of terms in the documents 0 to n - 1 of a range, with the maxima under each node of each level.

    A level is a sorted array of ``term * width + node`` beside the values; level 0 has the root's
    children, the last the documents.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        self.levels = []
        for depth in range(LEVELS):
            width, below = FAN ** (depth + 1), FAN ** (LEVELS - 1 - depth)
            key = term.astype(np.int64) * width + doc // below
            order = np.argsort(key, kind="stable")
            key, value = key[order], impact[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            self.levels.append((key[starts], np.maximum.reduceat(value, starts) if len(starts) else value, width))

    def bounds(self, depth: int, node: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of a node of the level above ``depth`` that hold a term, and what the weighted maxima of their terms sum to."""
        keys, values, width = self.levels[depth]
        low = np.searchsorted(keys, terms * width + node * FAN)
        n = np.searchsorted(keys, terms * width + (node + 1) * FAN) - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        child = keys[at] % width - node * FAN
        total = np.zeros(FAN, np.int64)
        np.add.at(total, child, np.repeat(weights, n) * values[at])
        held = np.flatnonzero(total)
        return node * FAN + held, total[held]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], entry, top: int) -> None:
        """Puts the documents that belong among the ``top`` best into the heap ``best``; ``entry`` (document, score) makes an entry of it.

        A node whose bound equals the lowest score kept is opened too, as a smaller id below it may win the tie.
        """
        waiting = [(-math.inf, -1, 0)]
        while waiting:
            bound, depth, node = heapq.heappop(waiting)
            if len(best) == top and -bound < best[0][0]:
                break
            children, totals = self.bounds(depth + 1, node, terms, weights)
            if depth + 2 < LEVELS:
                for c, b in zip(children.tolist(), totals.tolist()):
                    if len(best) < top or b >= best[0][0]:
                        heapq.heappush(waiting, (-b, depth + 1, c))
                continue
            for c, score in zip(children.tolist(), totals.tolist()):
                if len(best) < top:
                    heapq.heappush(best, entry(c, score))
                elif score >= best[0][0]:
                    heapq.heappushpop(best, entry(c, score))


class _Descending:
    """Orders ids downwards within a heap of ascending scores; null ids come last of all."""

    __slots__ = ("value",)

    def __init__(self, value) -> None:
        self.value = value

    def __lt__(self, other: _Descending) -> bool:
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return self.value > other.value


def _searcher(items: list[tuple[object, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        ids, ends, parts, held = [], 0, [], None

        def close() -> None:
            nonlocal ids, ends, parts
            term, doc, impact = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            tree = MaxTree(term, doc, impact)
            for (_, terms, weights), heap in zip(items, best):
                tree.search(terms, weights, heap, lambda d, score: (score, _Descending(ids[d])), top)
            ids, ends, parts = [], 0, []

        kind = None
        for batch in batches:
            kind, k = batch.schema.field("doc_id").type, 0
            while k < batch.num_rows:
                held = batch.slice(k, FAN**LEVELS - ends)
                length, of = held.column("length").to_numpy(), held.column("terms")
                sizes = np.diff(of.offsets.to_numpy())
                doc = np.repeat(np.arange(len(length)), sizes)
                count = held.column("counts").flatten().to_numpy()
                m = 25 + 75 * length * n_docs // max(n_terms, 1)
                parts.append((of.flatten().to_numpy().astype(np.int64), doc + ends, 1_000_000_000 * count // (1000 * count + 8 * m[doc])))
                ids += held.column("doc_id").to_pylist()
                ends, k = ends + held.num_rows, k + held.num_rows
                if ends == FAN**LEVELS:
                    close()
        if ends:
            close()
        found = [(i, score, key.value) for (i, _, _), heap in zip(items, best) for score, key in heap]
        if found:
            i, score, doc = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, kind)], names=["item", "score", "doc_id"])

    return search


def _weighted(of: pa.Table, frequency: dict[str, int], n_docs: int, number: dict[str, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each item: its number, its terms' numbers and what their impact is multiplied by; terms that no document holds are left out."""
    held: dict[int, list[tuple[int, int]]] = {}
    for item, term, times in zip(*(of.column(c).to_pylist() for c in ("item", "term", "times"))):
        if df := frequency.get(number[term], 0):
            held.setdefault(item, []).append((number[term], times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))))
    return [(item, *np.array(sorted(found), np.int64).T) for item, found in held.items()]


def _ranked(found: DataFrame, top: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of highest score of each item, equal scores by ascending id.

    Every row of ``docs`` is a document, repeated ones too; null ids come after all others on a tie.
    Null and empty texts and texts without a term are found by no item and don't count. Scores of 0
    are no results; an item without terms has no row.

    Texts are read once for all items whose terms are up to ``pass_terms`` in total, and items are
    dealt into more passes beyond. The driver and each task get the terms of a pass and their
    document counts; of the documents, only the terms that the items ask for are kept.
    """
    spark = docs.sparkSession
    of = materialize(item_terms(items, item_id, item_text), "item-terms")
    passes = max(1, -(-of.count() // pass_terms))
    out = None
    for k in range(passes):
        own = of.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).orderBy("term").toArrow()
        encoded = own.column("item_id").combine_chunks().dictionary_encode("encode")
        own = own.append_column("item", encoded.indices.cast(pa.int64()))
        number = {t: i for i, t in enumerate(dict.fromkeys(own.column("term").to_pylist()))}
        held = materialize(postings(docs, list(number.items()), doc_id, text), "postings")
        n_docs, n_terms = held.agg(F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
        counted = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        frequency = dict(zip(counted.column("term").to_pylist(), counted.column("count").to_pylist()))
        weighted = _weighted(own, frequency, n_docs, number)
        search = _searcher(weighted, n_docs, n_terms, top)
        found = held.where("size(terms) > 0").mapInArrow(search, f"item long, score long, doc_id {dict(held.dtypes)['doc_id']}")
        near = _ranked(found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))), top, "item", "group").drop("rank")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(encoded.dictionary)), pa.int64()), "item_id": encoded.dictionary}))
        ranked = _ranked(near, top, "item").join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out


#: The same result in SQL, every document scored.
SQL = r"""WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
d AS (SELECT row, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
f AS (SELECT row, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)) AS impact FROM p JOIN d USING (row), s),
g AS (SELECT item_id, doc_id, row, CAST(sum(times * w * impact) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN f USING (term) JOIN d USING (row) GROUP BY ALL HAVING score > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM g)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
