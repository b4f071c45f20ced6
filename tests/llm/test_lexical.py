"""Search results against a plain score of every document, for one pass and many, and its tree against brute force."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import assert_same, database

from tracewright.llm import lexical
from tracewright.llm.common import documents
from tracewright.llm.queries import op13_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def searched(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in set(items):
        queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in queries.items():
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_equals_sql(spark, sf):
    assert_same(op13_search(spark, sf).toPandas(), database(sf).execute(lexical.SQL).df())


@pytest.mark.parametrize("pass_terms", [1 << 20, 300])
def test_passes(spark, sf, pass_terms):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = searched([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(lexical.ranked_search(documents(spark, sf), items, pass_terms=pass_terms)) == plain


def test_trees_of_many_ranges_with_ties(spark, monkeypatch):
    """Ranges of 27 documents, few distinct texts: most scores tie, and ids run against the order of rows."""
    monkeypatch.setattr(lexical, "FAN", 3)
    rng = random.Random(5)
    docs = [(5000 - i, " ".join(rng.choices(["a", "b", "c", "dd", "é"], k=rng.choice([1, 3, 3, 9])))) for i in range(700)]
    tree_docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(3)
    items = [(1, "a a b"), (2, "dd é"), (3, "C"), (4, "zz"), (5, None)]
    got = rows(lexical.ranked_search(tree_docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == searched(docs, items) and len(got) == 30


def test_search_opens_few_nodes_and_finds_the_best():
    rng = np.random.default_rng(1)
    n = 20_000
    doc = np.repeat(np.arange(n), 4)
    term = rng.integers(0, 50, 4 * n)
    pairs = np.unique(term * n + doc)
    term, doc = pairs // n, pairs % n
    impact = rng.integers(1, 1000, len(term))
    impact[rng.integers(0, len(term), 30)] += 5000
    tree = lexical.MaxTree(term, doc, impact)
    wanted, weights = np.array([3, 7, 20]), np.array([5, 1, 2])
    opened, bounds = [], tree.bounds
    tree.bounds = lambda *a: opened.append(a) or bounds(*a)
    best = []
    tree.search(wanted, weights, best, lambda d, s: (s, -d), 10)
    score = np.zeros(n, np.int64)
    for t, w in zip(wanted, weights):
        np.add.at(score, doc[term == t], w * impact[term == t])
    assert heapq.nlargest(10, best) == heapq.nlargest(10, ((int(s), -d) for d, s in enumerate(score)))
    assert len(opened) < 300  # of some 650 nodes


def test_odd_documents(spark, odd_documents, no_documents):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    items = [("x", "lorem Ipsum tempor3 x"), ("x", "lorem Ipsum tempor3 x"), ("x", "one"), (None, "été 中文 12345"), ("y", ""), ("z", None), ("w", "!!!")]
    given = spark.createDataFrame(items, "item_id string, text string").selectExpr("item_id", "text", "1 AS number", "2 AS score")
    assert rows(lexical.ranked_search(odd_documents, given)) == searched(docs, items)
    assert rows(lexical.ranked_search(no_documents, given)) == []
    assert rows(lexical.ranked_search(odd_documents, given.where("false"))) == []


def test_terms_across_segments(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 5)
    text = "ab cd-EF é_ü 中文 1234567890 ab"
    assert {t.decode(): n for t, n in lexical.term_counts(text).items()} == Counter(terms(text))
