"""Benchmark passages against brute force over all places."""

import random

from tracewright.llm import decontaminate as dec


def edit_rows(item, text):
    """Least edit distance of the item to a stretch of the text that ends at each place."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return row


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(1500):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 90))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 120))]
        row = edit_rows(item, text)
        assert dec.myers(item, text) == (min(row), row.index(min(row)))


def test_pieces_cover_the_item():
    for n in range(0, 30):
        for budget in range(0, max(1, n)):
            parts = dec.pieces(list(range(n)), budget)
            assert len(parts) == budget + 1 and [w for _, p in parts for w in p] == list(range(n)) and all(p == list(range(a, a + len(p))) for a, p in parts)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        k = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[k] = f"new{rng.randrange(99)}"
            case 1:
                out.insert(k, f"new{rng.randrange(99)}")
            case _:
                del out[k]
    return out


def test_hits_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([3, 9, 17, 40]))] for _ in range(12)]
    texts = []
    for _ in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            item = rng.choice(items)
            words += edited(rng, item, rng.randint(0, int(0.12 * len(item)) + 1)) + [rng.choice(vocab) for _ in range(9)]
        texts.append(" ".join(words).upper() if rng.random() < 0.3 else ", ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            least = min(edit_rows(item, dec.words(t)))
            if least <= int(dec.RATE * len(item)):
                want[d, i] = least
    for pieces_a_pass in (10, dec.PASS_PIECES):
        got = dec.benchmark_hits(docs, bench, pass_pieces=pieces_a_pass).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in got} == want
        for r in got:
            stretch = dec.words(texts[r.doc_id])[r.first_word : r.end_word]
            assert edit_rows(items[r.item_id], stretch)[-1] == r.distance
    kept = {r.doc_id for r in dec.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(80)) - {d for d, _ in want}


def test_planted_passages_are_found(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: " ".join(dec.words(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items.items() if f" {t} " in f" {' '.join(dec.words(r.text))} "}
    got = {(r.doc_id, r.item_id) for r in dec.benchmark_hits(docs, bench).where("distance = 0").collect()}
    assert want == got and want


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "nothing here"), ("y", "before one two three four after")], "doc_id string, text string").repartition(2)
    for kind, value in (("int", 7), ("string", "q7"), ("long", 7), ("date", None)):
        bench = spark.createDataFrame([(value, "One two three four"), (None, "no such words")], f"item_id {kind}, text string")
        for part in (1, 1000):
            assert [tuple(r) for r in dec.benchmark_hits(docs, bench, pass_pieces=part).collect()] == [("y", value, 0, 1, 5, 4)]
            assert [r.doc_id for r in dec.drop_contaminated(docs, bench, pass_pieces=part).collect()] == ["x"]


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one"), (4, "one"), (None, "lorem")], "item_id long, text string")
    got = dec.benchmark_hits(odd_documents, bench).collect()
    assert {r.doc_id for r in got if r.item_id == 4} == {7, 8} and all(r.item_id in (4, None) for r in got)
    kept = dec.drop_contaminated(odd_documents, bench)
    assert kept.columns == odd_documents.columns and {1, 2, 5, 6, 9} <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert dec.benchmark_hits(no_documents, bench).count() == 0 and dec.drop_contaminated(no_documents, bench).count() == 0
    assert dec.benchmark_hits(odd_documents, bench.where("false")).count() == 0 and dec.drop_contaminated(odd_documents, bench.where("false")).count() == 12


def test_a_shared_start_brings_no_pairs(spark, monkeypatch):
    """200 items and 200 documents with one start: documents meet the items that they hold something else of."""
    rng = random.Random(9)
    start = "which of the following statements about the subject is true"
    own = [" ".join(f"v{rng.randrange(5000)}" for _ in range(20)) for _ in range(200)]
    bench = spark.createDataFrame([(i, f"{start} {x}") for i, x in enumerate(own)], "item_id long, text string")
    texts = [f"before {start} and then {own[i]} end" if i % 40 == 0 else f"{start} {own[i]} end" if i % 4 == 0 else f"some {start} other words {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], dec._verified
    monkeypatch.setattr(dec, "_verified", lambda marked, items, pieces_of, rate: seen.append((marked, pieces_of)) or real(marked, items, pieces_of, rate))
    got = {(r.doc_id, r.item_id, r.distance) for r in dec.benchmark_hits(docs, bench).collect()}
    assert got == {(i, i, 2 if i % 40 == 0 else 0) for i in range(0, 200, 4)}
    marked, pieces_of = seen[0]
    hits = marked.selectExpr("uid", "explode(hits.h) AS h").distinct()
    assert 50 <= hits.join(pieces_of, "h").select("uid", "item").distinct().count() < 1000


def test_spare_pieces_never_outnumber_the_words():
    for n in range(1, 200):
        budget = int(dec.RATE * n)
        spare = dec.spare_pieces(n, budget)
        assert spare >= 0 and all(p for _, p in dec.pieces(list(range(n)), budget, spare)) and (n < 2 or spare > 0)
