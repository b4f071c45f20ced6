"""Language identification: held-out accuracy, codes, decoding and odd inputs."""

import numpy as np
import pytest

from tracewright.llm import langid
from tracewright.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(want) and 150 < len(held) < 350
    assert np.mean([got[i].lang_pred == want[i] for i in held]) >= 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_and_labels_are_never_looked_at(spark, sf):
    from pyspark.sql import functions as F

    docs = documents(spark, sf)
    a = langid.identify_languages(docs)
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(a.collect()) == sorted(langid.identify_languages(wrong).collect())


def test_held_out_is_the_remainder_of_the_id_s_checksum(spark, sf):
    import zlib

    for r in langid.identify_languages(documents(spark, sf)).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 12, 30])
def test_codewords_differ_and_split(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n and (abs(code.sum(axis=0)) < n).all()
    apart = min((a != b).sum() for k, a in enumerate(code) for b in code[:k])
    assert apart >= 1 if n == 2 else apart >= code.shape[1] // 4


def test_decoding_is_the_least_weighted_loss():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (3, langid.DIMS)).astype(float)
    model = langid._model(["a", "b", "c"], counts)
    assert np.allclose(model.trust.sum(axis=1), 1)
    text = "some words of no language at all"
    grams = langid.ngram_counts(text)
    margin = grams @ model.weights / grams.sum() / model.scale
    loss = [sum(t * np.log1p(np.exp(-2 * c * m)) for t, c, m in zip(model.trust[k], model.code[k], margin)) for k in range(3)]
    assert model.predict(text)[0] == "abc"[int(np.argmin(loss))]


def test_equal_losses_are_ambiguous():
    counts = np.ones((2, langid.DIMS))
    counts[0, :10] += 1e-3
    model = langid._model(["a", "b"], counts)
    model.weights[:] = 0
    assert model.predict("anything")[2] is True


def test_ngrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Ein längerer Text, mit Zahlen 123 und Zeichen!? " * 30
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 17)
    assert (langid.ngram_counts(text) == whole).all() and langid.ngram_counts("123 ...") is None and langid.ngram_counts(None) is None


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    got = langid.identify_languages(odd_documents).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[i].lang_pred for i in (1, 2, 5, 6)} == {"und"} and by[4].lang_pred in ("de", "en", "fr")
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert langid.identify_languages(no_documents).count() == 0
    kept = langid.keep_identified(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == 7
    assert langid.keep_identified(no_documents).count() == 0


def test_no_labels_and_one_label(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "abd", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify_languages(df).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc def", "en") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify_languages(one).collect()} == {("en", 1.0)}
