"""The pipeline's stages, each against a brute-force version of its own decision."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from test_decontaminate import edit_rows
from test_similar import brute_kept
from tracewright.llm import decontaminate as dec
from tracewright.llm import langid, packing
from tracewright.llm.common import documents, materialize


def test_stages_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [dec.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        got = [r.doc_id for r in docs.collect()]
        if name == "language":
            want = {i for i, t in kept.items() if any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            want = brute_kept(kept.items())
        else:
            want = {i for i, t in kept.items() if not any(item and min(edit_rows(item, dec.words(t))) <= int(dec.RATE * len(item)) for item in bench)}
        assert len(got) == len(set(got)) and set(got) == want, name
        kept = {i: kept[i] for i in want}
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == set(kept) and sorted(last) == sorted(packing.pack_documents(docs).collect())
    lengths = {}
    for r in last:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert max(lengths.values()) <= 2048
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)


def test_odd_and_empty_tables(spark, sf, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = materialize(stage(spark, docs, sf), "odd")
            assert docs.columns == columns
        pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_without_labels_every_text_with_a_letter_stays(spark):
    rows = [(1, "the quick brown fox", None), (2, "le renard brun et rapide", None), (3, "123 !!", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = pipeline.identify_language(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == docs.columns


def test_the_prediction_fills_missing_languages(spark, sf):
    docs = documents(spark, sf)
    known = {r.doc_id: r.lang for r in docs.collect()}
    bare = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    kept = pipeline.identify_language(spark, bare, sf).collect()
    assert all(r.lang is not None for r in kept)
    missing = [r for r in kept if r.doc_id % 5 == 0]
    assert sum(r.lang == known[r.doc_id] for r in missing) >= 0.95 * len(missing)
    some = langid.keep_identified(bare, ["en"]).collect()
    assert {r.doc_id for r in some} < {r.doc_id for r in kept} and sum(known[r.doc_id] == "en" for r in some) >= 0.95 * len(some)
