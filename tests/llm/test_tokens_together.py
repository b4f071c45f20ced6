"""Texts that are encoded together: the ids of each alone, with one look-up a distinct stretch."""

import corpus_pipeline as pipeline
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from test_tokens import PARTS, plain
from tracewright.llm import packing, tokens
from tracewright.llm.tokens import default_vocabulary, encoder


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=6))
def test_together_as_alone(texts):
    assert encoder(default_vocabulary()).encode_all(pa.array(texts, pa.string())) == [plain(t) for t in texts]


def test_texts_are_encoded_together_each_stretch_once():
    odd = [None, "", " ", "  a", "a ", "a  b", " a b", "a \nb", "it's 'tis", "a\n\nb c", " \x00 x", "x \x85y", "caf\xe9 \xdf 12ab !?", "中 a b", "a <|endoftext|> b", "a\n", "a b\n", "   q", "\xa0 a", "b \xa0c", "a’s b"]
    own = tokens.PreTokenEncoder(default_vocabulary())
    want = [plain(t) for t in odd]
    assert own.encode_all(pa.array(odd)) == want and own.encode_all(pa.array(odd).slice(3, 9)) == want[3:12]

    asked = []

    class Asked(dict):
        def __missing__(self, word):
            asked.append(word)
            return own._word(word)

    own.known = Asked()
    assert len(own.encode_all(pa.array(["one two, two, three"] * 50))) == 50 and asked.count(" two,") == 1 and asked.count(" three") == 1


def test_frequent_words_outlive_those_that_occur_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    own, made = tokens.PreTokenEncoder(default_vocabulary()), []
    make = own.known.make
    own.known.make = lambda word: made.append(word) or make(word)
    for k in range(100):
        own.encode(f"often w{k}")
    assert made.count("often") == 1 and len(own.known) + len(own.known.older) <= 20


def test_an_encoder_of_few_words_keeps_few_and_gives_the_same_ids():
    few, texts = tokens.PreTokenEncoder(default_vocabulary(), words=50), [" ".join(f"w{i * k}" for i in range(40)) for k in range(20)]
    assert few.encode_all(pa.array(texts)) == [plain(t) for t in texts]
    assert len(few.known) <= 50 and len(few.known.older) <= 50


def test_the_pipelines_packing_keeps_fewer_stretches(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(packing, "encoder", lambda *given: asked.append(given) or encoder(*given))

    class Whole:
        columns, dtypes = ["doc_id", "text"], [("doc_id", "bigint"), ("text", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):  # noqa: N802
            return list(f(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c"]})])))

    assert packing.token_pieces(Whole(), stretches=pipeline.KEPT_STRETCHES)[0].num_rows == 1
    assert encoder(*asked[0]).known.words < tokens.CACHE_WORDS
