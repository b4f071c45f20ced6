"""Language identification by error-correcting output codes over letter n-grams.

Each language has a codeword; one binary classifier for each bit tells, from hashed letter
n-grams, the languages whose bit is 1 from the others. A text's margins are decoded with loss
weights: a language's loss is the logistic loss of its bits' margins, weighted by how well each
bit's classifier separates that language. The nearest codeword wins; texts whose two nearest
codewords are about equally near are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Buckets of hashed bigrams and trigrams. A documented bound of the model, as are its languages.
DIMS = 1 << 13
#: Up to so many languages, every split of them into two sets is a bit of the code.
EXHAUSTIVE = 6
UNDETERMINED = "und"
#: More distinct labels than this are an error: a column of free text is not one of languages.
MAX_LANGUAGES = 1000
#: A text is ambiguous if the losses of its two nearest codewords differ by less.
MARGIN = 0.02
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter bigrams and trigrams; None without any letter.

    Texts are lower-cased and each run of other characters counts as one space. Long texts are
    taken in pieces that overlap by two characters, so every n-gram counts once.
    """
    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return None
    a = np.where(letter, a, np.uint32(32))
    a = a[letter | np.concatenate(([True], letter[:-1]))]
    a = np.concatenate((np.array([32], np.uint32), a, np.array([32], np.uint32)))
    total = np.zeros(DIMS, np.int64)
    for k in range(0, len(a) - 2, _CHUNK):
        p = a[k : k + _CHUNK + 2]
        pair = p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA77)
        triple = (pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + p[2:] * np.uint32(0x27D4EB2F)
        for h in (pair * np.uint32(0x165667B1), triple):
            total += np.bincount((h ^ (h >> np.uint32(13))) >> np.uint32(19), minlength=DIMS)
    return total


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 for each language: all splits if few, else fixed pseudo-random ones."""
    if languages <= 1:
        return np.zeros((languages, 0))
    if languages <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (languages - 1))
        rows = [np.ones(len(bits))] + [np.where(bits >> k & 1, -1.0, 1.0) for k in range(languages - 1)]
        return np.stack(rows)
    rng, width = np.random.default_rng(7), 10 * int(np.ceil(np.log2(languages)))
    while True:
        code = rng.choice([-1.0, 1.0], (languages, width))
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        if (apart + width * np.eye(languages)).min() >= width // 4 and (abs(code.sum(axis=0)) < languages).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIMS x bits: log odds of an n-gram
    scale: np.ndarray  # bits: mean expected margin
    trust: np.ndarray  # languages x bits: loss weights, rows sum to 1

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, ambiguous. Without a letter, or a model: und, 0, False."""
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = counts @ self.weights / counts.sum() / self.scale
        loss = (self.trust * np.logaddexp(0.0, -2.0 * self.code * margin)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        chance = np.exp(-4.0 * (loss - loss[order[0]]))
        return self.languages[order[0]], float(1 / chance.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN)


def _model(languages: list[str], counts: np.ndarray) -> Model:
    code = codewords(len(languages))
    if len(languages) < 2:  # nothing to tell apart
        return Model(languages, code, np.zeros((DIMS, 0)), np.zeros(0), code)
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((DIMS, code.shape[1]))
    for b in range(code.shape[1]):
        one = code[:, b] > 0
        weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
    expected = code * (share @ weights)
    trust = np.maximum(expected, 1e-6)
    return Model(languages, code, weights, np.maximum(expected.mean(axis=0), 1e-6), trust / trust.sum(axis=1, keepdims=True))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on every row with a text and a language.

    Each task adds up its n-gram counts by language and emits one row for each count; the driver
    receives their sums, DIMS rows a language and ``MAX_LANGUAGES`` languages at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column("text"), batch.column("lang").to_pylist()):
                found = ngram_counts(t.as_py())
                if found is not None:
                    total[name] = total.get(name, 0) + found
        for name, found in total.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(found[at])], names=["lang", "gram", "n"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sums = materialize(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    languages = sorted(r["lang"] for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct languages in {lang!r}")
    sums = sums.collect()
    counts = np.zeros((len(languages), DIMS))
    place = {name: k for k, name in enumerate(languages)}
    for r in sums:
        counts[place[r["lang"]], r["gram"]] = r["n"]
    return _model(languages, counts)


def with_language(docs: DataFrame, model: Model, text: str = "text", out: str = "_language") -> DataFrame:
    """``docs`` with a struct ``(lang_pred, score, ambiguous)``; only the text is looked at."""

    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        names, scores, flags = zip(*found) if found else ((), (), ())
        arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())]
        return pa.StructArray.from_arrays(arrays, names=["lang_pred", "score", "ambiguous"])

    # as an undeterministic function it is evaluated once, however often its result is used
    return docs.withColumn(out, predict.asNondeterministic()(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Rows to learn from: a language, an id, and not held out."""
    return docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))


def identify_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` for every document.

    Null texts and texts without a letter are ``und`` with score 0; so is everything where there
    is no labelled row. Repeated rows each get a row; other columns are ignored.
    """
    model = train(training_rows(docs))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.*")


def keep_identified(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """``docs`` without rows of undetermined language, and with the predicted one where ``lang`` is null.

    ``languages`` names the ones to keep by prediction; None keeps all. Ambiguous texts stay: they
    are language too. Where no row has a label, nothing can be learned: then every text with a letter
    stays, whatever ``languages`` says, and labels stay null. With one label, all such texts are of it.
    """
    model = train(training_rows(docs))
    # rows travel as one struct, so further columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    if not model.languages:
        return rows.where(has_letter("text")).select("row.*")
    found = with_language(rows, model)
    found = found.where(F.col("_language.lang_pred") != UNDETERMINED)
    if languages is not None:
        found = found.where(F.col("_language.lang_pred").isin(*languages))
    filled = F.coalesce(F.col("row.lang"), F.col("_language.lang_pred"))
    return found.select(*[filled.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def has_letter(text: str) -> Column:
    """Whether a text has a letter by the same rule as the model's n-grams."""

    @F.arrow_udf("boolean")
    def letters(texts: pa.Array) -> pa.Array:
        return pa.array([any(c.isalpha() for c in t.as_py() or "") for t in texts], pa.bool_())

    return letters(F.col(text))
