"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so that a letter more, less or exchanged
changes the key by a value that letters alone decide. Words whose keys differ by such a value meet
in a join on integers; the order of their letters is checked where they meet.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, slices

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form must occur so many times as often as its variant.
RATIO = 5
#: A letter's value is its code point to this power; no two pairs of letters are known to differ by the same value.
POWER = 5
#: Bytes of a text that are split into runs at a time, and distinct words that a task counts before it passes them on.
SEGMENT, KEPT_WORDS = 1 << 22, 200_000

#: Latin-1 bytes: A-Z in lower case, other letters as they are, all else a blank.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def letter_runs(text: str) -> Iterator[list[bytes]]:
    """All runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text in Latin-1, A-Z lower-cased, some at a time."""
    data = text.encode("latin-1", "replace").translate(_RUNS)  # what Latin-1 lacks becomes "?", hence a blank
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT) if len(data) - at > SEGMENT else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _damaged(run: bytes, before: int, damage: int) -> bytes:
    """``run`` without one letter where ``damage`` divides the hash of its document's id and itself."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % damage:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """``(word, n)``: letter runs of all texts with at least so many letters and occurrences.

    Null and empty texts have none; repeated rows count each. ``damage`` deletes a letter of those
    runs where it divides the crc32 of ``<doc_id>:<run>`` (a null id is empty there), to plant
    misspellings whose form is known. Tasks count before words are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for key, t in zip(batch.column("id"), batch.column("text")):
                key, t = key.as_py(), t.as_py()
                before = zlib.crc32(f"{'' if key is None else key}:".encode())
                for runs in letter_runs(t or ""):
                    for run, n in Counter(runs).items():
                        if len(run) >= min_length:
                            word = _damaged(run, before, damage) if damage else run
                            if len(word) >= min_length:
                                total[word] += n
                    if len(total) > KEPT_WORDS:
                        yield rows()
                        total.clear()
        yield rows()

    found = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def anagram_keys(word: str) -> tuple[int, dict[int, int]]:
    """The key of a word (modulo 2^64, signed) and, by each of its letters, the key without that letter."""
    signed = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    letters = [ord(c) for c in word]
    key = sum(c**POWER for c in letters)
    return signed(key), {c: signed(key - c**POWER) for c in letters}


_KEYED = "word string, n long, letter int, value long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of letter 0 with the word's own key, and one for each letter with the key that is left without it."""
    for batch in slices(batches, 4096):
        source, letter, value = [], [], []
        for i, word in enumerate(batch.column("word").to_pylist()):
            own, less = anagram_keys(word)
            source += [i] * (len(less) + 1)
            letter += [0, *less]
            value += [own, *less.values()]
        at = pa.array(source, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("word").take(at), batch.column("n").take(at), pa.array(letter, pa.int32()), pa.array(value, pa.int64())], names=["word", "n", "letter", "value"])


def _halved(keyed: DataFrame, length, side: str) -> DataFrame:
    """Each key twice: with its word's first half and its last, where ``length`` letters remain once the edit is undone."""
    half = F.floor(length / 2).cast("int")
    order = F.explode(F.array(F.xxhash64(length, F.lit(0), F.left("word", half)), F.xxhash64(length, F.lit(1), F.right("word", length - half))))
    return keyed.select("value", order.alias("half"), *[F.col(c).alias(f"{c}_{side}") for c in ("word", "n", "letter")])


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``: each word of ``words`` (word, n) with each word one letter away, in both directions.

    A longer word less one letter meets the own keys: an addition or a removal. Two words less one
    letter each meet where the exchange of those letters takes one key to the other; a pair meets
    once, in the order of the letters. As an edit leaves one half of a word as it was, the order of
    a half's letters is part of the join, so that the many words of the same letters don't all meet.
    """
    keyed = materialize(words.select("word", "n").mapInArrow(_keyed, _KEYED), "keys")
    own, less, n = keyed.where("letter = 0"), keyed.where("letter > 0"), F.char_length("word")
    longer = _halved(less, n - 1, "a").join(_halved(own, n, "b"), ["value", "half"])
    exchanged = _halved(less, n, "a").join(_halved(less, n, "b"), ["value", "half"]).where("letter_a < letter_b")
    met = longer.union(exchanged).where(F.levenshtein("word_a", "word_b", 1) == 1)
    pairs = materialize(met.select("word_a", "n_a", "word_b", "n_b").distinct(), "near", instead=keyed)
    there = pairs.select(F.col("word_a").alias("word"), F.col("word_b").alias("near"), F.col("n_b").alias("near_n"))
    return there.union(pairs.select(F.col("word_b").alias("word"), F.col("word_a").alias("near"), F.col("n_a").alias("near_n")))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of ``words`` (word, n), words being distinct.

    The form of a word is the near word of largest n, the first in code-point order on a tie, if it
    occurs ``ratio`` times as often; the root is where forms lead. As n grows by ``ratio`` with each
    form, there is no circle, and a chain's length is bounded by the logarithm of the largest n: so
    many rounds double the forms' reach. Words without a near one have n_near 0 and are their own root.
    """
    if ratio < 2:
        raise ValueError("forms lead to a root only where they occur more often than their variants")
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    found = materialize(found, "forms")
    roots = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    spread = words.agg(F.max("n"), F.min("n")).first()
    steps = math.log(max(spread[0] or 1, 1) / max(spread[1] or 1, 1), ratio) + 1
    for _ in range(math.ceil(math.log2(steps + 1))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = materialize(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots", instead=roots)
    discard(words)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
