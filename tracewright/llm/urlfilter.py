"""URL filters: rules by longest match, else words of the host and path under naive Bayes.

Host names run words together. A unigram Viterbi search splits each stretch of letters into the
likeliest words; the word counts come from the pages themselves and meet the hosts in a join, so
the vocabulary is never sent to every task. A multinomial naive Bayes model then scores the
words of host and path. Its examples are all URLs: those with one of a few seed words are to be
blocked, the others unlabelled and taken as allowed, as in learning from positive examples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Words of hosts or paths that mark an example as one to block. They are few and only
#: seeds: the model weighs every word by the company it keeps, so that hosts without any of them are
#: blocked for words that stand mostly beside them (farm beside spam), and kept for those that don't.
BLOCKED_WORDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "keygen", "lottery", "payday", "pills", "poker", "porn", "spam", "viagra", "warez",
)
#: Count given to each of these words, so that a split can find them.
SEED_COUNT = 100
#: Added to every count of a word in a class.
ALPHA = 0.1
#: Stretches of labels that a task passes on at a time.
SPANS = 50_000
#: Parts into which the paths of one host are dealt where they meet what is known of it.
SALTS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _with_host(urls: DataFrame, hosts: DataFrame, how: str = "inner") -> DataFrame:
    """``urls`` (``host``, ``path``) joined with a row for each host, which is repeated for each salt: a host with
    a third of all URLs spreads over several tasks."""
    left = urls.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    right = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["host", "_salt"], how).drop("_salt")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (``host``, ``path``) with ``rule`` and ``rule_verdict``, null where none fits.

    ``rules``: ``(rule, verdict)``; a rule is a host, then ``/`` and the beginning of a path. It
    fits its host and all subdomains of it. The longest rule wins, then the longest host, then the
    first in order. Rules meet distinct hosts by an equi-join on every suffix of a host, so that
    their number may grow.
    """
    parsed = rules.where("rule is not null").select(
        "rule", F.col("verdict").alias("rule_verdict"), F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER).alias("suffix")
    )
    parsed = parsed.withColumn("prefix", F.expr("substring(rule, length(suffix) + 1)"))
    hosts = urls.select("host").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = hosts.select("host", F.explode(suffixes).alias("suffix")).join(parsed, "suffix")
    fits = fits.groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("a"), (-F.length("suffix")).alias("b"), "rule", "rule_verdict", "prefix"))).alias("fits")
    )
    joined = _with_host(urls, fits, "left")
    first = F.element_at(F.filter("fits", lambda r: F.col("path").startswith(r["prefix"])), 1)
    first = F.when(F.size(F.filter("fits", lambda r: F.col("path").startswith(r["prefix"]))) > 0, first)
    return joined.withColumn("_rule", first).select(*urls.columns, F.col("_rule.rule").alias("rule"), F.col("_rule.rule_verdict").alias("rule_verdict"))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` of lower-cased runs of letters outside tags, over all rows, and the seed words."""
    plain = F.lower(F.regexp_replace(F.col(text), "<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, "[^\\p{L}]+")).alias("word")).where("word <> ''")
    seeds = texts.sparkSession.createDataFrame([(w, SEED_COUNT) for w in BLOCKED_WORDS], "word string, n long")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, known: dict[str, int], total: int) -> list[str]:
    """The split with the highest product of word shares; unknown words, of any length, cost more the longer they are.

    On a tie the split whose last word is longest is taken. The best beginning of an unknown word is the
    same for all its ends but for a constant, so one running maximum finds it (a known word costs no more than
    it would unknown), and a label costs its length times the number of lengths that its known words have.
    """
    lengths = sorted({len(w) for w in known}, reverse=True)
    letter, unknown = math.log(10), math.log(10 / total)
    best, last = [0.0], [0]
    ahead, begin = 0.0, 0  # the largest of best[start] + start * letter
    for end in range(1, len(label) + 1):
        score, at = ahead + unknown - end * letter, begin
        for n in lengths:
            word = label[end - n : end] if n <= end else ""
            if n <= end and word in known:
                cost = best[end - n] + math.log(known[word] / total)
                if cost > score or (cost == score and end - n < at):
                    score, at = cost, end - n
        best.append(score)
        last.append(at)
        if score + end * letter > ahead:
            ahead, begin = score + end * letter, end
    words, end = [], len(label)
    while end:
        words.append(label[last[end] : end])
        end = last[end]
    return words[::-1]


def segment(labels: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``(label, words)`` for distinct non-empty ``label``s.

    Labels are cut into stretches of those lengths only that some word has, however long.
    """
    total, lengths = unigrams.agg(F.sum("n"), F.array_sort(F.collect_set(F.length("word")))).first()
    total = total or 1

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, words = [], []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(words, pa.string())], names=["number", "word"])

        for batch in slices(batches):
            for number, label in zip(batch.column("number").to_pylist(), batch.column("label").to_pylist()):
                for n in lengths:
                    found = {label[k : k + n] for k in range(len(label) - n + 1)}
                    numbers += [number] * len(found)
                    words += found
                    if len(words) > SPANS:
                        yield rows()
                        numbers, words = [], []
        yield rows()

    # rows of stretches carry the label's number, as a label may be very long
    labels = materialize(labels.select("label").withColumn("number", F.monotonically_increasing_id()), "labels")
    parts = labels.mapInArrow(spans, "number long, word string")
    known = parts.join(unigrams, "word").groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    known = labels.join(known, "number", "left")

    @F.arrow_udf("array<string>")
    def split(names: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([viterbi(a.as_py(), dict(k.as_py() or ()), total) for a, k in zip(names, words)], pa.list_(pa.string()))

    return known.select("label", split("label", "known").alias("words"))


def _labels(host: Column) -> Column:
    """Runs of letters of a host."""
    return F.filter(F.split(host, "[^\\p{L}]+"), lambda x: x != "")


def _path_tokens(path: Column) -> Column:
    """Runs of letters and digits of a path, lower-cased; numbers are one token."""
    runs = F.filter(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return F.transform(runs, lambda x: F.when(x.rlike("^\\p{N}+$"), F.lit("0")).otherwise(x))


def _scores(tokens: DataFrame, key: str) -> DataFrame:
    """Log odds of blocking by ``key`` from ``(key, tokens, blocked, allowed)`` under naive Bayes."""
    each = tokens.select(key, F.explode("tokens").alias("token"), "blocked", "allowed")
    counts = each.groupBy("token").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    size = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    b, a, v = (float(x or 0) for x in size)
    odds = F.log((F.col("b") + ALPHA) / F.lit(b + ALPHA * (v + 1))) - F.log((F.col("a") + ALPHA) / F.lit(a + ALPHA * (v + 1)))
    table = counts.select("token", odds.alias("odds"))
    # decimals add up to the same in any order
    return each.select(key, "token").join(table, "token").groupBy(key).agg(F.sum(F.col("odds").cast("decimal(20,10)")).alias("score"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", text: str = "html") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``, one row for each row.

    Null URLs and texts without ``://`` have empty host and path. ``verdict`` is the rule's, or
    ``block`` if the score (log odds) is above 0, else ``allow``; an URL without tokens has the
    score of the prior alone. Host and path are split, counted and scored once each however many
    rows share them. Input columns called like one of the five, in any case, are replaced by it.
    """
    spark = pages.sparkSession
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "score")]
    table = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    rows = pages.select(*own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    hosts = urls.select("host").distinct().withColumn("labels", _labels(F.col("host")))
    labels = hosts.select(F.explode("labels").alias("label")).distinct()
    words = segment(labels, materialize(word_counts(pages, text), "unigrams"))
    split = hosts.select("host", F.posexplode("labels").alias("k", "label")).join(words, "label")
    split = split.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda x: x["words"])).alias("host_tokens"))
    hosts = hosts.select("host").join(split, "host", "left").withColumn("host_tokens", F.coalesce("host_tokens", F.array().cast("array<string>")))
    seeds = F.array(*[F.lit(w) for w in BLOCKED_WORDS])
    urls = _with_host(urls, hosts).withColumn("path_tokens", _path_tokens(F.col("path")))
    bad = F.arrays_overlap("host_tokens", seeds) | F.arrays_overlap("path_tokens", seeds)
    urls = urls.withColumns({"blocked": F.when(bad, F.col("n")).otherwise(0), "allowed": F.when(bad, 0).otherwise(F.col("n"))})
    urls = materialize(urls, "urls")
    by_host = urls.groupBy("host").agg(F.first("host_tokens").alias("tokens"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    by_path = urls.groupBy("path").agg(F.first("path_tokens").alias("tokens"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    sums = urls.agg(F.sum("blocked"), F.sum("allowed")).first()
    prior = math.log(((sums[0] or 0) + 1) / ((sums[1] or 0) + 1))
    scored = _with_host(match_rules(urls.select("host", "path"), table), _scores(by_host, "host").withColumnRenamed("score", "host_score"), "left")
    scored = scored.join(_scores(by_path, "path").withColumnRenamed("score", "path_score"), "path", "left")
    total = F.lit(prior) + F.coalesce("host_score", F.lit(0)).cast("double") + F.coalesce("path_score", F.lit(0)).cast("double")
    scored = scored.withColumn("score", total)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    scored = scored.select("host", "path", "rule", verdict.alias("verdict"), "score")
    return rows.join(scored, ["host", "path"]).select(*own, "host", "path", "rule", "verdict", "score")
