"""URL rules, word splits and scores against plain versions."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tracewright.llm import urlfilter
from tracewright.llm.queries import URL_RULES, op6_url_filter

CASES = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q#f", "http://sub.b.com/fr/1", "http://b.com/de/", "http://com/de/x", "http://xcom/de/x", "ftp://net/a", "no scheme", "", None, "://", "x://h", "http://h?x", "http://h#/x", "a\nb://Ünï.org/é?z", "http://org/", "http://example.org", "http://u://v/w"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = min(best or (0, 0, "~", ""), (-len(rule), -len(h), rule, verdict))
    return (best[2], best[3]) if best else (None, None)


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "<p>some words</p>") for i, u in enumerate(CASES)], "page_id long, url string, html string")
    rules = [*URL_RULES, ("block", "b.com/"), ("allow", "h/"), ("block", "net/"), ("allow", "u:/")]
    got = {r.page_id: r for r in urlfilter.filter_urls(pages, rules).collect()}
    for i, u in enumerate(CASES):
        host, path = parts(u)
        rule, verdict = rule_of(host, path, rules)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_whole_query_keeps_the_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in op6_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = parts(p.url)
        rule, verdict = rule_of(host, path, URL_RULES)
        g = got[p.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule) and g.verdict == (verdict or g.verdict)
    plain = plain_verdicts(pages)
    assert {i: g.verdict for i, g in got.items() if g.rule is None} == {i: v for i, v in plain.items() if got[i].rule is None}


def plain_verdicts(pages):
    """The model in plain Python: word counts, splits, naive Bayes over distinct hosts and paths."""
    words = Counter(w for p in pages for w in re.findall(r"[^\W\d_]+", re.sub("<[^>]*>", " ", p.html).lower()))
    for w in urlfilter.BLOCKED_WORDS:
        words[w] += urlfilter.SEED_COUNT
    total, seeds = sum(words.values()), set(urlfilter.BLOCKED_WORDS)
    urls = Counter(parts(p.url) for p in pages)
    host_of = lambda h: [w for label in re.findall(r"[^\W\d_]+", h) for w in urlfilter.viterbi(label, words, total)]
    path_of = lambda q: ["0" if t.isdigit() else t for t in re.findall(r"[^\W_]+", q.lower())]
    hosts, paths = {h: host_of(h) for h, _ in urls}, {q: path_of(q) for _, q in urls}
    bad = {u: bool(seeds & {*hosts[u[0]], *paths[u[1]]}) for u in urls}
    sides = []
    for k, tokens in ((0, hosts), (1, paths)):
        n = {True: Counter(), False: Counter()}
        for u, c in urls.items():
            for t in tokens[u[k]]:
                n[bad[u]][t] += c
        known = {*n[True], *n[False]}
        size = {b: sum(n[b].values()) + urlfilter.ALPHA * (len(known) + 1) for b in n}
        sides.append({t: math.log((n[True][t] + urlfilter.ALPHA) / size[True]) - math.log((n[False][t] + urlfilter.ALPHA) / size[False]) for t in known})
    b = sum(c for u, c in urls.items() if bad[u])
    prior = math.log((b + 1) / (sum(urls.values()) - b + 1))
    score = {u: prior + sum(sides[0][t] for t in hosts[u[0]]) + sum(sides[1][t] for t in paths[u[1]]) for u in urls}
    return {p.page_id: "block" if score[parts(p.url)] > 0 else "allow" for p in pages}


def test_planted_hosts_and_no_others_are_blocked(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    judged = urlfilter.filter_urls(pages, []).select("host", "verdict").distinct().collect()
    for r in judged:
        assert r.verdict == ("block" if re.search("spam|casino|pills|bets|ads-track|adult", r.host) else "allow"), r.host


def test_words_beside_the_seeds_are_learned(spark):
    """Held-out hosts without a seed: blocked for the company their words keep, and only then."""
    html = "<p>honest news about gardens farm win today and the market place for tools</p>"
    train = [f"http://{a}{b}.net/{i}" for i, (a, b) in enumerate([("spam", "farm"), ("casino", "win"), ("poker", "win"), ("spam", "farm"), ("bets", "win")] * 6)]
    train += [f"http://{a}{b}.net/{i}" for i, (a, b) in enumerate([("garden", "news"), ("market", "place"), ("garden", "tools"), ("honest", "news")] * 30)]
    held = {"http://farmwin.net/": "block", "http://winfarm.net/x": "block", "http://gardenplace.net/": "allow", "http://newstools.net/": "allow", "http://honestgarden.net/": "allow"}
    urls = [*train, *held]
    pages = spark.createDataFrame([(i, u, html * 5 + "<p>garden spam casino poker bets</p>" * 5) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.url: r.verdict for r in urlfilter.filter_urls(pages, []).collect()}
    assert {u: got[u] for u in held} == held


def test_viterbi_is_the_best_of_all_splits():
    rng = random.Random(2)
    known = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(14)}
    total = sum(known.values())
    cost = lambda w: math.log(known[w] / total) if w in known else math.log(10 / total) - len(w) * math.log(10)
    for _ in range(200):
        label = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        splits = ([label[a:b] for a, b in zip((0, *cuts), (*cuts, len(label)))] for n in range(len(label)) for cuts in combinations(range(1, len(label)), n))
        best = max(sum(map(cost, s)) for s in splits)
        got = urlfilter.viterbi(label, known, total)
        assert "".join(got) == label and math.isclose(sum(map(cost, got)), best)


def test_run_together_names_are_split_and_blocked(spark):
    html = "<p>cheap pills and free bets but honest news about gardens today</p>"
    urls = ["http://cheappills.net/a", "http://freebets.net/", "http://gardennews.net/x", *[f"http://gardensnews{i}.net/today" for i in range(8)], "http://honestnews.net/about"]
    pages = spark.createDataFrame([(i, u, html * 20) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.url: r.verdict for r in urlfilter.filter_urls(pages, []).collect()}
    assert {u for u, v in got.items() if v == "block"} == {urls[0], urls[1]}
    words = urlfilter.segment(spark.createDataFrame([("cheappills",), ("gardensnews",)], "label string"), urlfilter.word_counts(pages, "html"))
    assert {r.label: r.words for r in words.collect()} == {"cheappills": ["cheap", "pills"], "gardensnews": ["gardens", "news"]}


def test_scores_are_naive_bayes(spark):
    df = spark.createDataFrame([("h1", ["a", "b"], 3, 0), ("h2", ["b", "b", "c"], 0, 5), ("h3", ["a"], 1, 1)], "host string, tokens array<string>, blocked long, allowed long")
    got = {r.host: float(r.score) for r in urlfilter._scores(df, "host").collect()}
    b, a = {"a": 4, "b": 3, "c": 0}, {"a": 1, "b": 10, "c": 5}
    odds = lambda t: math.log((b[t] + 0.1) / (7 + 0.4)) - math.log((a[t] + 0.1) / (16 + 0.4))
    for host, toks in (("h1", "ab"), ("h2", "bbc"), ("h3", "a")):
        assert got[host] == pytest.approx(sum(map(odds, toks)), abs=1e-6)


def test_odd_and_empty_tables(spark):
    pages = spark.createDataFrame(
        [(1, None, None), (None, "http://a/", ""), (2, "http://" + "long" * 40_000 + ".org/" + "p/" * 1000, "x"), (2, "http://a/", "y"), (2, "http://a/", "y"), (3, "http://../", "z")], "page_id long, url string, html string"
    )
    odd = pages.withColumns({c: F.lit(1) for c in ("host", "Path", "n", "words", "labels", "tokens")})
    got = urlfilter.filter_urls(odd, URL_RULES)
    assert got.count() == 6 and {r.rule for r in got.where("page_id = 2").collect()} == {"org/", None}
    assert urlfilter.filter_urls(pages.where("false"), URL_RULES).count() == 0


def plain_viterbi(label, known, total):
    """The table over all beginnings of all words, without a limit on their length."""
    best, last = [0.0], [0]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(end):
            n = known.get(label[start:end])
            options.append((best[start] + (math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)), -start))
        best.append(max(options)[0])
        last.append(-max(options)[1])
    return best[-1]


def test_words_and_labels_of_any_length(spark):
    rng = random.Random(6)
    for _ in range(60):
        known = {"".join(rng.choices("ab", k=rng.choice([1, 2, 3, 25, 40]))): rng.randint(1, 50) for _ in range(12)}
        total = 10_000
        label = "".join(rng.choice([*known, "c" * rng.randint(1, 30)]) for _ in range(rng.randint(1, 6)))
        got = urlfilter.viterbi(label, known, total)
        cost = sum(math.log(known[w] / total) if w in known else math.log(10 / total) - len(w) * math.log(10) for w in got)
        assert "".join(got) == label and abs(cost - plain_viterbi(label, known, total)) < 1e-9
    word, junk = "donaudampfschifffahrtsgesellschaft", "q" * 5000
    pages = spark.createDataFrame([(0, f"{word} casino {word}")], "page_id long, html string")
    words = urlfilter.segment(spark.createDataFrame([(f"{word}casino{junk}casino",)], "label string"), urlfilter.word_counts(pages, "html"))
    assert words.first().words == [word, "casino", junk, "casino"]
