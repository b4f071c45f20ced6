"""Words, near words, forms and roots against plain versions over all pairs."""

import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import spelling
from tracewright.llm.common import documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(docs, damage, min_length=6, min_count=5):
    words = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= min_count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(words, ratio=5):
    forms, out = {}, []
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best and words[best] >= ratio * n else None, len(around))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        out.append((w, form, root, n, forms[w][1], words[form] if form else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZé×ÿß Āñ.\t\n中1?"), max_size=60))
def test_runs(text):
    assert [r.decode("latin-1") for runs in spelling.letter_runs(text) for r in runs] == [lower(r) for r in RUN.findall(text)]


def test_runs_across_segments(monkeypatch):
    monkeypatch.setattr(spelling, "SEGMENT", 7)
    text = "a bb  cccccccccccc d é ÿÿÿÿÿÿÿÿÿÿ zz 中 e"
    assert [r.decode("latin-1") for runs in spelling.letter_runs(text) for r in runs] == RUN.findall(text)


def test_no_two_pairs_of_letters_differ_by_the_same_value():
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    assert len({b**5 - a**5 for a in letters for b in letters if a != b}) == len(letters) * (len(letters) - 1)


def test_keys_wrap_and_lose_one_letter():
    word = "\U0010ffff" * 9 + "ab"
    own, less = spelling.anagram_keys(word)
    assert -(1 << 63) <= own < 1 << 63 and less[97] == spelling.anagram_keys(word.replace("a", ""))[0]


def test_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, sf).select("doc_id", "text").collect()]
    words = spelling.word_counts(documents(spark, sf), damage=199)
    plain = counted(docs, 199)
    assert {r["word"]: r["n"] for r in words.collect()} == plain
    got = rows(spelling.spelling_variants(words))
    assert got == variants(plain) and any(r[1] for r in got)


def test_chains_ties_and_doubled_letters(spark):
    counts = {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaab": 125, "aaaaaac": 125, "aaaaaabd": 3000, "aaaaaabde": 15000, "aaaaaabdef": 80000, "baaaaa": 7, "ababab": 9, "bababa": 9, "xyzxyz": 5, "xyzxy": 24, "été中文中": 5, "ete中文中": 5, "eté中文中": 25}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling.spelling_variants(words))
    assert got == variants(counts)
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "aaaaaabdef"


def test_a_thousand_words_of_the_same_letters(spark):
    import itertools

    counts = {"".join(p): 5 + k for k, p in enumerate(itertools.permutations("abcdefg")) if k % 5 == 0}
    counts |= {w[:k] + "z" + w[k + 1 :]: 9000 + k for w in list(counts)[:40] for k in (0, 3, 6)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling.spelling_variants(words)) == variants(counts)


def test_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    for damage in (None, 3):
        words = spelling.word_counts(odd_documents, damage=damage, min_length=3, min_count=2)
        assert {r["word"]: r["n"] for r in words.collect()} == counted(docs, damage, 3, 2)
    assert rows(spelling.spelling_variants(spelling.word_counts(no_documents))) == []
