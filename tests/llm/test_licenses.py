"""Licence scans against a brute-force version without anchors or joins."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tracewright.llm import licenses
from tracewright.llm.common import documents


def brute(files, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """(path, own, score, licence, from, levels) of each row of (path, text)."""
    vocabulary = {t for _, x in templates for t in licenses.tokens(x)}
    df = Counter(t for _, x in files for t in set(licenses.tokens(x or "")) & vocabulary)
    idf = {t: math.log((len(files) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    rarest = max(idf.values())

    def vector(text):
        w = {t: c * idf.get(t, rarest) for t, c in Counter(licenses.tokens(text)).items()}
        return w, math.sqrt(sum(x * x for x in w.values()))

    shown = [(name, *vector(x)) for name, x in templates]
    own, near = {}, {}
    for path, text in files:
        if text is None or path is None:
            continue
        units = re.split("\r?\n", text) + [p for p in re.split(r"\r?\n[^\w\n]*\n", text) if "\n" in p]
        if re.search(licenses.LICENSE_FILE, path.rsplit("/", 1)[-1]):
            units.append(text)
        for u in units:
            w, norm = vector(u)
            for name, t, size in shown:
                cos = round(sum(x * t.get(k, 0) for k, x in w.items()) / (norm * size), 6) if norm else 0
                if cos >= threshold and (len(t) > 4 or set(t) <= set(w)):
                    own[path] = min(own.get(path, (0, "")), (-cos, name))
                    near.setdefault(path, set()).add(name)
    for path, names in near.items():
        if own[path][1] == "BSD-2-Clause" and "BSD-3-Clause" in names:
            own[path] = (own[path][0], "BSD-3-Clause")
    parent = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    given = {}
    for path, best in own.items():
        if re.search(licenses.LICENSE_FILE, path.rsplit("/", 1)[-1]):
            given[parent(path)] = min(given.get(parent(path), (0, "")), best)
    out = []
    for path, _ in files:
        if path in own:
            out.append((path, own[path][1], -own[path][0], own[path][1], None, 0))
            continue
        at, levels = (parent(path), 1) if path is not None else (None, 0)
        while at is not None and at not in given:
            at, levels = (parent(at), levels + 1) if at else (None, levels)
        out.append((path, None, None, given[at][1] if at is not None else None, at, levels if at is not None else None))
    return out


def key(rows):
    return sorted(map(repr, rows))


def rows(df):
    return [(r.path, r.own_license, None if r.own_score is None else round(r.own_score, 5), r.license, r.inherited_from, r.levels) for r in df.collect()]


def near(rows):
    return key((*r[:2], None if r[2] is None else round(r[2], 5), *r[3:]) for r in rows)


def test_documents_equal_brute_force(spark):
    files = licenses.document_files(documents(spark, "/root/testdata/sf0.01")).select("path", "text")
    want = brute([(r.path, r.text) for r in files.collect()])
    assert near(rows(licenses.scan_licenses(files))) == near(want)
    assert sum(w[1] is not None for w in want) > 30


def test_trees_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [t for _, t in licenses.TEMPLATES]
    files = []
    for _ in range(150):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
        name = rng.choice(["LICENSE", "license.txt", "COPYING", "Notice-x", "x.py", "y.py", "licenser.py"])
        body = rng.choice(["code here", "", "\n".join(rng.sample(texts, 2)), "# " + rng.choice(texts) + "\ncode", rng.choice(texts)[:30], rng.choice(texts).replace(" ", "\n")])
        files.append((f"{folder}/{name}" if folder else name, body))
    files = list(dict(files).items())
    df = spark.createDataFrame(files, "path string, text string")
    assert near(rows(licenses.scan_licenses(df))) == near(brute(files))


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    text = licenses.TEMPLATES[0][1]
    files = [(None, text), ("a/LICENSE", None), ("a/b", ""), ("LICENSE", text), ("LICENSE", text), ("/LICENSE", text), ("/x/y", "z" * 2_000_000), ("q", "\n" * 50_000)]
    df = spark.createDataFrame(files, "path string, text string").withColumns({c: F.lit(1) for c in ("u", "unit", "license", "token", "dir")})
    got = licenses.scan_licenses(df).collect()
    assert len(got) == 8
    by = {r.path: r for r in got}
    assert (by["a/b"].license, by["a/b"].inherited_from, by["a/b"].levels) == ("Apache-2.0", "", 2)
    assert by["LICENSE"].own_license == "Apache-2.0" and by["/x/y"].license == "Apache-2.0" and by["q"].levels == 1
    assert licenses.document_licenses(odd_documents).count() == 12
    assert licenses.document_licenses(no_documents).count() == 0
    assert licenses.scan_licenses(df, templates=[]).where("license is not null").count() == 0


def test_query_equals_sql(spark):
    from compare import assert_same, database

    from tracewright.llm import queries

    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert_same(queries.op2_licenses(spark, sf).toPandas(), database(sf).execute(licenses.SQL).df())


GPL = """/*
 * A tool.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 */
int main() { return 0; }
"""


def test_standard_headers_and_files(spark):
    mit = next(t for lic, t in licenses.TEMPLATES if lic == "MIT" and "sublicense" in t)
    files = {
        "a/tool.c": GPL, "b/COPYING": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989\n Everyone is permitted to copy",
        "b/src/x.py": "print(1)", "c/LICENSE": f"The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n{mit}\n", "c/y.py": "", "d/LICENSE": "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS",
        "e/z.rs": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n\nfn main() {}",
        "f/LICENSE": "                   GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n", "g/none.txt": "free software that anyone may publish and the license of a library",
    }
    got = {r.path: r.license for r in licenses.scan_licenses(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    want = {"a/tool.c": "GPL-3.0", "b/COPYING": "GPL-2.0", "b/src/x.py": "GPL-2.0", "c/LICENSE": "MIT", "c/y.py": "MIT", "d/LICENSE": "Apache-2.0", "e/z.rs": "MPL-2.0", "f/LICENSE": "AGPL-3.0", "g/none.txt": None}
    assert got == want


def test_ids_travel_with_their_rows(spark):
    rows = [(i, "Licensed under CC BY 4.0." if i == 50 else "text", "en", "s") for i in (-50, 50, -3, 3)]
    got = {r.doc_id: r.own_license for r in licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {-50: None, 50: "CC-BY-4.0", -3: None, 3: None}


BSD = """Copyright (c) 2020, someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

2. Redistributions in binary form must reproduce the above copyright notice.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_titles_and_clauses(spark):
    """A title alone gives the licence, also where its words are common; a part of it doesn't; the third clause decides."""
    german = [(f"de/{k}.txt", f"Wir gehen mit dem Hund und mit der Katze the License {k}\nThe License\nLicense\nmit") for k in range(30)]
    files = [
        ("a/LICENSE", "The MIT License (MIT)\n\nhttps://example.org/mit"), ("b/LICENSE", "MIT License"), ("b/x.py", "# The MIT License (MIT)\nx = 1"), ("c/LICENSE", BSD), ("d/LICENSE", BSD + THIRD),
        ("e/LICENSE", "BSD 2-Clause License"), ("f/LICENSE", "BSD 3-Clause License\n" + BSD), ("g/LICENSE", "The License"), *german,
    ]
    got = rows(licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")))
    assert near(got) == near(brute(files))
    own = {p: o for p, o, *_ in brute(files)}
    assert [own[f"{x}"] for x in ("a/LICENSE", "b/LICENSE", "b/x.py", "c/LICENSE", "d/LICENSE", "e/LICENSE", "f/LICENSE", "g/LICENSE", "de/0.txt")] == ["MIT", "MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause", None, None]
