"""License scans: TF-IDF cosine of headers and licence files to templates, inherited by directory.

A file's units are its lines and its paragraphs, and all of it if its name says licence file. Lines
without a letter or digit, such as the ``*`` of a comment block, end a paragraph as blank ones do. The
unit nearest to a template, in sparse TF-IDF cosine at or above the threshold, gives the file's
own licence. A file without one inherits from the licence files of its nearest ancestor directory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

THRESHOLD = 0.8
#: Notices, titles and standard headers of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    # titles of whole licence files
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    # standard headers and paragraphs
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
#: Fixed value: a licence whose text is the beginning of another's; a file with units near both has the longer one.
LONGER = {"BSD-2-Clause": "BSD-3-Clause"}
#: Distinct words up to which a template must be held whole: too few to be told from a line that lacks the one that matters.
WHOLE_WORDS = 4
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([._-].*)?$"
_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def document_frequencies(files: DataFrame, vocabulary: Sequence[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Files and, for each word of the templates, the files that hold it; over all whole texts."""
    held = F.array_intersect(_tokens(F.col(text)), F.array(*[F.lit(w) for w in vocabulary]))
    rows = files.select(F.explode(F.array_union(F.coalesce(held, F.array().cast("array<string>")), F.array(F.lit("")))).alias("t"))
    found = {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def _weights(templates: Sequence[tuple[str, str]], n: int, df: dict[str, int]) -> tuple[dict[str, float], list[tuple[str, int, dict[str, float]]]]:
    """Smoothed idf by word, and each template's words with weights of norm 1."""
    vocabulary = sorted({t for _, text in templates for t in tokens(text)})
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    out = []
    for k, (name, text) in enumerate(templates):
        w = {t: c * idf[t] for t, c in Counter(tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        if norm:
            out.append((name, k, {t: x / norm for t, x in w.items()}))
    return idf, out


def _anchors(weighted: list[tuple[str, int, dict[str, float]]], threshold: float) -> list[str]:
    """Words of which every unit that a template can fit has one.

    For each template, heaviest words first until the rest has a norm below the threshold: a unit
    with none of them has a cosine below that norm. They are the fewest words that do. Of a template
    that must be held whole, the heaviest word is enough.
    """
    found = set()
    for _, _, w in weighted:
        rest = 1.0
        for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
            if math.sqrt(max(rest, 0)) < threshold - 1e-9:
                break
            found.add(t)
            rest = 0 if len(w) <= WHOLE_WORDS else rest - x * x
    return sorted(found)


def _may_fit(tokens: Column, weighted: list[tuple[str, int, dict[str, float]]], threshold: float) -> Column:
    """Whether a unit holds enough of some template.

    A cosine is at most the norm of those weights of the template whose words the unit has, whatever else it
    holds: all the words of a template together decide, so a single common one lets no unit through.
    """
    if not weighted:
        return F.lit(False)
    held = F.array_intersect(tokens, F.array(*[F.lit(t) for t in sorted({t for _, _, w in weighted for t in w})]))

    def of(w: dict[str, float]) -> Column:
        least = 1 - 1e-9 if len(w) <= WHOLE_WORDS else threshold * threshold - 1e-9
        words = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(x * x).alias("m")) for t, x in w.items()])
        return F.struct(words.alias("words"), F.lit(least).alias("least"))

    def fits(h: Column, t: Column) -> Column:
        return F.aggregate(t["words"], F.lit(0.0), lambda m, x: m + F.when(F.array_contains(h, x["t"]), x["m"]).otherwise(0.0)) >= t["least"]

    shapes = F.array(*[of(w) for _, _, w in weighted])
    return F.exists(F.array(held), lambda h: F.exists(shapes, lambda t: fits(h, t)))


def own_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, license, score)`` of the files that have a unit near a template.

    ``templates`` is a list of (licence, text), the query set, of bounded size. Words outside it
    weigh as its rarest word. A line that many files share is compared once. Ties go to the
    licence that is first in order. Null and empty texts have no units. A template of up to four
    distinct words, a title, must be held whole. A file with units near the two-clause text and the
    third clause has the three-clause licence.
    """
    spark = files.sparkSession
    n, df = document_frequencies(files, sorted({t for _, x in templates for t in tokens(x)}), text)
    idf, weighted = _weights(templates, n, df)
    rarest = max(idf.values(), default=1.0)
    anchors = F.array(*[F.lit(t) for t in _anchors(weighted, threshold)])
    name = F.substring_index(F.col(path), "/", -1)
    whole = F.when(name.rlike(LICENSE_FILE), F.array(F.col(text))).otherwise(F.array().cast("array<string>"))
    paragraphs = F.filter(F.split(F.col(text), r"\r?\n[^\p{L}\p{N}\n]*\n"), lambda p: p.contains("\n"))
    units = F.concat(F.split(F.col(text), r"\r?\n"), paragraphs, whole)
    rows = files.select(F.col(path).alias("path"), F.explode(units).alias("unit"))
    rows = rows.where(F.arrays_overlap(_tokens(F.col("unit")), anchors)).where(_may_fit(_tokens(F.col("unit")), weighted, threshold))
    rows = materialize(rows.withColumn("u", F.sha2(F.col("unit"), 256)), "units")
    distinct = rows.groupBy("u").agg(F.first("unit").alias("unit"))
    idf_rows = spark.createDataFrame(list(idf.items()), "token string, idf double")
    tmpl = spark.createDataFrame([(t, lic, k, x, len(w) if len(w) <= WHOLE_WORDS else 0) for lic, k, w in weighted for t, x in w.items()], "token string, license string, template int, w double, least int")
    tf = distinct.select("u", F.explode(_tokens(F.col("unit"))).alias("token")).groupBy("u", "token").agg(F.count("*").alias("tf"))
    tf = tf.join(idf_rows, "token", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    norms = tf.groupBy("u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = tf.where("idf is not null").join(tmpl, "token").groupBy("u", "license", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.count("*").alias("held"), F.first("least").alias("least")).where("held >= least")
    cos = dots.join(norms, "u").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = cos.groupBy("u").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"), *[F.max(F.col("license") == x).alias(f"_{x}") for x in LONGER.values()])
    found = rows.select("path", "u").join(best, "u").groupBy("path").agg(F.min("m").alias("m"), *[F.max(f"_{x}").alias(f"_{x}") for x in LONGER.values()])
    license = F.col("m.license")
    for short, long in LONGER.items():
        license = F.when((F.col("m.license") == short) & F.col(f"_{long}"), long).otherwise(license)
    return found.select("path", license.alias("license"), (-F.col("m.s")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "(?s)/?[^/]*$", "")


def scan_licenses(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, path: str = "path", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``(path, own_license, own_score, license, inherited_from, levels)`` of each row of ``files``, after its columns ``keep``.

    ``license`` is the file's own or that of the nearest ancestor directory (its own included) in
    which a licence file has one; of several, the best score, then the first name. ``levels`` counts
    the directories up, 0 for an own licence. Rows of one path are one file; a null path inherits
    nothing. Ancestors are joined by directory, once each however many files it holds.
    """
    own = materialize(own_licenses(files, templates, threshold, path, text), "licenses")
    rows = files.select(F.col(path).alias("path"), F.struct(*[F.col(c).alias(c) for c in keep] or [F.lit(0)]).alias("_kept"))
    joined = rows.join(own.select(F.col("path").alias("_p"), "license", "score"), F.col("path").eqNullSafe(F.col("_p")), "left").drop("_p")
    held = own.where(F.substring_index("path", "/", -1).rlike(LICENSE_FILE))
    given = held.groupBy(_directory(F.col("path")).alias("from")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("m"))
    dirs = rows.where("path is not null").select(_directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - k), "/").alias("from"), k.alias("levels")))
    chains = dirs.select("dir", F.inline(F.array_distinct(F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("from"), F.lit(0).alias("levels")))).otherwise(ups))))
    nearest = chains.join(given, "from").groupBy("dir").agg(F.min(F.struct("levels", "from", "m.license")).alias("near"))
    out = joined.withColumn("dir", _directory(F.col("path"))).join(nearest, "dir", "left")
    inherited = F.col("license").isNull()
    return out.select(
        *[F.col(f"_kept.{c}").alias(c) for c in keep],
        "path",
        F.col("license").alias("own_license"),
        F.col("score").alias("own_score"),
        F.coalesce("license", "near.license").alias("license"),
        F.when(inherited, F.col("near.from")).alias("inherited_from"),
        F.when(inherited, F.col("near.levels") + 1).otherwise(0).alias("levels"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: of every 25, one is the licence file of its language or source folder."""
    k = F.col("doc_id") % 50
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    path = (
        F.when(k == 0, F.concat(folder, F.lit("/LICENSE."), F.col("doc_id")))
        .when(k == 25, F.concat(F.coalesce("source", F.lit("none")), F.lit("/LICENSE."), F.col("doc_id")))
        .otherwise(F.concat(folder, F.lit("/"), F.expr("doc_id div 500"), F.lit("/"), F.col("doc_id"), F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def document_licenses(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, own_license, own_score, license, inherited_from, levels)`` of each document."""
    return scan_licenses(document_files(docs), keep=["doc_id"])


def _sql() -> str:
    """SQL of ``document_licenses`` over the table ``documents``, without the anchor filter."""
    quoted = ", ".join(f"('{lic}', {k}, '{text.replace(chr(39), chr(39) * 2)}')" for k, (lic, text) in enumerate(TEMPLATES))
    words = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
    named = "regexp_matches(regexp_extract(path, '[^/]*$'), '" + LICENSE_FILE + "')"
    folder = r"regexp_replace(path, '/?[^/]*$', '')"
    return f"""
WITH files AS (
  SELECT doc_id, text, coalesce(source, 'none') || CASE WHEN doc_id % 50 = 0 THEN '/' || coalesce(lang, 'none') || '/LICENSE.' || doc_id WHEN doc_id % 50 = 25 THEN '/LICENSE.' || doc_id
    ELSE '/' || coalesce(lang, 'none') || '/' || (doc_id // 500) || '/' || doc_id || '.txt' END AS path FROM documents),
templates(license, k, text) AS (VALUES {quoted}),
tt AS (SELECT license, k, token, count(*) AS tf FROM (SELECT license, k, unnest({words.format('text')}) AS token FROM templates) GROUP BY ALL),
df AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({words.format('text')})) AS token FROM files) WHERE token IN (SELECT token FROM tt) GROUP BY token),
idf AS (SELECT token, ln(((SELECT count(*) FROM files) + 1) / (coalesce(n, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT token FROM tt) LEFT JOIN df USING (token)),
tw AS (SELECT license, k, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY k)) AS w FROM tt JOIN idf USING (token)),
units AS (
  SELECT path, row_number() OVER () AS u, unit FROM (SELECT path, unnest(list_concat(regexp_split_to_array(text, '\\r?\\n'),
    list_filter(regexp_split_to_array(text, '\\r?\\n[^\\p{{L}}\\p{{N}}\\n]*\\n'), lambda p: contains(p, chr(10))), CASE WHEN {named} THEN [text] ELSE [] END)) AS unit FROM files)),
ut AS (SELECT u, token, count(*) AS tf FROM (SELECT u, unnest({words.format('unit')}) AS token FROM units) GROUP BY ALL),
ux AS (SELECT u, token, idf, tf * coalesce(idf, (SELECT max(idf) FROM idf)) AS x FROM ut LEFT JOIN idf USING (token)),
norms AS (SELECT u, sqrt(sum(x * x)) AS norm FROM ux GROUP BY u),
tn AS (SELECT k, CASE WHEN count(*) <= {WHOLE_WORDS} THEN count(*) ELSE 0 END AS least FROM tt GROUP BY k),
cosines AS (SELECT u, license, round(sum(x * w) / any_value(norm), 6) AS score FROM ux JOIN tw USING (token) JOIN norms USING (u) JOIN tn USING (k) GROUP BY u, license, k HAVING round(sum(x * w) / any_value(norm), 6) >= {THRESHOLD} AND count(*) >= any_value(least)),
nearest AS (SELECT path, arg_min(license, (-score, license)) AS license, max(score) AS score, bool_or(license = 'BSD-3-Clause') AS third FROM cosines JOIN units USING (u) GROUP BY path),
own AS (SELECT path, CASE WHEN license = 'BSD-2-Clause' AND third THEN 'BSD-3-Clause' ELSE license END AS license, score FROM nearest),
given AS (SELECT {folder} AS folder, arg_min(license, (-score, license)) AS license FROM own WHERE {named} GROUP BY 1),
dirs AS (SELECT DISTINCT {folder} AS dir, string_split({folder}, '/') AS parts FROM files),
ups AS (SELECT dir, l.level AS level, array_to_string(parts[1:len(parts) - l.level], '/') AS folder FROM dirs, unnest(generate_series(0, len(parts))) AS l(level)),
near AS (SELECT dir, arg_min(folder, level) AS folder, arg_min(license, level) AS license, min(level) AS level FROM ups JOIN given USING (folder) GROUP BY dir)
SELECT f.doc_id, f.path, o.license AS own_license, o.score AS own_score, coalesce(o.license, n.license) AS license, CASE WHEN o.license IS NULL THEN n.folder END AS inherited_from,
  CAST(CASE WHEN o.license IS NULL THEN n.level + 1 ELSE 0 END AS INTEGER) AS levels
FROM files f LEFT JOIN own o USING (path) LEFT JOIN near n ON n.dir = regexp_replace(f.path, '/?[^/]*$', '')
"""


SQL = _sql()
