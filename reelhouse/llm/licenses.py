"""License scan: passages compared to license templates by the Dice coefficient over word bigrams.

Normalised text is lower case with every run of characters other than a-z, 0-9 and line feeds made a
space. The passages of a document are its lines, and its paragraphs of several lines (a blank line
ends a paragraph), joined to one line. A passage's bigrams are the set of its pairs of adjacent words.
With a template of n bigrams a passage can reach a coefficient of t only if it has between
n * t / (2 - t) and n * (2 - t) / t bigrams; outside these bounds the two sets aren't compared.

All of it is a projection in DataFrame functions: nothing is shuffled, broadcast or gathered, so
neither a hot source nor copies matter, and the work is linear in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DICE = 0.8

#: Notices as their licenses' publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        ' on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software.",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
        " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
    ),
    (
        "BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer.",
    ),
    (
        "BSD",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later"
        " version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
        " License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later"
        " version.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is"
        " available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"
        " http://www.boost.org/LICENSE_1_0.txt)",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, sorted."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _best(own: Column, templates: list[tuple[str, list[str]]], dice: float) -> Column:
    """The number of the template with the largest coefficient, of those the first; null if none reaches ``dice``."""
    tried = []
    for number, (_, grams) in enumerate(templates):
        n = len(grams)
        fits = (F.size(own) * (2 - dice) >= n * dice) & (F.size(own) * dice <= n * (2 - dice))
        shared = F.size(F.array_intersect(own, F.array(*map(F.lit, grams))))
        value = shared * 2.0 / (F.size(own) + n)
        tried.append(F.when(fits, F.when(value >= dice, F.struct((-value).alias("v"), F.lit(number).alias("i")))))
    return F.array_min(F.array(*tried))["i"]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    dice: float = DICE,
) -> DataFrame:
    """(``id_col``, found), one row per input row: for each passage with a license its name, lines before paragraphs.

    Null and empty texts have no passages. Null and repeated ids keep their rows, each judged
    alone. An empty table gives an empty result. Other columns aren't read. Of templates with the
    same coefficient, the first names the license; passages that come again are listed again.
    """
    known = [(name, grams) for name, text in templates if (grams := bigrams(text))]
    if not known:
        return docs.select(F.col(id_col), F.array().cast("array<string>").alias("found"))
    least = min(len(grams) for _, grams in known) * dice / (2 - dice)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.select(F.col(id_col).alias("id"), F.regexp_replace(text, r"[^a-z0-9\n]+", " ").alias("norm"))
    # A class, as a group that comes again and again would be one call deep for each time.
    paragraphs = F.filter(F.split("norm", r"\n[ \n]*\n", -1), lambda p: F.contains(p, F.lit("\n")))
    paragraphs = F.transform(paragraphs, lambda p: F.regexp_replace(p, r"[ \n]+", " "))
    out = out.select("id", F.concat(F.split("norm", "\n", -1), paragraphs).alias("passages"))
    words = F.transform("passages", lambda p: F.split(F.trim(p), " ", -1))
    out = out.select("id", F.filter(words, lambda w: F.size(w) > least).alias("words"))
    pairs = F.transform(
        "words",
        lambda w: F.array_distinct(
            F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
        ),
    )
    out = out.select("id", pairs.alias("pairs"))
    best = F.array_compact(F.transform("pairs", lambda own: _best(own, known, dice)))
    names = F.array(*(F.lit(name) for name, _ in known))
    return out.select(F.col("id").alias(id_col), F.transform(best, lambda i: F.get(names, i)).alias("found"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses"),
    )


def _sql() -> str:
    known = [(name, bigrams(text)) for name, text in TEMPLATES]
    rows = ", ".join(f"({i}, '{name}', {[*grams]!r})" for i, (name, grams) in enumerate(known))
    least = min(len(grams) for _, grams in known) * DICE / (2 - DICE)
    return rf"""
WITH t(i, name, grams) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n]+', ' ', 'g') AS norm
  FROM documents
), passages AS (
  SELECT r, unnest(string_split(norm, chr(10))) AS p FROM d
  UNION ALL
  SELECT r, regexp_replace(p, '[ \n]+', ' ', 'g') FROM (SELECT r, unnest(string_split_regex(norm, '\n(?: ?\n)+')) AS p FROM d)
  WHERE contains(p, chr(10))
), words AS (
  SELECT row_number() OVER () AS k, r, string_split(trim(p), ' ') AS w FROM passages
), pairs AS (
  SELECT k, r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own
  FROM words WHERE len(w) > {least!r}
), compared AS (
  SELECT k, r, i, name, len(list_intersect(own, grams)) * 2.0::DOUBLE / (len(own) + len(grams)) AS v FROM pairs, t
  WHERE len(own) * {2 - DICE!r}::DOUBLE >= len(grams) * {DICE!r}::DOUBLE
    AND len(own) * {DICE!r}::DOUBLE <= len(grams) * {2 - DICE!r}::DOUBLE
), best AS (
  SELECT r, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, i) AS o FROM compared WHERE v >= {DICE!r})
  WHERE o = 1
), found AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM best GROUP BY r
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_passages, coalesce(names, '') AS licenses FROM d LEFT JOIN found USING (r)
"""


OP6_SQL = _sql()
