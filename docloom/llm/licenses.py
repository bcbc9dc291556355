"""Licence statements found by the Dice coefficient of word bigrams.

The units of a text are its lines, its paragraphs (runs of lines that have words; where there are several, those of two lines
or more), and the text as a whole where it has several lines: a notice is found on a line of its own, wrapped over the lines
of a paragraph, or as all that a text says. A unit is normalised (lower case, runs of other characters than letters and digits
part words) and compared with licence templates: twice the shared distinct bigrams over the sum of both numbers. From
2m/(a+b) >= t follows t/(2-t) <= a/b <= (2-t)/t, so each template is listed under the sizes that it can match; other units
never meet it. Of the templates that a unit reaches the threshold with, the best one counts (ties: the first by name).

A row is looked at by itself: no join and no shuffle, and repeated rows and ids, null ids among them, are reported each. Null
and empty texts have no statement; an empty table gives an empty result. Only DataFrame functions are used, and the templates
are a fixed list. A statement that shares its line or paragraph with as many other words isn't found.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.lines import bind

THRESHOLD = 0.8

TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Released into the public domain under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    found = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams that can reach the threshold with one of `size`."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def words_of(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def bigrams_of(words: Column, most: int) -> Column:
    """Distinct bigrams, or none where there are more than `most` for sure: v different words are joined by v - 1 bigrams at least."""
    pair = lambda i: F.concat(F.element_at(words, i), F.lit(" "), F.element_at(words, i + 1))
    many = F.size(F.array_distinct(F.slice(words, 1, 2 * most + 2))) > most + 1
    return F.when((F.size(words) < 2) | many, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), pair)))


def _units(lines: Column) -> Column:
    """The units of a text, an array of (line, lines, words); lines: the words of each line."""
    n = F.size(lines)
    at = lambda i: F.element_at(lines, i)
    worded = lambda i: (i >= 1) & (i <= n) & (F.size(at(F.greatest(F.least(i, n), F.lit(1)))) > 0)
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda i: worded(i) & ~worded(i - 1))
    ends = F.filter(places, lambda i: worded(i) & ~worded(i + 1))

    def unit(line: Column, count: Column, words: Column) -> Column:
        return F.struct(line.cast("long").alias("line"), count.cast("long").alias("lines"), words.alias("words"))

    single = F.transform(lines, lambda w, i: unit(i, F.lit(1), w))
    spans = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: x["e"] > x["s"])
    wrapped = F.transform(spans, lambda x: unit(x["s"] - 1, x["e"] - x["s"] + 1, F.flatten(F.slice(lines, x["s"], x["e"] - x["s"] + 1))))
    none = F.slice(single, 1, 0)
    return F.concat(single, F.when(F.size(starts) > 1, wrapped).otherwise(none), F.when(n > 1, F.array(unit(F.lit(-1), n, F.flatten(lines)))).otherwise(none))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per statement: id, line (its first, from 0; -1: the whole text of several lines), lines (how many), license, dice."""
    chosen = [(name, b) for name, text in sorted((templates or TEMPLATES).items()) if (b := template_bigrams(text))]
    bounds = [size_bounds(len(b), threshold) for _, b in chosen]
    most = max((hi for _, hi in bounds), default=0)
    by_size = [[k for k, (lo, hi) in enumerate(bounds) if lo <= size <= hi] for size in range(1, most + 1)]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    known, fitting = literal([b for _, b in chosen], "array<array<string>>"), literal(by_size, "array<array<int>>")
    names = literal([name for name, _ in chosen], "array<string>")

    def best(bigrams: Column) -> Column:
        """(dice, -template) of the nearest template."""
        size = F.size(bigrams)

        def one(k: Column) -> Column:
            of = F.element_at(known, k + 1)
            return F.struct((2 * F.size(F.array_intersect(bigrams, of)) / (size + F.size(of))).alias("dice"), (-k).alias("k"))

        return F.when(size.between(1, most), F.array_max(F.transform(F.element_at(fitting, F.greatest(F.least(size, F.lit(most)), F.lit(1))), one)))

    def scored(units: Column) -> Column:
        each = F.transform(units, lambda u: F.struct(u["line"].alias("line"), u["lines"].alias("lines"), bind(bigrams_of(u["words"], most), best).alias("best")))
        return F.filter(each, lambda u: u["best"]["dice"] >= threshold - 1e-12)

    if not most:
        return docs.limit(0).select(F.col(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("line", "long"), ("lines", "long"), ("license", "string"), ("dice", "double"))))
    words = F.transform(F.split(F.col(text_col), "\n"), words_of)
    found = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.explode(bind(words, lambda lines: bind(_units(lines), scored))).alias("u"))
    return found.select(id_col, "u.line", "u.lines", F.element_at(names, 1 - F.col("u.best.k")).alias("license"), F.round("u.best.dice", 9).alias("dice"))


def _sql() -> str:
    values = ", ".join(f"('{name}', {i}, [{', '.join(repr(b) for b in template_bigrams(text))}])" for i, (name, text) in enumerate(sorted(TEMPLATES.items())))
    return f"""
WITH template(license, rank, t) AS (VALUES {values}),
numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL),
each AS (SELECT row, doc_id, unnest(string_split(text, chr(10))) AS u, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM numbered),
worded AS (
  SELECT row, doc_id, line, list_filter(string_split(trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM each
), runs AS (
  SELECT *, line - row_number() OVER (PARTITION BY row, len(w) > 0 ORDER BY line) AS run FROM worded
), paragraph AS (
  SELECT row, doc_id, min(line) AS line, count(*) AS lines, flatten(list(w ORDER BY line)) AS w, count(*) OVER (PARTITION BY row) AS paragraphs
  FROM runs WHERE len(w) > 0 GROUP BY row, doc_id, run
), unit AS (
  SELECT row, doc_id, line, 1 AS lines, w FROM worded
  UNION ALL SELECT row, doc_id, line, lines, w FROM paragraph WHERE paragraphs > 1 AND lines > 1
  UNION ALL SELECT row, doc_id, -1, count(*), flatten(list(w ORDER BY line)) FROM worded GROUP BY row, doc_id HAVING count(*) > 1
), bigram AS (
  SELECT row, doc_id, line, lines, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM unit WHERE len(w) > 1
), scored AS (
  SELECT row, doc_id, line, lines, license, rank, 2.0 * len(list_intersect(b, t)) / (len(b) + len(t)) AS dice
  FROM bigram JOIN template ON len(b) >= len(t) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(b) <= len(t) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9
)
SELECT doc_id, line::BIGINT AS line, lines::BIGINT AS lines, license, round(dice, 9)::DOUBLE AS dice FROM scored WHERE dice >= {THRESHOLD} - 1e-12
QUALIFY row_number() OVER (PARTITION BY row, line, lines ORDER BY dice DESC, rank) = 1
"""


SQL = _sql()
