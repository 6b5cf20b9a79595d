"""Licence scan: normalised text against licence templates by the Dice
coefficient over word bigrams.

Units of a text are its lines, its blocks (between empty lines, when there
are several), the whole of it (when it has several lines) and runs: as many
words of a line as a template has, from where the template's first three words
stand, if the line itself is too long to match that template. Dice of at
least ``t`` needs a unit whose number of bigrams is within t / (2 - t) and
(2 - t) / t of the template's; that size bound is turned into an equality on
the number of bigrams (templates listed under each size they can match), so
only candidates get their bigrams built; of those, only the ones that share
enough different bigrams are counted out. Bigrams count as often as they stand.

DataFrame functions only, and no shuffle: the templates are a fixed small
table. Defined results: a null or empty text, or one of a single word, has no
row; repeated rows have their rows each; a unit has its best template, of ties
the first listed; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: fixed values: (licence, notice)
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction, including '
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
            "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the following "
                     "disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions "
                     "in binary form must reproduce the above copyright notice, this list of conditions and the following "
                     "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
                     "the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
            "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
            "for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software."),
)


def normal(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(bigrams of a unit, template number, licence, bigrams of the template,
    its distinct bigrams, how often each stands)."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = normal(text)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        kinds = sorted(set(pairs))
        n = len(pairs)
        low = math.ceil(threshold / (2 - threshold) * n - 1e-9)
        high = math.floor((2 - threshold) / threshold * n + 1e-9)
        out += [(size, i, name, n, kinds, [pairs.count(k) for k in kinds]) for size in range(max(low, 1), high + 1)]
    return out


def anchors(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(template number, licence, first three words or all, its bigrams, the
    longest unit that can match, distinct bigrams, how often each stands)."""
    out = {}
    for size, i, name, n, kinds, times in template_rows(templates, threshold):
        out[i] = (i, name, " ".join(normal(templates[i][1])[:3]), n, size, kinds, times)
    return [out[i] for i in sorted(out)]


_UNIT = "array<struct<unit:string,place:bigint,body:string,size:int>>"


def normalised(text: Column) -> Column:
    """Lower case, all but letters, digits and line breaks as single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def bigrams_in(body: Column) -> Column:
    return F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit("")))


def units(clean: Column, lines: Column, low: int, high: int) -> Column:
    """Units of a text as structs (unit, place, body, size), only those whose
    number of bigrams is within the bounds. ``lines`` are the trimmed lines of
    the normalised text. Blocks and the whole are built only where they can
    count."""
    def fits(parts: Column, unit: str) -> Column:
        every = F.transform(parts, lambda p, i: F.struct(
            F.lit(unit).alias("unit"), i.cast("long").alias("place"), p.alias("body"), bigrams_in(p).alias("size")))
        return F.filter(every, lambda u: u["size"].between(low, high))

    none = F.array().cast(_UNIT)
    words = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.when(x == "", 0).otherwise(bigrams_in(x) + 1))
    whole = F.array(F.concat_ws(" ", F.filter(lines, lambda x: x != "")))
    blocks = F.transform(F.split(clean, r"\n *\n[ \n]*"), lambda b: F.trim(F.regexp_replace(b, "[ \n]+", " ")))
    return F.concat(fits(lines, "line").cast(_UNIT),
                    F.when(F.exists(lines, lambda x: x == "") & (F.size(F.split(clean, r"\n *\n[ \n]*")) > 1),
                           fits(blocks, "block").cast(_UNIT)).otherwise(none),
                    F.when((F.size(lines) > 1) & (words - 1).between(low, high),
                           fits(whole, "text").cast(_UNIT)).otherwise(none))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, unit (line, block, text, run), place (its number from 0; of a
    run its line's), word_at (a run's first word in its line, else -1), license, template
    (its number), dice."""
    by_size: dict[int, list[tuple]] = {}
    for size, *rest in template_rows(templates, threshold):
        by_size.setdefault(size, []).append(tuple(rest))
    table = docs.sparkSession.createDataFrame(
        sorted(by_size.items()),
        "size int, options array<struct<template:int,license:string,n:int,kinds:array<string>,times:array<int>>>")
    low, high = min(by_size, default=0), max(by_size, default=-1)
    # each step reads the one before several times, so Spark keeps them apart
    # and computes each once
    clean = docs.select(F.col(id_col).alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("clean"))
    lines = clean.withColumn("lines", F.transform(F.split("clean", "\n"), lambda x: F.trim(x)))
    found = lines.select("doc_id", F.explode(units(F.col("clean"), F.col("lines"), low, high)).alias("u")).select("doc_id", "u.*")
    words = F.split("body", " ")
    pairs = found.withColumn("words", words).withColumn("pairs", F.zip_with(
        F.slice("words", F.lit(1), F.col("size")), F.slice("words", F.lit(2), F.col("size")),
        lambda a, b: F.concat_ws(" ", a, b)))
    # a unit without any bigram of any template has Dice 0 with all of them
    known = sorted({k for r in template_rows(templates, threshold) for k in r[4]})
    pairs = pairs.where(F.arrays_overlap("pairs", F.array(*map(F.lit, known)))) if known else pairs
    pairs = pairs.join(F.broadcast(table), "size")

    # enough different bigrams in common: a repeated one adds at most its repeats
    near = F.filter("options", lambda o: F.size(F.array_intersect("pairs", o["kinds"])) + o["n"] - F.size(o["kinds"])
                    >= F.ceil(F.lit(threshold / 2) * (F.col("size") + o["n"]) - 1e-9))
    pairs = pairs.withColumn("options", near).where(F.size("options") > 0)
    scored = F.transform("options", lambda o: F.struct(
        (_shared(F.col("pairs"), o) * F.lit(2.0) / (F.col("size") + o["n"])).alias("dice"), (-o["template"]).alias("after"),
        o["license"].alias("license")))
    whole = (pairs.select("doc_id", "unit", "place", F.lit(-1).alias("word_at"), F.array_max(scored).alias("best"))
             .unionByName(_runs(lines, templates, threshold)))
    return (whole.where(F.col("best.dice") >= threshold).select(
        "doc_id", "unit", "place", "word_at", "best.license", (-F.col("best.after")).alias("template"), "best.dice"))


def _shared(pairs: Column, option: Column) -> Column:
    """Bigrams in common, each as often as it stands on both sides."""
    return F.aggregate(F.arrays_zip(option["kinds"].alias("kinds"), option["times"].alias("times")), F.lit(0),
                       lambda acc, k: acc + F.least(F.size(F.filter(pairs, lambda p: p == k["kinds"])), k["times"]))


def _runs(lines: DataFrame, templates, threshold: float) -> DataFrame:
    """doc_id, unit (run), place (its line), word_at (its first word in the line)
    and best, of lines too long to match a template whose first words they hold."""
    table = anchors(templates, threshold)
    if not table:
        return lines.select("doc_id", F.lit("run").alias("unit"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("word_at"), F.struct(
            F.lit(0.0).alias("dice"), F.lit(0).alias("after"), F.lit("").alias("license")).alias("best")).limit(0)
    held = [F.contains("clean", F.lit(a)) for a in sorted({t[2] for t in table})]
    some = lines.where(reduce(Column.__or__, held)).select("doc_id", F.posexplode("lines").alias("place", "body"))
    some = some.withColumn("words", F.split("body", " ")).withColumn("size", F.size("words") - 1)
    options = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"),
                                 F.array(*map(F.lit, first.split())).alias("first"), F.lit(n).alias("n"), F.lit(high).alias("high"),
                                 F.array(*map(F.lit, kinds)).alias("kinds"), F.array(*map(F.lit, times)).alias("times"))
                        for i, name, first, n, high, kinds, times in table])
    some = some.where(F.col("size") > min(t[4] for t in table)).withColumn("options", options)
    starts = F.filter(F.sequence(F.lit(0), F.col("size")), lambda p: F.exists("options", lambda o: (
        F.col("size") > o["high"]) & (F.slice("words", p + 1, F.size(o["first"])) == o["first"])))
    at = some.select("doc_id", "place", "words", "size", "options", F.explode(starts).alias("word_at"))
    here = F.filter("options", lambda o: (F.col("size") > o["high"]) & (
        F.slice("words", F.col("word_at") + 1, F.size(o["first"])) == o["first"]))

    def scored(o: Column) -> Column:
        run = F.slice("words", F.col("word_at") + 1, o["n"] + 1)
        size = F.size(run) - 1
        pairs = F.zip_with(F.slice(run, F.lit(1), size), F.slice(run, F.lit(2), size), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct((_shared(pairs, o) * F.lit(2.0) / (size + o["n"])).alias("dice"), (-o["template"]).alias("after"),
                        o["license"].alias("license"))

    return at.select("doc_id", F.lit("run").alias("unit"), F.col("place").cast("long").alias("place"), "word_at",
                     F.array_max(F.transform(here, scored)).alias("best"))


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB twin over ``documents``."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(
        f"({s}, {i}, {text(name)}, {n}, [{', '.join(map(text, kinds))}], {times})"
        for s, i, name, n, kinds, times in template_rows(templates, threshold))
    firsts = ", ".join(
        f"({i}, {text(name)}, [{', '.join(map(text, first.split()))}], {n}, {high}, [{', '.join(map(text, kinds))}], {times})"
        for i, name, first, n, high, kinds, times in anchors(templates, threshold))
    return f"""
WITH t(size, template, license, n, kinds, times) AS (VALUES {values}),
c AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS x FROM documents),
p AS (SELECT doc_id, string_split(x, chr(10)) AS lines, regexp_split_to_array(x, '\\n *\\n[ \\n]*') AS blocks, x FROM c),
u AS (SELECT doc_id, 'line' AS unit, unnest(lines) AS body, unnest(range(len(lines))) AS place FROM p
  UNION ALL SELECT doc_id, 'block', regexp_replace(unnest(blocks), '[ \\n]+', ' ', 'g'), unnest(range(len(blocks))) FROM p WHERE len(blocks) > 1
  UNION ALL SELECT doc_id, 'text', regexp_replace(x, '[ \\n]+', ' ', 'g'), 0 FROM p WHERE len(lines) > 1),
w AS (SELECT doc_id, unit, place, string_split(trim(body, ' '), ' ') AS words FROM u),
j AS (SELECT w.*, t.*, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs
  FROM w JOIN t ON t.size = len(words) - 1),
a(template, license, first, n, high, kinds, times) AS (VALUES {firsts}),
l AS (SELECT doc_id, string_split(trim(unnest(lines), ' '), ' ') AS words, unnest(range(len(lines))) AS place FROM p),
s AS (SELECT l.doc_id, l.place, l.words, a.*, unnest(range(len(words))) AS word_at FROM l JOIN a ON len(l.words) - 1 > a.high
  AND list_contains(l.words, a.first[1])),
r AS (SELECT *, words[word_at + 1:word_at + n + 1] AS run FROM s WHERE words[word_at + 1:word_at + len(first)] = first),
b AS (SELECT *, list_transform(range(1, len(run)), lambda i: run[i] || ' ' || run[i + 1]) AS pairs, len(run) - 1 AS size FROM r),
v AS (SELECT doc_id, 'run' AS unit, place, word_at, license, template, n, kinds, times, pairs, size FROM b
  UNION ALL SELECT doc_id, unit, place, -1, license, template, n, kinds, times, pairs, size FROM j),
d AS (SELECT doc_id, unit, place, word_at, license, template, 2.0::DOUBLE * list_sum(list_transform(range(1, len(kinds) + 1),
    lambda k: least(len(list_filter(pairs, lambda p: p = kinds[k])), times[k]))) / (size + n) AS dice FROM v)
SELECT doc_id, unit, place, CAST(word_at AS INTEGER) AS word_at, license, template, dice FROM d WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place, word_at ORDER BY dice DESC, template) = 1"""
