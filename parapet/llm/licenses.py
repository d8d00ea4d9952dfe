"""Licence scan: lines, paragraphs and whole texts against licence templates by word bigrams.

A unit's normalised words give its set of bigrams; only templates whose number of bigrams lets the
Dice coefficient reach the threshold are compared, and only texts that hold one of a few words which no
match can be without are split at all. All of it is one projection over the documents: no join, no
shuffle, and only DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.functions.text import let

THRESHOLD = 0.8
#: What parts words: ASCII but letters and digits, and common signs beyond it.
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\xBF\u2000-\u206F]+"

#: Usual licence notices and texts, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License. See the LICENSE file for details."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the
terms of the GNU General Public License as published by the Free Software Foundation, either version
3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain."""),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
]


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order of first place."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:]))))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a text, as 64-bit hashes; null for fewer than two words."""
    words = F.array_remove(F.split(F.lower(text), _SPLIT), "")
    return let(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1),
        lambda a, b: F.xxhash64(a, b),
    ))))


def units(text: Column) -> Column:
    """Distinct lines and paragraphs of a text, and the text itself."""
    return F.array_distinct(F.concat(
        F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)
    ))


_COMMON = set("this that with from have will without under into including".split())


def gate_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Strings of which every text that matches a template holds one, in a word.

    A unit that reaches the threshold lacks at most (2 - 2 threshold) / (2 - threshold) of a template's
    bigrams, so it holds one of any set of more. Words are taken, those in most bigrams that are still
    needed first, until such a set of each template's bigrams holds one of them.
    """
    share = (2 - 2 * threshold) / (2 - threshold)
    needed = []
    for _, text in templates:
        grams = [set(g.split()) for g in template_bigrams(text)]
        needed.append((grams, int(len(grams) * share + 1e-9) + 1))
    words: list[str] = []
    while True:
        count: dict[str, float] = {}
        for grams, least in needed:
            have = sum(1 for g in grams if g & set(words))
            for g in grams if have < least else ():
                for w in g - set(words):
                    # long words are rarer in other texts; a short one is part of many
                    rare = 1e-6 if len(w) < 4 or w in _COMMON else len(w) ** 2
                    count[w] = count.get(w, 0) + rare / least
        if not count:
            return [w for w in words if not any(v != w and v in w for v in words)]
        words.append(max(sorted(count), key=count.get))


def _unused(name: str, df: DataFrame) -> str:
    """``name``, led by as many underscores as make it unlike the columns of ``df``."""
    while name in df.columns:
        name = "_" + name
    return name


def license_matches(
    docs: DataFrame,
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``matches``: (unit, license, dice) of each unit that reaches the threshold.

    Units stand in the order lines, paragraphs, whole text; each unit names its best template, of
    equal ones the first by name. Null and empty texts, and units of fewer than two words, match
    nothing. An existing column ``matches`` is replaced; the others stay.
    """
    grams = [(name, text, template_bigrams(text)) for name, text in templates]
    known = F.array(*(
        F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"),
                 bigrams(F.lit(text)).alias("grams"))
        for name, text, g in grams
    ))
    parts = F.transform(units(F.col(text_col)), lambda u: F.struct(
        u.alias("unit"), bigrams(u).alias("grams")))
    low = F.lower(F.col(text_col))
    worth = F.lit(False)
    for word in gate_words(templates, threshold):
        worth = worth | low.contains(word)
    units_col = _unused("_units", docs)
    sized = docs.withColumn(units_col, F.when(worth, parts))

    def compared(u: Column) -> Column:
        n = F.size(u["grams"])
        near = F.filter(known, lambda t: 2 * F.least(n, t["n"]) >= threshold * (n + t["n"]))
        return F.transform(near, lambda t: F.struct(
            u["unit"].alias("unit"), t["name"].alias("license"),
            (2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + t["n"])).alias("dice"),
        ))

    def best(found: Column) -> Column:
        rank = F.transform(found, lambda m: F.struct(
            (-m["dice"]).alias("less"), m["license"].alias("license"), m["unit"].alias("unit")))
        return F.transform(F.slice(F.array_sort(rank), 1, 1), lambda m: F.struct(
            m["unit"].alias("unit"), m["license"].alias("license"), (-m["less"]).alias("dice")))

    usable = F.filter(units_col, lambda u: u["grams"].isNotNull())
    reached = F.flatten(F.transform(usable, lambda u: best(
        F.filter(compared(u), lambda m: m["dice"] >= threshold))))
    none = F.array().cast("array<struct<unit:string,license:string,dice:double>>")
    return sized.withColumn("matches", F.coalesce(reached, none)).drop(units_col)


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_matches, licenses, best_license, best_dice) of every row of ``docs``."""
    found = license_matches(docs.select("doc_id", "text"), **options)
    top = F.array_sort(F.transform("matches", lambda m: F.struct(
        (-m["dice"]).alias("less"), m["license"].alias("license"))))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.get(top, F.lit(0))["license"].alias("best_license"),
        (-F.get(top, F.lit(0))["less"]).alias("best_dice"),
    )
