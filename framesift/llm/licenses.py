"""Licence scans: Dice coefficient over word bigrams between normalised passages and licence templates.

A passage is a line, a paragraph, or up to three sentences in a row within a paragraph, so a notice is found within a
longer line, too. Dice is taken over bigrams with their counts, so a passage of n words has
n - 1 of them, and a score of t needs a size between t / (2 - t) and (2 - t) / t times the template's: most
templates are pruned for most passages by that comparison of two numbers. Sizes also say how many bigrams a
match has to share, and so give a few words of which a text with any match has one. All of it is built-in functions on
the document's own row; nothing is shuffled.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from fractions import Fraction
from functools import reduce
from math import ceil, floor
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence and notices that name it. The customary wording of public licences.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
#: Licences that are named by their identifier.
IDENTIFIERS = (
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
TEMPLATES += tuple((x.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {x}") for x in IDENTIFIERS)
#: Sentences in a row that are a passage.
SENTENCES = 3
THRESHOLD = 0.8


def words_of(notice: str) -> list[str]:
    """The normalised words of a template."""
    return re.findall("[a-z0-9]+", notice.lower())


def bigrams_of(notice: str) -> list[str]:
    words = words_of(notice)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """The bigrams that a passage may have if it is to reach the threshold with a template of ``size``."""
    t = Fraction(str(threshold))
    return ceil(size * t / (2 - t)), floor(size * (2 - t) / t)


def marks(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> dict[str, list[tuple[str, str]]]:
    """Bigrams, by the longer of their words, of which every text with a match holds one.

    A match of a template of m bigrams shares k of them or more, k following from the smallest size that can match;
    so it shares one of any m - k + 1. Of each template so many are chosen, those of long words first.
    """
    t, chosen = Fraction(str(threshold)), {}
    for _, notice in templates:
        pairs = [tuple(pair.split()) for pair in bigrams_of(notice)]
        low, _ = bounds(len(pairs), threshold)
        need = len(pairs) - ceil(t * (low + len(pairs)) / 2) + 1
        for pair in sorted(pairs, key=lambda p: (max(p, key=len) in chosen, *sorted(map(len, p), reverse=True)), reverse=True)[:need]:
            chosen.setdefault(max(pair, key=len), set()).add(pair)
    return {lead: sorted(pairs) for lead, pairs in chosen.items()}


def may_match(text: Column, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """True for all texts with a match, and few others: they hold a word of a mark, and the mark itself."""
    lower = F.lower(text)
    found = lambda pairs: F.rlike(text, F.lit("(?i)" + "|".join(f"{a}[^a-z0-9]+{b}" for a, b in pairs)))
    return reduce(or_, (F.contains(lower, F.lit(lead)) & found(pairs) for lead, pairs in marks(templates, threshold).items()))


def passages(text: Column, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """The word bigrams of every line, paragraph and run of sentences that any template can match.

    Its number of words has to be within the bounds of some template, and two words that follow each other have to
    do so in templates, or it is left out before its bigrams are made.
    """
    sizes = [bounds(len(bigrams_of(notice)), threshold) for _, notice in templates]
    low, high = max(1, min(a for a, _ in sizes)), max(b for _, b in sizes)
    shared = {tuple(pair.split()) for _, notice in templates for pair in bigrams_of(notice)}
    firsts, seconds = (sorted(set(side)) for side in zip(*shared))
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    plain = F.regexp_replace(lower, "[^a-z0-9\n]+", " ")
    ended = F.regexp_replace(F.regexp_replace(F.translate(lower, "|", " "), "[.!?]+([ \t\n])", "|$1"), "[^a-z0-9\n|]+", " ")
    sentences = F.transform(F.split(ended, "\n(?:[ |]*\n)+"), lambda x: F.filter(F.split(F.translate(x, "\n", " "), "[|]"), lambda y: F.trim(y) != ""))
    row = lambda x, n: F.transform(x, lambda _, i: F.when(i + n <= F.size(x), F.concat_ws(" ", F.slice(x, i + 1, F.lit(n)))).otherwise(F.lit("")))
    rows = F.flatten(F.transform(sentences, lambda x: F.concat(*(row(x, n) for n in range(1, SENTENCES + 1)))))
    # a line end and the spaces around it are three marks at most, so many more spaces than words mean too many words
    parts = F.transform(F.split(plain, "\n(?: ?\n)+"), lambda x: F.translate(x, "\n", " "))
    short = F.filter(F.concat(parts, rows), lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) <= 3 * (high + 1))
    words = F.transform(F.concat(F.split(plain, "\n"), short), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    meets = lambda w: F.size(F.filter(w, lambda x, i: x.isin(firsts) & F.get(w, i + 1).isin(seconds))) > 0
    pair = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.filter(words, lambda w: F.size(w).between(low + 1, high + 1) & meets(w)), pair)


def _score(unit: Column, name: str, notice: str, threshold: float) -> Column:
    """(dice, license) of a passage and a template; null where their sizes rule the threshold out."""
    pairs = bigrams_of(notice)
    counts = Counter(pairs)
    low, high = bounds(len(pairs), threshold)
    common = F.array_intersect(unit, F.array(*map(F.lit, counts)))
    if len(counts) == len(pairs):
        shared = F.size(common)
    else:
        times = F.create_map(*(F.lit(x) for item in counts.items() for x in item))
        shared = F.aggregate(common, F.lit(0), lambda n, x: n + F.least(F.element_at(times, x), F.size(F.filter(unit, lambda y: y == x))))
    dice = F.lit(2.0) * shared / (F.size(unit) + F.lit(len(pairs)))
    return F.when(F.size(unit).between(low, high), F.struct(dice.alias("dice"), F.lit(name).alias("license")))


def matches(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """array<struct<license, dice>>: each licence that is the best match of a passage, with its highest score.

    Of templates with equal scores the last name counts. A null or empty text has no passages and no licences.
    """
    best = F.transform(F.col("_passages"), lambda u: F.array_max(F.array(*(_score(u, *t, threshold) for t in templates))))
    return F.filter(best, lambda x: x["dice"] >= threshold)


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license and dice: a row for each licence that a passage of a document names.

    Null, empty and one-word texts give no rows; repeated documents give their rows each; an empty table gives
    an empty result; other columns are ignored. Texts are scanned whole, whatever their length.
    """
    texts = docs.where(may_match(F.col("text").cast("string"), templates, threshold))
    units = texts.select("doc_id", passages(F.col("text").cast("string"), templates, threshold).alias("_passages"))
    found = units.select("doc_id", matches(templates, threshold).alias("found")).where(F.size("found") > 0)
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    top = lambda name: F.array_max(F.transform(F.filter("found", lambda x: x["license"] == name), lambda x: x["dice"]))
    return found.select("doc_id", F.inline(F.transform(names, lambda n: F.struct(n.alias("license"), top(n).alias("dice")))))


def oracle(templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL, by joins of bigram counts."""
    counts = ", ".join(f"({i}, '{name}', {len(bigrams_of(notice))}, '{pair}', {n})" for i, (name, notice) in enumerate(templates) for pair, n in Counter(bigrams_of(notice)).items())
    return rf"""
WITH template(tid, license, size, pair, times) AS (VALUES {counts}),
low AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
plain AS (SELECT rid, doc_id, regexp_replace(t, '[^a-z0-9\n]+', ' ', 'g') AS t FROM low),
ended AS (SELECT rid, doc_id, regexp_replace(regexp_replace(replace(t, '|', ' '), '[.!?]+([ \t\n])', '|\1', 'g'), '[^a-z0-9\n|]+', ' ', 'g') AS t FROM low),
sentences AS (SELECT rid, doc_id, list_filter(string_split(replace(p, chr(10), ' '), '|'), lambda x: trim(x) <> '') AS s FROM (SELECT rid, doc_id, unnest(regexp_split_to_array(t, '\n(?:[ |]*\n)+')) AS p FROM ended)),
unit AS (
  SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS u FROM plain
  UNION SELECT rid, doc_id, replace(unnest(regexp_split_to_array(t, '\n(?: ?\n)+')), chr(10), ' ') FROM plain
  UNION SELECT rid, doc_id, array_to_string(s[i : i + k], ' ') FROM (SELECT rid, doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sentences), range({SENTENCES}) r(k) WHERE i + k <= len(s)),
worded AS (SELECT row_number() OVER () AS uid, rid, doc_id, list_filter(string_split(u, ' '), lambda w: w <> '') AS w FROM unit),
pairs AS (SELECT uid, rid, doc_id, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM worded WHERE len(w) > 1),
counted AS (SELECT uid, rid, doc_id, size, pair, count(*) AS times FROM pairs GROUP BY ALL),
scored AS (
  SELECT uid, rid, doc_id, t.tid, t.license, 2.0::DOUBLE * sum(least(c.times, t.times)) / (c.size + t.size) AS dice
  FROM counted c JOIN template t USING (pair) GROUP BY uid, rid, doc_id, t.tid, t.license, c.size, t.size),
best AS (SELECT uid, rid, doc_id, license, dice FROM scored QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, license DESC) = 1)
SELECT doc_id, license, max(dice) AS dice FROM best WHERE dice >= {threshold} GROUP BY rid, doc_id, license"""
