"""Licence scans against a brute-force version and the SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest
from framesift.llm import licenses


def brute(text):
    found = {}
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    lines = lower.split("\n")
    units, part = list(lines), []
    for line in [*lines, ""]:
        if licenses.words_of(line) or (part and not line.strip() and line):
            part.append(line)
        else:
            units.append(" ".join(part))
            part = []
    ended = re.sub(r"[.!?]+([ \t\n])", r"|\1", lower.replace("|", " "))
    for paragraph in re.split(r"\n(?:[^a-z0-9\n]*\n)+", ended):
        sentences = [x for x in paragraph.split("|") if re.search("[a-z0-9]", x)]
        units += [" ".join(sentences[i : i + k]) for i in range(len(sentences)) for k in (1, 2, 3)]
    for unit in units:
        words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in unit).split()
        own = Counter(zip(words, words[1:]))
        best = (0, "")
        for name, notice in licenses.TEMPLATES:
            w = licenses.words_of(notice)
            other = Counter(zip(w, w[1:]))
            if own.total() + other.total():
                best = max(best, (2 * (own & other).total() / (own.total() + other.total()), name))
        if best[0] >= 0.8:
            found[best[1]] = max(found.get(best[1], 0), best[0])
    return found


NOTICE = dict(licenses.TEMPLATES)
TEXTS = [
    None, "", "word", "prose\nReleased under the MIT License.\nmore prose", "RELEASED UNDER THE MIT LICENSE",
    "Licensed under the\nApache License,\nVersion 2.0.\n\nOther paragraph here\n\n\nLicensed under CC BY-NC 4.0!",
    NOTICE["MIT"].replace("rights", "right"), NOTICE["GPL-3.0"] + "\n" + "x y " * 30_000,
    "We are not licensed under anything; the license of MIT is another matter.", "under the mit license " * 50,
    "This work is licensed under the GNU General Public License, version 2.", "Ünder the\x00 ß\nLicensed under the MIT License. Ω",
    "Copyright 2020 Foo. Licensed under the MIT License. See LICENSE for details.", "Copyright (c) Foo. " + NOTICE["Zlib"] + " 1. The origin must not be misrepresented.", "// SPDX-License-Identifier: GPL-2.0-or-later",
    "Code by A. B. | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed\n...\nwith this file. Stop!",
    *(f"Copyright Foo.\n{notice}\nMore words follow here" for name, notice in licenses.TEMPLATES),
]


def test_brute_force(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[4])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    expected = sorted(((i, n, d) for i, t in rows for n, d in brute(t or "").items()), key=str)
    found = [tuple(r) for r in licenses.scan(docs).collect()]
    assert sorted(found, key=str) == expected and len(expected) > 8
    assert licenses.scan(docs.limit(0)).count() == 0


def test_ties(spark):
    """Of licences with equal scores the last name counts."""
    found = licenses.scan(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), (("b", "one two three four"), ("c", "one two three four"), ("a", "one two three four")))
    assert [tuple(r) for r in found.collect()] == [(1, "c", 1.0)]


@pytest.mark.parametrize(("words", "share"), [(0, 1.0), (1, 0.95), (3, 0.85)])
def test_recall(spark, words, share):
    """Notices within a longer line, with some words exchanged: each licence is found, short notices of up to 12 words only as they are."""
    rng, rows = random.Random(words), []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        parts = notice.split(" ")
        for at in rng.sample(range(len(parts) - 1), words) if len(parts) > 12 * words else []:
            parts[at] = "changed"
        rows.append((i, f"Some words stand before. {' '.join(parts)}{'' if notice.endswith('.') else '.'} And some behind."))
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum((i, name) in found for i, (name, _) in enumerate(licenses.TEMPLATES))
    assert hits >= share * len(rows)


def test_sql(spark):
    docs = "/root/testdata/sf0.001/documents.parquet"
    found = sorted(map(tuple, licenses.scan(spark.read.parquet(docs)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}/*.parquet'" if __import__("os").path.isdir(docs) else f"CREATE VIEW documents AS SELECT * FROM '{docs}'")
    assert found == sorted(con.execute(licenses.oracle()).fetchall()) and found


def test_bounds_are_safe():
    for size in range(1, 60):
        low, high = licenses.bounds(size)
        for n in range(1, 200):
            if 2 * min(n, size) / (n + size) >= 0.8:
                assert low <= n <= high


@pytest.mark.parametrize("name", ["Python", "Pandas", "Arrow"])
def test_plan_is_native(spark, name):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert name not in licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()


def test_marks_miss_no_match():
    rng = random.Random(6)
    for templates in (licenses.TEMPLATES, licenses.TEMPLATES[:1], (("x", "a b c d e f a b c d"),)):
        words = licenses.marks(templates)
        for _, notice in templates:
            for _ in range(300):
                own = licenses.words_of(notice)
                for _ in range(rng.randint(0, len(own) // 3)):
                    at = rng.randrange(len(own))
                    own[at : at + rng.randint(0, 2)] = rng.choice([[], ["qq"], ["qq", "zz"]])
                a, b = Counter(zip(own, own[1:])), Counter(zip(w := licenses.words_of(notice), w[1:]))
                if own and 2 * (a & b).total() >= 0.8 * (a.total() + b.total()):
                    said = " ".join(own)
                    assert any(lead in said and any(f"{a} {b}" in said for a, b in pairs) for lead, pairs in words.items())
