"""Quality rules against a plain count."""

import random
import re

import pytest
from framesift.llm import quality

TEXTS = [
    None, "", " \n", "word", "a b c " * 30, "one\ntwo\none\n\nthree\n one", "# * $ %% a|b <c> " * 10, "LOUD!! WORDS!! " * 40,
    "x" * 50_000, "\x0b\x0c\r\t word\xa0one two", "a a a a a", "né\nné\nné\nné\nok", "a b c d a b c e f",
]
TEXTS += [" ".join(f"word{i}" for i in range(80)) + "."]
_rng = random.Random(2)
TEXTS += [" ".join(_rng.choice(["aa", "b", "#c", "dé", "E!!", "\n", "aa\nb"]) for _ in range(_rng.randint(1, 150))) for _ in range(60)]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    duplicates = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 3)}
    n = len(words)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    capitals = sum(len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z]", w) for w in words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), duplicates, len(repeated), letters, capitals, n < 50 or 100 * len(repeated) > 50 * n


def test_query(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[3], 1), (None, TEXTS[4], 1)], "doc_id long, text string, n_words int")
    found = sorted((tuple(r)[:11] for r in quality.query(docs).collect()), key=str)
    expected = sorted(((i, *plain(t)) for i, t in [*enumerate(TEXTS), (0, TEXTS[3]), (None, TEXTS[4])]), key=str)
    assert [r[:10] for r in found] == expected
    assert not any(r[9] and r[10] for r in found) and any(r[10] for r in found)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[10] for r in found)
    assert quality.query(docs.limit(0)).count() == 0


def test_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = quality.ledger(docs)
    bits = [r["fail_bits"] for r in ledger.collect()]
    for r in quality.ablation(ledger).collect():
        bit = quality.BITS[r["rule"]]
        assert r["n_failed"] == sum(b & bit > 0 for b in bits)
        assert r["n_failed_alone"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(b & ~bit == 0 for b in bits)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, n_words int")
    with pytest.raises(ValueError, match="n_words"):
        quality.ledger(docs, ["doc_id", "n_words"])


def test_ablation_reads_the_ledger(spark, tmp_path):
    """All versions are judged from the written ledger, whose plan has no texts and no Python."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = quality.ablation_query(docs)
    plan = found._jdf.queryExecution().toString()
    assert "text#" not in plan and "MapInArrow" not in plan
    bits = [r["fail_bits"] for r in quality.ledger(docs).collect()]
    rows = {(r["version"], r["rule"]): r for r in found.collect()}
    assert sorted({v for v, _ in rows}) == sorted(quality.POLICIES)
    for (version, rule), r in rows.items():
        mask, bit = quality.POLICIES[version], quality.BITS[rule]
        assert mask & bit
        assert r["n_kept_without"] == sum(b & mask & ~bit == 0 for b in bits)
        assert r["n_failed"] == sum(b & bit > 0 for b in bits)


def test_long_words_are_not_kept(spark):
    """Words of a megabyte in many rows stay out of the caches of words."""
    from framesift.llm import decontaminate, near_copies, substrings

    for cache, key in ((quality._signs, b"x" * 10_000), (near_copies._hashes, b"x" * 10_000), (substrings._hashes, b"x" * 10_000), (decontaminate._kinds, b"x" * 10_000)):
        before = len(cache)
        assert cache[key] == cache[key] and len(cache) == before
    docs = spark.createDataFrame([(i, f"{i}" + "y" * 1_000_000) for i in range(8)], "doc_id long, text string")
    assert {r["n_words"] for r in quality.query(docs).collect()} == {1}
