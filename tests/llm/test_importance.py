"""The draw towards a target against a plain one, and words and their CRCs against regular expressions and zlib."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from framesift.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = random.Random(5)
TEXTS = [
    None, "", " \n", "word", "Ångström ÅNGSTRÖM naïve", "a-b_c`d{e", "x" * 5000 + " " + "Y" * 200, "end", "start 0 9 : ; @ A Z [ a z", "日本語 テキスト", "\0nul\0",
    *(" ".join(_rng.choice(["Alpha", "beta", "γάμμα", "x1", "LONG" * 30, "-", "'", "e"]) for _ in range(_rng.randint(1, 60))) for _ in range(80)),
]


def words(text):
    return WORDS.findall((text or "").translate(SMALL))


def bucket(word):
    return zlib.crc32(word.encode()) % importance.BUCKETS


def plain(docs, target, least=20, percent=10):
    source, aim = [0] * importance.BUCKETS, [0] * importance.BUCKETS
    for counts, texts in ((source, [t for _, t in docs]), (aim, target)):
        for text in texts:
            for word in words(text):
                counts[bucket(word)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(source) + importance.BUCKETS) / ((s + 1) * (sum(aim) + importance.BUCKETS)))) for s, t in zip(source, aim)]
    rows = []
    for doc_id, text in docs:
        found = words(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(able[: len(able) * percent // 100]):
        row[4] = place + 1
    return rows


def listed(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_words_and_crcs():
    """Slices of buffers, too: their first text doesn't begin at 0."""
    texts = pa.array([t or "" for t in TEXTS])
    for part in (texts, texts.slice(3, 9), texts.slice(len(texts)), texts.cast(pa.large_string()).slice(2)):
        expected = [(bucket(w), i) for i, t in enumerate(part.to_pylist()) for w in words(t)]
        assert [(int(b), int(d)) for bs, ds in importance.features(part) for b, d in zip(bs, ds)] == expected


def test_portions(monkeypatch):
    monkeypatch.setattr(importance, "PORTION", 7)
    texts = pa.array([t or "" for t in TEXTS])
    found = [(int(b), int(d)) for bs, ds in importance.features(texts) for b, d in zip(bs, ds)]
    assert found == [(bucket(w), i) for i, t in enumerate(texts.to_pylist()) for w in words(t)]


def test_crc_table():
    assert [int(c) for c in importance.crcs(np.frombuffer(b"abcXYZ", np.uint8), np.array([0, 3]), np.array([3, 6]))] == [zlib.crc32(b"abc"), zlib.crc32(b"xyz")]


def test_draw(spark):
    docs = [*enumerate(TEXTS), (3, TEXTS[20]), (3, TEXTS[20]), (None, TEXTS[21]), (None, None)]
    target = ["beta γάμμα x1", None, "beta beta Unknown"]
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, weight string").repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    assert listed(importance.resampled(rows, aims)) == sorted(map(tuple, plain(docs, target)), key=str)
    assert listed(importance.resampled(rows, aims, least_words=1, percent=60)) == sorted(map(tuple, plain(docs, target, 1, 60)), key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert importance.query(none, some).count() == 0
    assert listed(importance.query(some, none)) == sorted(map(tuple, plain([(1, "a b " * 20), (2, None)], [])), key=str)


def test_hot_document(spark):
    """A third of all rows are one document: all of them are drawn or not by their places."""
    docs = [(7, "same words here " * 10)] * 300 + [(i, f"word{i} other text " * 10) for i in range(600)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    aims = spark.createDataFrame([("same words",)], "text string")
    assert listed(importance.query(rows, aims)) == sorted(map(tuple, plain(docs, ["same words"])), key=str)
