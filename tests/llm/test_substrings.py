"""Repeated passages against a brute-force search over all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from framesift.llm import substrings


def brute(rows):
    docs = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, (rows[i][1] or "").encode()))
    seen, out = {}, [None] * len(rows)
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", rows[i][1] or "") if w] for i in range(len(rows))]
    for i in docs:
        for s in range(len(split[i]) - 19):
            seen.setdefault(tuple(split[i][s : s + 20]), (i, s))
    for i in docs:
        words = split[i]
        gone = set()
        for s in range(len(words) - 19):
            if seen[tuple(words[s : s + 20])] != (i, s):
                gone.update(range(s, s + 20))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (rows[i][0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é\xa0x", " ", "Ω"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(n) for n in (19, 20, 21, 40, 75)]
    rows = []
    for i in range(60):
        words = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            words += p[a : len(p) - rng.randint(0, 5)] + prose(rng.randint(0, 8))
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    whole = " ".join(prose(50))
    rows += [(100, whole), (101, whole), (101, whole), (101, whole + " x"), (7, whole), (200, "a " * 60), (201, "a b c " * 30), (202, None), (203, ""), (204, " \n"), (None, " ".join(passages[4]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "shard_bytes"), [(1, 1 << 20), (2, 2000)])
def test_query(spark, seed, shard_bytes):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    found = sorted((tuple(r) for r in substrings.query(docs, shard_bytes).collect()), key=str)
    assert found == brute(rows)
    assert any(r[2] for r in found)


def test_remove(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(2, f"new  {passage} end", 5), (1, f"a\n{passage}", 6), (3, None, 7)], "doc_id long, text string, t int")
    out = {r["doc_id"]: (r["text"], r["t"]) for r in substrings.remove(docs).collect()}
    assert out == {1: (f"a\n{passage}", 6), 2: ("new end", 5), 3: (None, 7)}
    assert substrings.query(docs.limit(0)).count() == 0


def test_anchors():
    hashes = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    width = substrings.WINDOW - substrings.PHRASE + 1
    expected = [s + int(np.argmin(hashes[s : s + width])) for s in range(len(hashes) - width + 1)]
    assert substrings._anchors(hashes).tolist() == expected


def test_the_automaton_decides(monkeypatch):
    """Without one of its phrases a shard finds fewer windows, and a phrase that isn't what its hash says is not taken."""
    passage = " ".join(f"p{i}" for i in range(45))
    texts = [f"one {passage} two", f"three {passage} four", "words without any passage that is repeated anywhere else in these texts " * 2]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int32()), pa.array([1, 2, 3]), pa.array(texts)], ["shard", "rid", "t"])
    rows = pa.Table.from_batches(list(substrings._anchor_rows([batch])))
    phrases = rows.filter(pc.and_(pc.greater(rows.column("n"), 1), pc.less(rows.column("rid"), 3))).select(["shard", "phrase", "rid", "place"])
    docs = pa.table({"rid": [1, 2], "t": [zstandard.compress(t.encode()) for t in texts[:2]]})
    whole = substrings._locate(docs, phrases)
    windows = lambda t: sum(t.column("n").to_pylist()) + sum(map(len, t.column("w1").to_pylist()))
    assert sum(whole.column("n").to_pylist()) == 45 - 19 and phrases.num_rows > 2
    for k in range(phrases.num_rows):
        less = substrings._locate(docs, pa.concat_tables([phrases.slice(0, k), phrases.slice(k + 1)]))
        assert windows(less) < windows(whole)
    wrong = phrases.set_column(3, "place", pa.array([0] * phrases.num_rows, pa.int32()))
    assert windows(substrings._locate(docs, wrong)) < windows(whole)
    monkeypatch.setattr(substrings, "PORTION", 30)  # a text or two at a time give the same
    assert sorted(map(str, substrings._locate(docs, phrases).to_pylist())) == sorted(map(str, whole.to_pylist()))
    few = pa.Table.from_batches(list(substrings._anchor_rows([batch])))
    assert sum(few.column("n").to_pylist()) == sum(rows.column("n").to_pylist()) and set(few.column("phrase").to_pylist()) == set(rows.column("phrase").to_pylist())
