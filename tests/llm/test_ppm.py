"""PPM scores against a plain trie walk, and held-out text against a shuffled one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from framesift.llm import ppm


def plain(rows):
    trie = defaultdict(Counter)
    counts, n_train = Counter(), 0
    prepared = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        tokens = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w] + [None]
        out = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1
        symbols = [255] * ppm.ORDER + [*raw, 254]
        prepared.append((doc_id, out, tokens, symbols))
        if not out:
            counts.update(tokens)
            for i in range(ppm.ORDER, len(symbols)):
                for k in range(ppm.ORDER + 1):
                    trie[tuple(symbols[i - k : i])][symbols[i]] += 1
    total, distinct = counts.total(), len(counts)

    def log_p(context, symbol):
        excluded, p = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            here = {s: n for s, n in trie.get(tuple(context[ppm.ORDER - k :]), {}).items() if s not in excluded}
            if not here:
                continue
            t = sum(here.values()) + len(here)
            if symbol in here:
                return p + math.log10(here[symbol] / t)
            p += math.log10(len(here) / t)
            excluded |= here.keys()
        return p - math.log10(255 - len(excluded))

    result = []
    for doc_id, out, tokens, symbols in prepared:
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        score = sum(log_p(symbols[i - ppm.ORDER : i], symbols[i]) for i in range(ppm.ORDER, len(symbols)))
        result.append((doc_id, out, len(tokens), sum(counts[t] > 0 for t in tokens), total, base, score))
    return result


def corpus():
    rng = random.Random(4)
    vocabulary = ["The", "cat", "hât", "sat", "on", "MAT", "42", "日本"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    return [*rows, (None, "cat cat"), (3, "again"), (3, "again"), (50, None), (51, ""), (52, " \n"), (53, "unseen żółw " * 3)]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 500])
def test_query(spark, shard_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    found = sorted(map(tuple, ppm.query(docs, shard_bytes).collect()), key=lambda r: (str(r[0]), r[2]))
    expected = sorted(plain(rows), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)
    assert any(r[1] for r in found)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    longest = rng.integers(0, 3, (5, 256)) * (rng.random((5, 256)) < 0.05)
    longest[:, ppm.PAD] = 0
    longest[0] = 0
    two = longest.sum(0)
    one = two + rng.integers(0, 2, 256) * (np.arange(256) != ppm.PAD)
    none = one * 2
    p = 10 ** ppm.code_lengths(longest, [two, one, none])[:, :255]
    assert np.allclose(p.sum(1), 1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ppm.query(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = ppm.query(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert alone["train_tokens"] == alone["n_known"] == 0
    assert math.isclose(alone["score"], -3 * math.log10(255)) and math.isclose(alone["base_score"], 0.0)
