"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import xxhash
from framesift.llm import simhash


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if ((a ^ prints[j]) % (1 << 64)).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_prints(n, seed, members=60):
    """Random fingerprints, dense groups and chains around some of them."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for centre in out[:5]:
        flips = rng.sample(range(64), 12)
        for _ in range(members):
            out.append(centre ^ sum(1 << b for b in rng.sample(flips, rng.randint(0, 4))))
    chain = out[10]
    for _ in range(20):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        out.append(chain)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def check_groups(spark, prints, bucket):
    rows = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    found = {r["fp"]: r["component_id"] for r in simhash.groups(rows, bucket=bucket).collect()}
    roots, least = brute_components(prints), {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert [found[p] for p in prints] == [least[r] for r in roots]


def test_fingerprint():
    texts = ["", " \n", "One", "one two three", "A b  c d e\x0bf g h", "ÄB c ä D e F g", "x " * 300, "a b c d " * 20 + "e"]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_groups(spark):
    check_groups(spark, near_prints(300, 1), simhash.BUCKET)


def test_large_buckets_are_indexed_anew(spark):
    check_groups(spark, near_prints(100, 2, 20), 16)


def test_long_run_is_a_spanning_forest():
    prints = np.unique(np.array([p % (1 << 64) for p in near_prints(100, 3)], np.uint64))
    edges = list(simhash._long_run(prints.view(np.int64), [prints]))
    roots = brute_components(prints.view(np.int64).tolist())
    assert len(edges) == len(prints) - len(set(roots))


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(3, None, "x"), (1, "", "y"), (2, " \t", "z"), (None, "one two three four five", "n"), (9, "One two three FOUR five", "a"), (9, "One two three FOUR five", "b"), (4, "q " * 50_000, "c")],
        "doc_id long, text string, fp string",
    )
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.query(docs).collect()}
    assert {(3, "0" * 16, 1), (1, "0" * 16, 1), (2, "0" * 16, 1)} <= found
    assert {c for i, _, c in found if i in (None, 9)} == {9}
    assert simhash.query(docs.limit(0)).count() == 0
