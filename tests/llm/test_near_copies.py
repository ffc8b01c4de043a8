"""Near-copies against a comparison of all pairs of sets of shingles."""

import random
import re

import numpy as np
import pytest
from framesift.llm import graph, near_copies, simhash


def plain_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_of(docs):
    """Positions of the documents that stay: of each component, linked by a similarity of 0.8 or more, the least (id, text)."""
    sets, root = [plain_shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [[i for i in range(len(docs)) if root[i] == r] for r in sorted(set(root))]


def corpus(seed):
    rng = random.Random(seed)
    kinds = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    vocabulary = [w for i, w in enumerate(kinds) for _ in range(1 + 120 // (i + 1))]
    docs = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(60, 160))
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 1, 6])):
            other = list(words)
            for _ in range(rng.randint(0, len(words) // 40)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            docs.append(" ".join(other))
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE  two"), (905, "one three"), (906, "x " * 9000)]


@pytest.mark.parametrize("group_shingles", [near_copies.GROUP_SHINGLES, 700])
def test_keep_one(spark, group_shingles):
    docs = corpus(5)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, fp string, node int").repartition(3)
    kept = near_copies.keep_one(frame, group_shingles=group_shingles)
    assert kept.columns == frame.columns
    found = sorted(r["doc_id"] for r in kept.collect())
    groups = kept_of(docs)
    wanted = {min(docs[i][0] for i in g) for g in groups}
    assert wanted <= set(found)  # nothing goes that has no near-copy
    assert len(found) - len(wanted) <= 0.05 * (len(docs) - len(wanted))  # candidates are within four bits, as nearly all near-copies are
    assert any(len(g) > 4 for g in groups)


def test_rows_of_one_id(spark):
    prose = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, prose("a"), "x"), (1, prose("b"), "x"), (1, prose("b"), "x"), (2, prose("b"), "x"), (3, prose("b") + " end", "x"), (None, prose("c"), "x"), (7, prose("c"), "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sorted(((r["doc_id"], r["text"][:2]) for r in near_copies.keep_one(frame).collect()), key=str)
    assert found == [(1, "a0"), (1, "b0"), (None, "c0")]
    assert near_copies.keep_one(frame.limit(0)).count() == 0


def test_forest():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) < 0.93], rng.integers(0, 1 << 40, 3).astype(np.uint64)]) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 40, 50).astype(np.uint64)) for _ in range(20)]
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    edges = list(near_copies.forest(sets))
    assert all(similar(sets[a], sets[b]) for a, b in edges)
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    assert len(edges) == len(sets) - len(set(root))


def test_across():
    """Links between a block and a group: every two parts that are similar somewhere are joined."""
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 40, 150).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.r_[base[i % 3][rng.random(len(base[i % 3])) < 0.95], rng.integers(0, 1 << 40, 2).astype(np.uint64)]) for i in range(45)]
    block, group, parts, others = sets[:15], sets[15:], list(range(15)), [100 + i % 7 for i in range(30)]
    similar = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    found = list(near_copies.across(block, group, parts, others))
    assert found and all(similar(block[x], group[y]) for x, y in found)

    def components(edges):
        root = {p: p for p in parts + others}
        for a, b in edges:
            x, y = root[a], root[b]
            root = {k: y if v == x else v for k, v in root.items()}
        return sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))

    wanted = [(parts[x], others[y]) for x in range(15) for y in range(30) if similar(block[x], group[y])]
    assert components(wanted) == components([(parts[x], others[y]) for x, y in found])
    assert not list(near_copies.across(block, group, [1] * 15, [1] * 30))


def chained(n, words, step):
    """Texts of which each has ``step`` words exchanged of the one before, so only neighbours are near."""
    rng = random.Random(3)
    text = [f"t{i}" for i in range(words)]
    out = []
    for k in range(n):
        for j in range(step):
            text[(k * step + j) * 7 % words] = f"x{k}{j}{rng.randint(0, 9)}"
        out.append(" ".join(text))
    return out


def test_no_link_is_lost_in_a_large_family(spark, monkeypatch):
    """A family in many groups, with two centres and a chain: whatever the central members miss is found."""
    monkeypatch.setattr(near_copies, "CENTRAL", 1)
    monkeypatch.setattr(near_copies, "links", lambda nodes, *_: nodes.crossJoin(nodes.agg({"node": "min"}).toDF("m")).selectExpr("m as a", "node as b"))  # one family
    one, two = " ".join(f"a{i}" for i in range(120)), " ".join(f"b{i}" for i in range(120))
    texts = [f"{one} {i}" for i in range(20)] + [f"{two} {i}" for i in range(20)] + chained(30, 100, 1)
    random.Random(1).shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r["doc_id"] for r in near_copies.keep_one(frame, group_shingles=400).collect()}
    assert found == {min(docs[i][0] for i in g) for g in kept_of(docs)}


def test_many_of_one_fingerprint(spark):
    """Ten thousand ids of one fingerprint, in small buckets: all are linked, with their neighbours, and it ends."""
    rows = [(i, 5, i * 77777, -i * 3) for i in range(10_000)] + [(20_000, 7, 1, 2), (20_001, -1, 1, 2), (20_002, -1, 1, 3), (20_003, -2, -1, -3)]
    nodes = spark.createDataFrame(rows, "node long, fp long, s0 long, s1 long")
    found = simhash.links(nodes, 64, "node", ["s0", "s1"], 32)
    roots = {r["node"]: r["root"] for r in graph.components(found).collect()}
    assert [roots[i] for i in (*range(10_000), 20_000)] == [0] * 10_001  # fp 7 is a neighbour of the crowd's
    assert roots[20_002] == 20_001 and 20_003 not in roots  # near by the fingerprint, but not by the sketches
