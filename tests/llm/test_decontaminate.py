"""Decontamination against a brute-force comparison of templates with a canonicaliser of its own."""

import random
from collections import Counter, defaultdict

from framesift.llm import decontaminate as de

ITEM = "A train leaves Boston at 5 pm and travels 60 miles in 2 hours before Alice boards the train in Boston again."
ITEMS = [
    (1, ITEM), (2, "the quick brown fox jumps over the lazy dog while many other foxes watch from the hill"),
    (3, "too short item"), (4, None), (5, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT"), (6, "no item"), (7, "four words make one"),
    (8, "Yes."), (9, "90miles"), (10, "..."),
]
FILL = "lorem ipsum dolor sit amet consectetur "
OTHER = "A train leaves Denver at 7 pm and travels 90 miles in 3 hours before Carol boards the train in Denver again."
MIXED = OTHER.replace("Denver again", "Chicago again")
DOCS = [
    (1, FILL + ITEM + " " + FILL), (2, OTHER), (3, MIXED), (4, FILL * 200 + ITEMS[1][1].upper().lower().replace(" ", "\n\t") + FILL), (5, "the quick brown fox jumps over the lazy cat"),
    (6, FILL), (7, None), (8, ""), (9, "ONE TWO THREE FOUR FIVE SIX SEVEN NINE TEN"), (10, "one two three four five six seven eight"),
    (None, ITEMS[1][1]), (11, ITEMS[1][1]), (11, ITEMS[1][1]), (11, "clean text that is fine by any measure"), (12, FILL + "Too short, item! " + FILL), (13, "too short an item"), (14, "no item"),
    (15, MIXED + " " + FILL + OTHER), (16, "so four words make one whole"), (17, ITEM.upper()), (18, OTHER.replace("90 miles", "90miles").replace("3 hours", "three hours")),
    (19, ITEM.replace("Boston", "New York").replace("60", "12 500")), (20, ITEM.replace("Boston", "New York", 1).replace("Boston", "San Jose")), (21, "ONE 5 TWO 60 THREE 2 FOUR HOURS FIVE"),
    (22, "is it so?\n - YES! -\n\nand on"), (23, "yes it is\nor yes\n"), (24, "no\nitem"), (25, f"{FILL}\nNo item"), (26, "- 90 miles -\n"), (27, "90\nmiles"), (28, "yes"),
]

NUMBERS = {"one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"}
UNITS = {"miles", "hours"}


def canonical(text, view):
    """Words as (said, kind, value) in a view; kinds are l, #, N and u."""
    out = []
    for word in (text or "").replace("90miles", "90 miles").split():
        bare = word.strip(".,!?-")
        if not bare:
            continue
        low = bare.lower()
        kind = "u" if low in UNITS else "#" if low in NUMBERS or bare.isdigit() else "N" if bare[0].isupper() else "l"
        if view == de.ANY_CASE and kind == "N":
            kind = "l"
        if view == de.RUNS and kind in "#N" and out and out[-1][0] == kind:
            out[-1] = (kind, f"{out[-1][1]} {low}")
        else:
            out.append((kind, low))
    return out


def windows(text, view):
    """(window, at, slots) of a text; slots are (place, value)."""
    if 10 < view < 13:  # whole lines
        lines = [canonical(line, de.ANY_CASE) for line in (text or "").split("\n")]
        return [(("said", *(v for _, v in w)), 0, []) for w in lines if len(w) == view - 10]
    words = canonical(text, view if view < 3 else de.ANY_CASE)
    size = 5 if view < 3 else view - 10
    out = []
    for i in range(len(words) - size + 1):
        w = words[i : i + size]
        if size == 5 and any(k == "l" for k, _ in w):
            out.append((tuple(v if k == "l" else k for k, v in w), i, [(i + j, v) for j, (k, v) in enumerate(w) if k != "l"]))
        else:
            out.append((("said", *(v for _, v in w)), i, []))
    return out


def judged(doc, item, view):
    """(n_windows, n_found, consistency) or None."""
    if view >= 3 and len(canonical(item, de.ANY_CASE)) != view - 10:
        return None
    own, other = windows(doc, view), windows(item, view)
    keys = {w for w, *_ in other}
    n = len(keys & {w for w, *_ in own})
    if not keys or n < 0.8 * len(keys):
        return None
    pairs = [(w, at - i, slots, item_slots) for w, at, slots in own for v, i, item_slots in other if v == w]
    by_shift = defaultdict(set)
    for w, shift, *_ in pairs:
        by_shift[shift].add(w)
    copies = [s for s, held in by_shift.items() if len(held) >= 0.8 * len(keys)]
    groups = [[p for p in pairs if p[1] == s] for s in copies] or [pairs]
    return len(keys), n, max(map(agreement, groups))


def agreement(pairs):
    """The share of repeated values that have one value."""
    values, places = defaultdict(Counter), defaultdict(list)
    for _, _, slots, item_slots in pairs:
        for (place, value), (_, found) in zip(item_slots, slots):
            values[place, value][found] += 1
    for (_, value), c in values.items():
        places[value].append(max((n, v) for v, n in c.items())[1])
    several = [len(set(v)) == 1 for v in places.values() if len(v) > 1]
    return sum(several) / len(several) if several else 1.0


def brute():
    found = set()
    for doc_id, text in DOCS:
        for item_id, item in ITEMS:
            seen = [(view, m) for view in (0, 1, 2, 11, 12, 13, 14) if (m := judged(text, item, view))]
            shown = [m for view, m in seen if m[2] >= 0.8 and (view != de.RUNS or seen[0][0] != de.TEMPLATE)]
            if shown:
                n_windows, n, consistency = shown[0]
                found.add((doc_id, item_id, n_windows, n, n / n_windows, consistency))
    return found


LEAKED = {1, 2, 4, None, 10, 11, 12, 14, 15, 16, 17, 18, 19, 22, 25, 26, 28}


def test_query(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    found = [tuple(r) for r in de.query(docs, items).collect()]
    assert set(found) == brute() and len(found) == len(set(found))
    assert {d for d, *_ in found} == LEAKED
    clean = de.keep_clean(docs, items)
    assert clean.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in clean.collect()), key=str) == sorted((d for d in DOCS if d[0] not in LEAKED or d[1].startswith("clean")), key=str)


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert de.query(docs.limit(0), items).count() == 0
    assert de.query(docs, items.limit(0)).count() == 0
    assert de.keep_clean(docs, items.limit(0)).count() == len(DOCS)


def test_other_values_are_found(spark):
    """Questions with other numbers, names and units, longer names, numbers in words or joined to units, or in another case: nine in ten are found, and none whose values don't agree."""
    rng = random.Random(11)
    verbs, things = ["buys", "sells", "finds", "carries", "packs"], ["apples", "books", "stones", "chairs", "boxes", "pens"]
    names = ["Anna", "Boris", "Clara", "David", "Edgar", "Fiona"]
    forms = [
        "{a} {v} {n} {t} on Monday and walks {m} km to the market near {c} where {b} {w} {k} {s} for the children of {c} . How many {t} does {a} still have if {b} takes half of them away",
        "In {c} a worker paints {n} walls within {m} hours while {a} and {b} watch the {t} near the old gate . How long would {a} need for {k} walls of the same size in {c} when {b} doesn't help",
    ]
    in_words = {2: "two", 3: "three", 5: "five", 9: "nine"}

    def made(i, values):
        r = random.Random(i)
        return r.choice(forms).format(v=r.choice(verbs), w=r.choice(verbs), t=r.choice(things), s=r.choice(things), **values)

    def values():
        a, b, c = rng.sample(names, 3)
        return {"a": a, "b": b, "c": c, "n": rng.randint(2, 99), "m": rng.randint(2, 99), "k": rng.randint(2, 99)}

    items = [(i, made(i, values())) for i in range(40)]
    docs = []
    for i in range(40):
        long = {**values(), "c": "New York", "a": "Mary Ann"}
        spelled = {**values(), "n": in_words[rng.choice([2, 3, 5, 9])]}
        joined = made(i, values()).replace(" km", "km").replace(" hours", "hours")
        docs += [(100 * i + k, f"Some words before. {t} And some after.") for k, t in enumerate((made(i, values()), made(i, long), made(i, spelled), joined, items[i][1].upper(), items[i][1].lower()))]
    mixed = [(10_000 + i, made(i, v | {"c": "Oslo", "a": "Gustav"}).replace("Oslo", "Riga", 1).replace("Gustav", "Henry", 1)) for i, v in ((i, values()) for i in range(40))]
    found = de.query(spark.createDataFrame(docs + mixed, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    for k in range(6):
        assert sum((100 * i + k, i) in pairs for i in range(40)) >= 36, k
    assert not [p for p in pairs if p[0] >= 10_000]


def test_filter(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    import numpy as np

    passes = de.filter_of(spark.createDataFrame([(h,) for h in hashes], "window long"))
    assert len(passes(np.array(hashes, np.int64).view(np.uint64))) == 3000
    assert len(passes(np.array([rng.getrandbits(64) for _ in range(20_000)], np.uint64))) < 100


def test_the_filter_comes_to_the_driver_in_parts(spark, monkeypatch):
    monkeypatch.setattr(de, "FILTER_WORDS", 8)
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(500)]
    passes = de.filter_of(spark.createDataFrame([(h,) for h in hashes], "window long"))
    assert len(passes.bits) > 8
    known = de.np.array(hashes, "<i8").view("<u8")
    assert len(passes(known)) == len(hashes)
    expected = de.np.zeros(len(passes.bits), de.np.uint64)
    for h in known.tolist():
        for place in (h & int(passes.low), h >> 32 & int(passes.low)):
            expected[place >> 6] |= de.np.uint64(1 << (place & 63))
    assert passes.bits.tolist() == expected.tolist()


def test_what_leaks_is_written_before_it_is_joined(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    clean = de.keep_clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    plan = clean._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
