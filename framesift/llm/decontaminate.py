"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders, so a question keeps its template when its values
are exchanged; numbers may be spelled out, and a unit may be joined to its number. Windows of ``WINDOW`` words of the
templates are joined by hash. A document leaks an item if it holds 80 % of the item's windows and the values that
stand in the slots agree: where a value of the item stands in several places, one and the same value has replaced it
there.

A text is windowed in three views, and any of them may show a leak: its template; the template in any case, where
names are words like others, as capitals don't tell them; and the template with each run of names or numbers as one
slot, as a name may be replaced by a longer one. An item of fewer than ``WINDOW`` words is one window of its own, and
one of one or two words, which any text may hold, is looked for as a whole line.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import id_of, saved, text_of

WINDOW = 5
#: Windows with fewer literal words keep their values: placeholders alone say nothing.
LITERALS = 1
CONTAINMENT = CONSISTENCY = 0.8
#: Items of fewer words are leaked by a line of their own only.
IN_LINES = 3
#: Bits of the filter of windows for each window of an item, and at most: 64 to a window make one in a thousand other windows pass; in 128 MB, 16 million windows have as many.
FILTER_BITS, MOST_FILTER_BITS = 64, 1 << 30
#: Words of the filter that come to the driver at once: 16 MB with their places.
FILTER_WORDS = 1 << 20

#: Characters of text that are windowed at once, words whose kinds a Python worker keeps, and bytes of the longest.
PORTION, KNOWN_WORDS, KNOWN_LENGTH = 2 << 20, 200_000, 64

LITERAL, NUMBER, NAME, UNIT = range(4)
TEMPLATE, ANY_CASE, RUNS = VIEWS = range(3)
#: The views of short items: their words above a number that no other view has.
_SHORT = 10
SHORT = range(_SHORT + 1, _SHORT + WINDOW)
#: Stands for the place of windows that are in no copy with enough of them.
SCATTERED = -(1 << 60)
#: Runs of more words are compared by hash.
RUN_WORDS = 16
#: Units of measure.
UNITS = frozenset(
    "% mm cm m km inch inches ft foot feet yd yard yards mi mile miles g gram grams kg kilogram kilograms mg lb lbs pound pounds oz ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur gbp w kw watt watts v volt volts j joule joules n newton newtons hz khz mhz °c °f degree degrees mph km/h m/s".split()
)
#: Numbers in words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
_JOINED = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([^\W\d_]+)")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGES = " .,;:!?\"'()[]{}<>|*#&“”‘’«»…-–—_"
_ODD = [np.uint64(xxhash.xxh64_intdigest(f"template {i}") | 1) for i in range(2 * WINDOW + 1)]
#: Keeps the windows of the views apart.
_SALTS = {view: np.uint64(xxhash.xxh64_intdigest(f"view {view}")) for view in (*VIEWS, *SHORT)}
_KINDS = np.array([xxhash.xxh64_intdigest(f"kind {i}") for i in range(4)], np.uint64)


def kind_of(word: str) -> tuple[str, int]:
    """A word without marks and in lower case, and its kind."""
    bare = word if word.isalpha() else word.strip(_EDGES)
    lower = bare.lower()
    if lower in UNITS:
        return lower, UNIT
    if lower in NUMBER_WORDS or not bare.isalpha() and (_NUMBER.fullmatch(bare) or NUMBER_WORDS.issuperset(lower.split("-"))):
        return lower, NUMBER
    return lower, NAME if bare[:1].isupper() else LITERAL


def halves_of(word: bytes) -> tuple[bytes, bytes] | None:
    """The number and the unit of a word that holds both, like 60miles; None for any other."""
    found = _JOINED.fullmatch(word.decode().strip(_EDGES))
    return (found[1].encode(), found[2].encode()) if found and found[2].lower() in UNITS else None


class _Kinds(dict):
    """Word to its hash, with the kind in the two lowest bits; 0 for a word of marks only, ``TWO`` for a number joined to its unit."""

    TWO = 1

    def __missing__(self, word: bytes) -> int:
        lower, kind = kind_of(word.decode())
        two = not lower.isalpha() and halves_of(word)
        value = self.TWO if two else (xxhash.xxh64_intdigest(lower) & ~3 | kind) if lower else 0
        if len(word) <= KNOWN_LENGTH:
            if len(self) > KNOWN_WORDS:
                self.clear()
            self[word] = value
        return value


_kinds = _Kinds()


def _forget() -> None:
    """Empty the cache: the worker may serve other stages."""
    _kinds.clear()


class Windows:
    """All template windows of some texts; windows and words of all texts stand in one row of arrays."""

    def __init__(self, texts: list[str], view: int = TEMPLATE, lines: bool = False):
        split = [t.encode().split() for t in texts]
        self.words = list(itertools.chain.from_iterable(split))
        in_lines = [len(line.split()) for t in texts for line in t.encode().split(b"\n")] if lines else [len(self.words)]
        line = np.repeat(np.arange(len(in_lines)), in_lines)
        codes = np.array(list(map(_kinds.__getitem__, self.words)), np.uint64)
        text = np.repeat(np.arange(len(texts)), list(map(len, split)))
        joined = np.flatnonzero(codes == _Kinds.TWO)
        if len(joined):
            for i in joined.tolist():
                self.words[i] = halves_of(self.words[i])
            self.words = [x for w in self.words for x in (w if isinstance(w, tuple) else (w,))]
            codes = np.array(list(map(_kinds.__getitem__, self.words)), np.uint64)
            text, line = np.insert(text, joined, text[joined]), np.insert(line, joined, line[joined])
        if not codes.all():
            self.words, text, line, codes = [w for w, c in zip(self.words, codes.tolist()) if c], text[codes > 0], line[codes > 0], codes[codes > 0]
        #: Where lines begin, if they were asked for, with the end of the last.
        self.line_starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1], True]) if len(line) else np.zeros(1, np.int64)
        self.n_texts, self.codes, self.text_of_word = len(texts), codes >> np.uint64(2), text
        self.kind_of_word = (codes & np.uint64(3)).astype(np.int8)
        self.look(view)

    def look(self, view: int) -> Windows:
        """Put the windows of a view in place."""
        size = view - _SHORT if view in SHORT else WINDOW
        codes, self.kinds, text = self.codes, self.kind_of_word, self.text_of_word
        #: Where each of the view's words begins among all words.
        self.starts = None
        if view == RUNS and len(codes):
            goes_on = (self.kinds[1:] == self.kinds[:-1]) & ((self.kinds[1:] == NAME) | (self.kinds[1:] == NUMBER)) & (text[1:] == text[:-1])
            self.starts = np.flatnonzero(np.r_[True, ~goes_on])
            codes, self.kinds, text = np.add.reduceat(codes, self.starts), self.kinds[self.starts], text[self.starts]
        self.literal = self.kinds == LITERAL
        if view == ANY_CASE:
            self.literal |= self.kinds == NAME
        #: Where each text's words begin, and how many it has.
        self.begins = np.searchsorted(text, np.arange(self.n_texts))
        self.sizes = np.bincount(text, minlength=self.n_texts)
        n = max(0, len(codes) - size + 1)
        template = np.where(self.literal, codes, _KINDS[self.kinds])
        said = np.cumsum(np.r_[0, self.literal])
        #: Windows with placeholders.
        self.open = (said[size:] - said[:-size] >= LITERALS) & (size == WINDOW) if n else np.empty(0, bool)
        mixed = np.zeros(n, np.uint64)
        for j in range(size):
            mixed += template[j : j + n] * _ODD[j]
        closed = np.flatnonzero(~self.open)
        mixed[closed] = 0
        for j in range(size):
            mixed[closed] += codes[closed + j] * _ODD[WINDOW + j]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD[-1]
        self.hashes = mixed ^ mixed >> np.uint64(32) ^ _SALTS[view]
        self.text = text[:n]
        #: Windows within one text; the others only fill the row.
        self.whole = text[:n] == text[size - 1 :] if n else np.empty(0, bool)
        return self

    def whole_lines(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those of the windows of ``size`` words at some places that are lines."""
        begin = np.searchsorted(self.line_starts, at)
        is_start = self.line_starts[np.minimum(begin, len(self.line_starts) - 1)] == at
        ends = self.line_starts[np.minimum(begin + 1, len(self.line_starts) - 1)]
        return at[is_start & (ends == at + size)]

    def value(self, j: int) -> str:
        """What stands at a place of the view."""
        if self.starts is None:
            return kind_of(self.words[j].decode())[0]
        end = int(self.starts[j + 1]) if j + 1 < len(self.starts) else len(self.words)
        run = " ".join(kind_of(w.decode())[0] for w in self.words[int(self.starts[j]) : end])
        return run if end - self.starts[j] <= RUN_WORDS else xxhash.xxh64_hexdigest(run)


class Filter:
    """A table of bits, two for each known hash; it passes all known hashes and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.low = bits, np.uint64(64 * len(bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.has(hashes & self.low))
        return at[self.has(hashes[at] >> np.uint64(32) & self.low)]

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.bits[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame) -> Filter:
    """The filter of a column of different hashes. Its words are put together by Spark, and come to the driver ``FILTER_WORDS`` at once."""
    size = 64
    while size < min(FILTER_BITS * hashes.count(), MOST_FILTER_BITS):
        size *= 2
    places = hashes.select(F.explode(F.array(*(F.shiftrightunsigned("window", by).bitwiseAND(F.lit(size - 1)) for by in (0, 32)))).alias("place"))
    words = saved(places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")))
    bits = np.zeros(size // 64, np.uint64)
    for first in range(0, len(bits), FILTER_WORDS):
        some = words.where(F.col("word").between(first, first + FILTER_WORDS - 1)).toArrow()
        bits[some.column("word").to_numpy()] = some.column("bits").to_numpy().view(np.uint64)
    return Filter(bits)


def _portions(keys: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch, a few megabytes of text at a time."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > PORTION:
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]


_ROWS = "view int, window long, at long, places array<long>, values array<string>"


def _window_rows(known, views: tuple[int, ...]):
    """(key, text) to (key, view, window, at, places, values): where each window begins, and its slots' places and values; only windows that pass ``known``, if given, else short ones of texts as short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = known.value if known else None
        for batch in batches:
            for keys, texts in _portions(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                all_ = Windows(texts, lines=bool(passes) and any(_SHORT < view < _SHORT + IN_LINES for view in views))
                for view in views:
                    all_.look(view)
                    at = passes(all_.hashes) if passes else np.arange(len(all_.hashes))
                    at = at[all_.whole[at]]
                    if not passes and view in SHORT:
                        at = at[all_.sizes[all_.text[at]] == view - _SHORT]
                    elif _SHORT < view < _SHORT + IN_LINES:
                        at = all_.whole_lines(at, view - _SHORT)
                    text = all_.text[at]
                    own, places, values = [], [], []
                    for i, x, open_ in zip(at.tolist(), text.tolist(), all_.open[at].tolist()):
                        slots = [j for j in range(i, i + WINDOW) if not all_.literal[j]] if open_ else []
                        own.append(keys[x])
                        places.append([j - int(all_.begins[x]) for j in slots])
                        values.append([all_.value(j) for j in slots])
                    columns = [pa.array(own, batch.schema.types[0]), pa.array([view] * len(own), pa.int32()), pa.array(all_.hashes[at].view(np.int64)), pa.array(at - all_.begins[text], pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "view", "window", "at", "places", "values"])
        _forget()

    return run


def template_windows(rows: DataFrame, known=None, views: tuple[int, ...] = VIEWS) -> DataFrame:
    """Windows of ``rows`` (key, t) in the views: key, view, window, its place, and the places and values of its slots."""
    key = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "t").mapInArrow(_window_rows(known, tuple(views)), f"key {key}, {_ROWS}")


def _keys(items: DataFrame) -> DataFrame:
    """(view, window, item_id): of each item the windows that fewest items have, as many as any document with enough of its windows must have one of."""
    each = items.select("item_id", "view", "window").distinct()
    shared = each.groupBy("view", "window").agg(F.count("*").alias("n_items"))
    of_item = Window.partitionBy("item_id", "view")
    ranked = each.join(shared, ["view", "window"]).withColumn("rank", F.row_number().over(of_item.orderBy("n_items", "window"))).withColumn("n", F.count("*").over(of_item))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(CONTAINMENT * F.col("n")) + 1).select("view", "window", "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``key`` (id and text hash), item_id, and how much of the item the document holds.

    n_windows and n_found count windows of the item; containment is their quotient; consistency is the share
    of the item's repeated values that have one value in the document (1 if there are none). Each copy that holds enough
    of the windows by itself is judged by itself, and the best one counts; without such a copy all windows are judged
    together. Only leaks are returned, with the measures of the first view that shows them; runs as one slot count
    only where the template holds too few windows, so they don't overrule its values. Null texts leak nothing, and
    items without words are not leaked; a shorter item than ``WINDOW`` is leaked by its words in order, in any case, one of
    fewer than ``IN_LINES`` words only by a line that has no others. Equal rows count as one; empty tables give an
    empty result. Items with one item_id count as one item.
    """
    items = saved(template_windows(benchmark.select(F.col("item_id").cast("long").alias("key"), text_of().alias("t")), None, (*VIEWS, *SHORT)))
    items = items.withColumnsRenamed({"key": "item_id", "at": "item_at", "places": "item_places", "values": "item_values"})
    views = tuple(sorted(r["view"] for r in items.select("view").distinct().collect()))  # seven at most
    sizes = items.groupBy("item_id", "view").agg(F.count_distinct("window").alias("n_windows"))
    known = docs.sparkSession.sparkContext.broadcast(filter_of(items.select("window").distinct()))  # of bounded size
    key = F.concat_ws(":", id_of(), F.xxhash64(text_of())).alias("key")
    found = saved(template_windows(docs.select(key, text_of().alias("t")), known, views))
    known.destroy()
    # pairs that can be leaks, then pairs that hold enough, then their slots; written step by step, as the driver holds what each task says of each operator
    may = found.select("key", "view", "window").join(_keys(items), ["view", "window"]).select("key", "view", "item_id").distinct()
    joined = saved(found.join(may, ["key", "view"]).join(items, ["item_id", "view", "window"]))
    pair = ["key", "item_id", "view"]
    pairs = joined.groupBy(*pair).agg(F.count_distinct("window").alias("n_found"))
    held = saved(pairs.join(sizes, ["item_id", "view"]).where(F.col("n_found") >= CONTAINMENT * F.col("n_windows")))
    aligned = joined.join(held, pair).withColumn("shift", F.col("at") - F.col("item_at"))
    by_shift = aligned.groupBy(*pair, "n_windows", "shift").agg(F.count_distinct("window").alias("n"))
    most = by_shift.groupBy(*pair).agg(F.max("n").alias("most"))
    enough = CONTAINMENT * F.col("n_windows")
    shifts = by_shift.join(most, pair).where((F.col("n") >= enough) | (F.col("most") < enough))
    copies = saved(shifts.select(*pair, "shift", F.when(F.col("n") >= enough, F.col("shift")).otherwise(SCATTERED).alias("copy")))
    slots = aligned.join(copies, [*pair, "shift"]).select(*pair, "copy", F.inline(F.arrays_zip("item_places", "item_values", "values")))
    counted = slots.groupBy(*pair, "copy", "item_places", "item_values", "values").agg(F.count("*").alias("n"))
    usual = counted.groupBy(*pair, "copy", "item_places", "item_values").agg(F.max_by("values", F.struct("n", "values")).alias("value"))
    by_value = usual.groupBy(*pair, "copy", "item_values").agg(F.count("*").alias("places"), F.count_distinct("value").alias("kinds"))
    agreed = saved(by_value.where("places > 1").groupBy(*pair, "copy").agg(F.avg((F.col("kinds") == 1).cast("int")).alias("consistency")))
    of_copies = copies.select(*pair, "copy").distinct().join(agreed, [*pair, "copy"], "left")
    both = held.join(of_copies.groupBy(*pair).agg(F.max(F.coalesce("consistency", F.lit(1.0))).alias("consistency")), pair)
    measures = both.groupBy("key", "item_id").agg(F.sort_array(F.collect_list(F.struct("view", "n_windows", "n_found", "consistency"))).alias("seen"))  # seven at most
    shown = F.filter("seen", lambda x: (x["consistency"] >= CONSISTENCY) & ((x["view"] != RUNS) | (F.col("seen")[0]["view"] != TEMPLATE)))
    first = measures.select("key", "item_id", F.get(shown, F.lit(0)).alias("first")).where("first is not null").select("key", "item_id", "first.*")
    return first.select("key", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("containment"), "consistency")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the measures of each leak; a null doc_id stays null, and equal rows give one."""
    found = leaks(docs, benchmark)
    known = docs.select(F.concat_ws(":", id_of(), F.xxhash64(text_of())).alias("key"), "doc_id").distinct()
    return known.join(found, "key").drop("key")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, whatever their names."""
    names = docs.columns
    doc_id, text = (f"k{names.index(c)}" for c in ("doc_id", "text"))
    rows = docs.toDF(*(f"k{i}" for i in range(len(names)))).withColumn("key", F.concat_ws(":", id_of(doc_id, text), F.xxhash64(text_of(text))))
    dirty = saved(leaks(docs.select("doc_id", "text"), benchmark).select("key").distinct())
    # a merge join at any size: what leaks grows with the corpus
    return rows.join(dirty.hint("merge"), "key", "left_anti").drop("key").toDF(*names)
