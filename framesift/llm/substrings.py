"""Removal of repeated passages by sharded phrase automata.

A passage is ``WINDOW`` consecutive words. Every window has an anchor, the phrase of ``PHRASE`` words in it
with the least hash, so equal windows have equal anchors. A first pass counts the anchors over the corpus: those
that occur once can't belong to a repeated window, the others are the recurring phrases. Documents are dealt into
shards of bounded size; a shard is told its recurring phrases as one place of each, confirms each by its words
there, compiles them into an Aho-Corasick automaton and streams all its documents through it. What the automaton
hits, and nothing else, says where windows are looked at; a document without a hit is not looked at again. Those
windows are compared over the corpus by 96 bits of hash: a shard sends one row for each different window, so a
passage that a third of all documents share costs a row a shard, and the earliest one stays.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import CACHE_ENTRIES, id_of, join_facts, packed, saved, text_of, total_bytes, unpacked

WINDOW, PHRASE = 20, 6
#: Bytes of text in a shard: what one task holds, apart from a longer single document.
SHARD_BYTES = 8 << 20
#: Words that are hashed at once.
PORTION = 1 << 19
#: A place is the number of a row among those with its id, above the number of a word.
_WORD_BITS = 40
_LOW = np.uint64(32)

_ODD = [np.uint64(xxhash.xxh64_intdigest(str(i)) | 1) for i in range(PHRASE + 2 * WINDOW + 1)]


#: Longer words are hashed each time, so what a Python worker keeps is bounded in bytes.
KNOWN_LENGTH = 64


class _Hashes(dict):
    """Hashes of words; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= KNOWN_LENGTH:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def _combined(words: np.ndarray, at: np.ndarray | slice, n: int, odd: list[np.uint64]) -> np.ndarray:
    """A hash of the ``n`` words from each place."""
    total = np.zeros(len(words) - n + 1, np.uint64) if isinstance(at, slice) else np.zeros(len(at), np.uint64)
    for j in range(n):
        total += (words[j : len(words) - n + 1 + j] if isinstance(at, slice) else words[at + j]) * odd[j]
    total ^= total >> np.uint64(29)
    total *= _ODD[-1]
    return total ^ total >> np.uint64(32)


def _anchors(phrases: np.ndarray) -> np.ndarray:
    """For each window the place of its first phrase with the least hash."""
    width, at = WINDOW - PHRASE + 1, np.arange(len(phrases))

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(phrases[b] < phrases[a], b, a)

    reach = 1
    while 2 * reach <= width:
        at = lesser(at[:-reach], at[reach:])
        reach *= 2
    return lesser(at[: len(phrases) - width + 1], at[width - reach : len(phrases) - reach + 1])


def _windows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as hashes of their words: all hashes in a row, the number of each one's text, all phrases, and the starts and anchors of all windows that lie within one text."""
    hashes = np.concatenate(parts)
    text = np.repeat(np.arange(len(parts)), list(map(len, parts)))
    if len(hashes) < WINDOW:
        return hashes, text, *([np.empty(0, np.int64)] * 3)
    phrases = _combined(hashes, slice(None), PHRASE, _ODD)
    starts = np.flatnonzero(text[: len(text) - WINDOW + 1] == text[WINDOW - 1 :])
    return hashes, text, phrases, starts, _anchors(phrases)[starts]


def _portions(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Items that begin with hashes of words, so many at a time as have about ``PORTION`` words."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[0])
        if size > PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(_hashes.__getitem__, words)), np.uint64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, rid, text) to (phrase, shard, n, rid, place): the anchors of a batch, how often they occur in it, and one place of each."""
    for batch in batches:
        shards, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # bytes.split(): exactly \x20 and \x09-\x0D are space
        texts = ((_hashed(words), i) for i, t in enumerate(batch.column(2).to_pylist()) if len(words := t.encode().split()) >= WINDOW)
        for held in _portions(texts):
            _, text, phrases, _, anchors = _windows([h for h, _ in held])
            keep = np.zeros(len(phrases), bool)
            keep[anchors] = True
            at = np.flatnonzero(keep)
            begins = np.searchsorted(text, np.arange(len(held)))
            phrase, row, place = phrases[at], np.array([i for _, i in held])[text[at]], at - begins[text[at]]
            order = np.lexsort((shards[row], phrase))
            phrase, row, place = phrase[order], row[order], place[order]
            shard = shards[row]
            first = np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (shard[1:] != shard[:-1])])
            columns = (phrase[first].view(np.int64), shard[first], np.diff(np.r_[first, len(phrase)]).astype(np.int32), rids[row[first]], place[first].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["phrase", "shard", "n", "rid", "place"])


def recurring(shards: DataFrame) -> DataFrame:
    """(shard, phrase, rid, place): the anchors that occur twice or more in the corpus, with places in each shard that holds them.

    Phrases are counted with a sum in each task first, so one that a third of all documents share sends a row a task;
    its places stay where they are, and go to their shards only.
    """
    rows = saved(shards.select("shard", "rid", "t").mapInArrow(_anchor_rows, "phrase long, shard int, n int, rid long, place int"))
    counts = rows.groupBy("phrase").agg(F.sum("n").alias("total"), F.count("*").alias("n")).where("total > 1")
    return join_facts(rows.drop("n"), saved(counts.select("phrase", "n")), "phrase", rows.count()).select("shard", "phrase", "rid", "place")


def _ordered(table: pa.Table) -> tuple[list[int], list[int], list[bytes], np.ndarray]:
    """Ids, numbers among rows of one id, and texts of a shard in the order that decides which is earlier."""
    ids, texts = table.column("rid").to_pylist(), list(unpacked(table.column("t")))
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    ids, texts, numbers = [ids[i] for i in order], [texts[i] for i in order], []
    for i, x in enumerate(ids):
        numbers.append(numbers[-1] + 1 if i and ids[i - 1] == x else 0)
    return ids, numbers, texts, np.array(order, np.int64)


def _automaton(ids: list[int], texts: list[bytes], phrases: pa.Table) -> ahocorasick.Automaton:
    """The automaton of a shard's recurring phrases, one character a byte, each with a space on either side.

    Each is taken from its place in the shard's own documents, and only if its words there have its hash.
    """
    automaton = ahocorasick.Automaton()
    phrase, one = np.unique(phrases.column("phrase").to_numpy(), return_index=True)
    rid, place = (phrases.column(c).to_numpy()[one] for c in ("rid", "place"))
    order = np.argsort(rid, kind="stable")
    phrase, rid, place = phrase[order].view(np.uint64), rid[order], place[order]
    cuts = np.flatnonzero(np.r_[True, rid[1:] != rid[:-1], True]).tolist() if len(rid) else [0]
    for a, b in zip(cuts, cuts[1:]):
        i = bisect_left(ids, rid[a])
        while i < len(ids) and ids[i] == rid[a]:  # rows with one id: the words tell which is meant
            words = texts[i].split()
            at = [p for p in place[a:b].tolist() if p + PHRASE <= len(words)]
            said = np.array([_hashes[w] for p in at for w in words[p : p + PHRASE]], np.uint64)
            right = _combined(said, np.arange(0, len(said), PHRASE), PHRASE, _ODD) if at else []
            meant = phrase[a:b][place[a:b] + PHRASE <= len(words)]
            for p, good in zip(at, right == meant):
                if good:
                    automaton.add_word(f" {b' '.join(words[p : p + PHRASE]).decode('latin-1')} ", True)
            i += 1
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _hit(text: bytes, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Where the automaton hits a text: the hashes of the words around, whether a hit begins at each, and the first one's place."""
    words = text.split()
    if len(words) < WINDOW:
        return None
    joined = b" " + b" ".join(words) + b" "
    ends = np.array([end for end, _ in automaton.iter(joined.decode("latin-1"))], np.int64)
    if not len(ends):
        return None
    hits = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), ends) - PHRASE
    a, b = max(int(hits[0]) - WINDOW + PHRASE, 0), min(int(hits[-1]) + WINDOW, len(words))  # windows that hold a hit lie in here
    found = np.zeros(b - a, bool)
    found[hits - a] = True
    return _hashed(words[a:b]), found, a


_LOCATED = "phrase long not null, rid long not null, place long not null, n int not null, w1 array<bigint>, w2 array<int>"


def _locate(docs: pa.Table, phrases: pa.Table) -> pa.Table:
    """The windows of a shard that hold a recurring phrase as their anchor.

    The first of equal windows go on as hashes, those around one anchor in a row under the anchor's hash: rid, place of
    the first, w1 and w2. The others have an earlier one here; consecutive ones make one row of n under any hash.
    """
    ids, numbers, texts, _ = _ordered(docs)
    automaton = _automaton(ids, texts, phrases)
    hit = ((*found, i, number << _WORD_BITS) for i, number, text in zip(ids, numbers, texts) if (found := _hit(text, automaton))) if len(automaton) else ()
    parts = [(np.empty(0, t),) for t in (np.uint64, np.uint32, np.uint64, np.int64, np.int64, np.int64)]
    for held in _portions(hit):
        hashes, text, all_phrases, starts, anchors = _windows([h[0] for h in held])
        begins = np.searchsorted(text, np.arange(len(held)))
        good = np.concatenate([h[1] for h in held])[anchors]
        starts, anchors = starts[good], anchors[good]
        text = text[starts]
        first, ids_here, number = (np.array([h[k] for h in held], np.int64) for k in (2, 3, 4))
        move = first[text] - begins[text] + number[text]
        second = (_combined(hashes, starts, WINDOW, _ODD[PHRASE + WINDOW :]) >> _LOW).astype(np.uint32)
        new = (_combined(hashes, starts, WINDOW, _ODD[PHRASE:]), second, all_phrases[anchors], ids_here[text], starts + move, anchors + move)
        parts = [(*x, y) for x, y in zip(parts, new)]
    w1, w2, phrase, rid, place, anchor = map(np.concatenate, parts)
    order = np.lexsort((w2, w1))  # stable, so equal windows stay in order
    new = np.r_[True, (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])][: len(order)]
    first, later = np.sort(order[new]), np.sort(order[~new])
    # windows in a row around one anchor
    begins = np.flatnonzero(np.r_[True, (rid[first][1:] != rid[first][:-1]) | (np.diff(place[first]) != 1) | (np.diff(anchor[first]) != 0)][: len(first)])
    heads = first[begins]
    # windows in a row that are not the first
    runs = np.flatnonzero(np.r_[True, (rid[later][1:] != rid[later][:-1]) | (np.diff(place[later]) != 1)][: len(later)])
    lengths, tails = np.diff(np.r_[runs, len(later)]), later[runs]
    cuts = pa.array(np.r_[begins, np.full(len(tails) + 1, len(first))].astype(np.int32))  # the rows of n have no hashes
    lists = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (w1[first].view(np.int64), w2[first].view(np.int32)))
    at = np.r_[heads, tails]
    spread = np.r_[phrase[heads], (rid[tails].view(np.uint64) ^ place[tails].view(np.uint64)) * _ODD[0]].view(np.int64)
    columns = (spread, rid[at], place[at], np.r_[np.zeros(len(heads), np.int32), lengths].astype(np.int32))
    return pa.Table.from_arrays([*map(pa.array, columns), *lists], names=["phrase", "rid", "place", "n", "w1", "w2"])


def _gone(located: DataFrame, shards: int) -> DataFrame:
    """(rid, place, n, mask, shard): windows that occur earlier, n in a row from a place, or those of the bits of the mask.

    Equal windows have equal anchors, so they meet where their rows were sent by the anchor's hash.
    """
    window = F.posexplode_outer(F.arrays_zip("w1", "w2"))
    each = located.repartition("phrase").select("phrase", "rid", "place", "n", window).select("phrase", "rid", "place", "n", "pos", "col.w1", "col.w2")
    candidate = F.when(F.col("n") == 0, F.col("rid"))  # one for each shard at most, so its id says which is first
    dealt = each.withColumn("first", F.min(candidate).over(Window.partitionBy("phrase", "w1", "w2")))
    bit = F.when((F.col("n") == 0) & (F.col("first") != F.col("rid")), F.expr("shiftleft(1, pos)")).otherwise(F.lit(0))
    later = dealt.groupBy("phrase", "rid", "place", "n").agg(F.sum(bit).cast("int").alias("mask")).where("n > 0 OR mask > 0")
    return later.select("rid", "place", "n", "mask", _shard("rid", shards))


def _shard(rid: str, shards: int):
    return F.pmod(F.xxhash64(rid), F.lit(shards)).cast("int").alias("shard")


def _cutter(names: list[str], make: Callable[[list[bytes], np.ndarray], tuple], types: list[pa.DataType], out: list[str]):
    """Documents and windows to remove of a shard, to the columns ``names`` and what ``make`` says of words and kept flags."""

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        ids, numbers, texts, order = _ordered(docs)
        rid, place, n, mask = (gone.column(c).to_numpy() for c in ("rid", "place", "n", "mask"))
        single = [np.flatnonzero(mask >> j & 1) for j in range(WINDOW - PHRASE + 1)]  # windows around one anchor
        rid, place, n = (np.concatenate(x) for x in ((rid[n > 0], *(rid[k] for k in single)), (place[n > 0], *(place[k] + j for j, k in enumerate(single))), (n[n > 0], *(np.ones(len(k), n.dtype) for k in single))))
        by = np.lexsort((place, rid))
        rid, place, n = rid[by], place[by], n[by]
        bounds = np.searchsorted(rid, np.array([*ids, 0], np.int64)[:-1], "left"), np.searchsorted(rid, np.array([*ids, 0], np.int64)[:-1], "right")
        rows = []
        for i, text in enumerate(texts):
            words = text.split()
            own = slice(bounds[0][i], bounds[1][i])
            mine = place[own] >> _WORD_BITS == numbers[i]
            starts = place[own][mine] & ((1 << _WORD_BITS) - 1)
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + n[own][mine] + WINDOW - 1, -1)
            rows.append(make(words, np.cumsum(covered)[:-1] == 0))
        made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.Table.from_arrays([*(docs.column(c).take(pa.array(order)) for c in names), *made], names=[*names, *out])

    return run


def _joined(words: list[bytes], kept: np.ndarray) -> bytes:
    return b" ".join(words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k])


def _digest(words: list[bytes], kept: np.ndarray) -> tuple[int, int, str]:
    return len(words), len(words) - int(kept.sum()), hashlib.sha256(_joined(words, kept)).hexdigest()


def _text(words: list[bytes], kept: np.ndarray) -> tuple[int, int, str | None]:
    return len(words), len(words) - int(kept.sum()), None if kept.all() else _joined(words, kept).decode()


def _cut(docs: DataFrame, doc_id: str, text: str, keep: list[str], make: Callable, last: str, shard_bytes: int) -> DataFrame:
    """``keep`` and what ``make`` says, over all rows; columns of ``docs`` must have unique names."""
    count = max(1, -(-total_bytes(docs, text) // shard_bytes))
    rows = docs.withColumn("rid", id_of(doc_id, text)).withColumn("t", text_of(text))
    shards = rows.select(*keep, "rid", "t", _shard("rid", count))
    by_shard = packed(shards, "t").groupBy("shard")
    located = by_shard.cogroup(recurring(shards).groupBy("shard")).applyInArrow(_locate, _LOCATED)
    schema = rows.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add(last, "string")
    cutter = _cutter(keep, make, [pa.int64(), pa.int64(), pa.string()], ["n_words", "n_removed", last])
    return by_shard.cogroup(_gone(located, count).groupBy("shard")).applyInArrow(cutter, schema)


def query(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of each row of ``docs``.

    A null, empty or blank text has no words. Rows with one id are documents of their own, the one with the
    lesser text earlier; of equal rows one is earlier. A null id comes before all others, by a hash of its text.
    An empty table gives an empty result; other columns are ignored. Texts are judged whole.
    """
    return _cut(docs.select("doc_id", "text"), "doc_id", "text", ["doc_id"], _digest, "kept_sha256", shard_bytes)


def remove(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, rows as in ``query``; a text without any stays as it is."""
    names = docs.columns
    ks = [f"k{i}" for i in range(len(names))]
    doc_id, text = (f"k{names.index(c)}" for c in ("doc_id", "text"))
    cut = _cut(docs.toDF(*ks), doc_id, text, ks, _text, "kept", shard_bytes)
    return cut.select(*(F.coalesce("kept", k).alias(k) if k == text else k for k in ks)).toDF(*names)
