"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that follow them in
the training documents. A byte is predicted in its longest context that training has met; where it has not
followed there, an escape (method C: as likely as there are different followers) leads to the next shorter
context, and what the longer one holds is excluded. The counts of the longest contexts hold those of all
shorter ones, so the trie is kept as counts of ``ORDER + 1`` bytes; texts begin with ``ORDER`` pad bytes and
end with an end byte, neither of which occurs in UTF-8.

Documents are dealt into shards. A shard sends a row for each different word and byte sequence it holds, gets
back their corpus-wide counts and code lengths, and scores its documents with those alone; so neither the
vocabulary nor the trie is ever in one place.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import id_of, packed, saved, text_of, total_bytes, unpacked

ORDER = 4
#: Contexts that are worked on at once, and byte sequences that are gathered before they are counted.
CONTEXTS, GATHERED = 4096, 2 << 20
PAD, END = 0xFF, 0xFE
#: Symbols that can follow: all bytes but the pad.
SYMBOLS = 255
#: Bytes of text in a shard.
SHARD_BYTES = 24 << 20
#: Documents with this remainder of crc32(id) mod 5 are held out.
FOLDS, HELD_OUT = 5, 1
_WORD, _GRAM, _END = 0, 1, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that the model does not learn from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.lower().split()  # bytes: exactly \x20 and \x09-\x0D are space


def grams_of(text: bytes) -> np.ndarray:
    """For each byte of a text and its end, that byte after its context, as one number."""
    raw = np.frombuffer(bytes([PAD]) * ORDER + text.lower() + bytes([END]), np.uint8)
    grams = raw[: len(raw) - ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        grams <<= 8
        grams |= raw[k : len(raw) - ORDER + k]
    return grams


class _Grams:
    """Counts of byte sequences, gathered a few megabytes of text at a time."""

    def __init__(self):
        self.waiting, self.size, self.parts = [], 0, []

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size > GATHERED:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.parts.append(np.unique(np.concatenate(self.waiting), return_counts=True))
            self.waiting, self.size = [], 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each sequence, in order, and how often it was added."""
        self._count()
        grams, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*self.parts) if self.parts else ((), ())))
        known, at = np.unique(grams, return_inverse=True)
        return known, np.bincount(at, times, len(known)).astype(np.int64)


def _counts(docs: pa.Table) -> pa.Table:
    """All words and byte sequences of a shard with their counts in its training documents (0: held out only)."""
    words: dict[bool, Counter] = {True: Counter(), False: Counter()}
    grams = {True: _Grams(), False: _Grams()}
    ends = 0
    for text, out in zip(unpacked(docs.column("t")), docs.column("held_out").to_pylist()):
        words[out].update(words_of(text))
        grams[out].add(grams_of(text))
        ends += not out
    known, times = grams[False].counts()
    other = np.setdiff1d(grams[True].counts()[0], known)
    new = words[True].keys() - words[False].keys()
    n_words, n_grams = len(words[False]) + len(new), len(known) + len(other)
    shard = docs.column("shard")[0].as_py()
    columns = {
        "kind": np.repeat(np.array([_WORD, _GRAM, _END], np.int32), [n_words, n_grams, 1]),
        "shard": np.full(n_words + n_grams + 1, shard, np.int32),
        "word": pa.array([*words[False], *new, *itertools.repeat(None, n_grams + 1)], pa.binary()),
        "gram": np.concatenate([np.zeros(n_words, np.int64), known, other, [0]]).astype(np.int64),
        "n": np.concatenate([np.fromiter(words[False].values(), np.int64, len(words[False])), np.zeros(len(new), np.int64), times, np.zeros(len(other), np.int64), [ends]]).astype(np.int64),
    }
    return pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})


def code_lengths(followers: np.ndarray, shorter: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of every symbol in each context.

    ``followers`` has a row of counts for each context of the longest order; ``shorter`` the counts in the
    contexts that these share, from the longest down.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.full(followers.shape, np.nan)
        escape = np.zeros((len(followers), 1))
        excluded = np.zeros(followers.shape, bool)
        excluded[:, PAD] = True
        for counts in (followers, *(np.broadcast_to(x, followers.shape) for x in shorter)):
            here = np.where(excluded, 0, counts)
            kinds = (here > 0).sum(1, keepdims=True)
            total = here.sum(1, keepdims=True) + kinds
            out = np.where(here > 0, escape + np.log10(here / total), out)
            escape = np.where(kinds > 0, escape + np.log10(kinds / total), escape)
            excluded = excluded | (counts > 0)
        rest = np.maximum(SYMBOLS + 1 - excluded.sum(1, keepdims=True), 1)
        return np.where(np.isnan(out), escape - np.log10(rest), out)


def gram_lengths(grams: DataFrame) -> DataFrame:
    """``gram`` and ``value``, the log10 probability of its last byte after the others.

    ``grams`` has each sequence once with its count ``n`` in training. Contexts that end in the same two bytes
    meet in one group of 2**24 rows at most, and are worked on a few at a time; the counts for one byte of
    context and for none, 2**16 numbers, go to every task.
    """
    pairs = grams.groupBy((F.col("gram") % (1 << 16)).cast("int").alias("pair")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    single = np.zeros((256, 256), np.int64)
    for r in pairs:
        single[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    none = single.sum(0)

    def run(group: pa.Table) -> pa.Table:
        gram, n = (group.column(c).to_numpy() for c in ("gram", "n"))
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        # what follows each context of three bytes and of two, summed over the bytes before them
        threes, three = np.unique(gram >> 8 & 0xFFFFFF, return_inverse=True)
        by_three = np.zeros((len(threes), 256), np.int64)
        np.add.at(by_three, (three, gram & 255), n)
        shorter = [by_three.sum(0), single[gram[0] >> 8 & 255], none]
        contexts, row = np.unique(gram >> 8, return_inverse=True)
        value = np.empty(len(gram))
        for k in range(0, len(contexts), CONTEXTS):
            here = slice(*np.searchsorted(row, [k, k + CONTEXTS]))
            counts = np.zeros((min(CONTEXTS, len(contexts) - k), 256), np.int64)
            counts[row[here] - k, gram[here] & 255] = n[here]
            below = by_three[np.searchsorted(threes, contexts[k : k + CONTEXTS] & 0xFFFFFF)]
            value[here] = code_lengths(counts, [below, *shorter])[row[here] - k, gram[here] & 255]
        return pa.table({"gram": gram, "value": value})

    keyed = grams.select("gram", "n", F.shiftright("gram", 8).bitwiseAND(0xFFFF).cast("int").alias("context"))
    return keyed.groupBy("context").applyInArrow(run, "gram long, value double")


def _scorer(names: list[str], ends: int, total: int, distinct: int):
    """Documents of a shard and the values of its words and sequences, to scores."""
    floor = total + 0.5 * (distinct + 1)

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        is_word = values.column("word").is_valid().to_numpy()
        counts = dict(zip(values.column("word").drop_null().to_pylist(), values.column("value").to_numpy()[is_word].tolist()))
        gram, value = values.column("gram").to_numpy()[~is_word], values.column("value").to_numpy()[~is_word]
        order = np.argsort(gram)
        gram, value = gram[order], value[order]
        get, rows = counts.get, []
        for text in unpacked(docs.column("t")):
            c = np.array([*map(get, words_of(text), itertools.repeat(0)), ends], np.float64)
            score = value[np.searchsorted(gram, grams_of(text))].sum()
            rows.append((len(c), int((c > 0).sum()), total, float(np.log10((c + 0.5) / floor).sum()), float(score)))
        made = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.float64()] * 2)]
        return pa.Table.from_arrays([*(docs.column(c) for c in names), *made], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def query(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, token counts, the unigram score and the PPM score (log10) of each row of ``docs``.

    A null or empty text has the end token only. Repeated rows count, and are scored, each by itself. A null id
    counts as an empty one when documents are held out. With no training document every word is unknown and
    every byte equally likely. An empty table gives an empty result; other columns are ignored.
    """
    count = max(1, -(-total_bytes(docs) // shard_bytes))
    shard = F.pmod(F.xxhash64(id_of("doc_id", "text")), F.lit(count)).cast("int").alias("shard")
    source = docs.select("doc_id", held_out().alias("held_out"), shard, text_of().alias("t"))
    by_shard = packed(source, "t").groupBy("shard")
    rows = saved(by_shard.applyInArrow(_counts, "kind int, shard int, word binary, gram long, n long"), "kind")
    words, grams = rows.where(f"kind = {_WORD}"), rows.where(f"kind = {_GRAM}")
    word_counts = saved(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    gram_counts = saved(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    ends = rows.where(f"kind = {_END}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    known_words = words.select("shard", "word").join(word_counts, "word").select("shard", "word", F.lit(0).cast("long").alias("gram"), F.col("n").cast("double").alias("value"))
    known_grams = grams.select("shard", "gram").join(gram_lengths(gram_counts), "gram").select("shard", F.lit(None).cast("binary").alias("word"), "gram", "value")
    values = known_words.union(known_grams)
    schema = source.select("doc_id", "held_out").schema.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return by_shard.cogroup(values.groupBy("shard")).applyInArrow(_scorer(["doc_id", "held_out"], ends, total, distinct), schema)
