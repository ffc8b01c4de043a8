"""Importance resampling towards a target distribution, by hashed word counts.

Texts are read as the bytes of their Arrow buffers. A table of 256 entries says which bytes belong to words; where
that changes along the buffer, words begin and end. The CRC-32 of all words is advanced together, a byte of each at
a time, by the usual table of 256 entries. One pass over the corpus and one over the target give the counts of
hashed features; a second pass over the corpus sums the gains of each document's features, and a draw without
replacement by Gumbel noise takes the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import numbered, saved, text_of

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Words whose CRCs are advanced at once, and bytes of each; of longer words the rest follows from the state reached.
PORTION, LONG = 1 << 18, 64

_BYTES = np.arange(256)
#: Bytes as they count: A-Z in lower case.
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Whether a byte belongs to a word once it is in lower case: digits, a-z, and all that is not ASCII.
_WORD = (((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)).astype(np.int8)


def _crc_table() -> np.ndarray:
    """The CRC-32 of each byte from state 0, by the reversed polynomial."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(0xEDB88320), state >> 1)
    return state


_CRC = _crc_table()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each text begins, with the end of the last."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize) if len(texts) else np.zeros(1, kind)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], (bounds - bounds[0]).astype(np.int64)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: the differences of the class of neighbouring bytes, and the bounds of texts."""
    inside = _WORD[data]
    first, last = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    before, after = np.r_[np.int8(0), inside[:-1]], np.r_[inside[1:], np.int8(0)]
    before[first], after[last] = 0, 0
    return np.flatnonzero(inside - before == 1), np.flatnonzero(inside - after == 1) + 1


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word in lower case."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, lengths = starts[order], lengths[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-lengths, -np.arange(min(int(lengths[0]), LONG) if len(lengths) else 0), "left")  # words longer than k
    for k, n in enumerate(live.tolist()):
        state[:n] = _CRC[(state[:n] ^ _LOWER[data[at[:n] + k]]) & 0xFF] ^ state[:n] >> 8
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-lengths, -LONG, "left"))):
        state[i] = zlib.crc32(_LOWER[data[at[i] + LONG : at[i] + lengths[i]]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bucket of every word of some texts and the number of its text, a portion of words at a time."""
    data, bounds = buffers(texts)
    starts, ends = word_bounds(data, bounds)
    for a in range(0, len(starts), PORTION):
        begin, end = starts[a : a + PORTION], ends[a : a + PORTION]
        yield crcs(data, begin, end).astype(np.int64) % buckets, np.searchsorted(bounds, begin, "right") - 1


def _counter(buckets: int):
    """(text) to the counts of a task: (bucket, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found, _ in features(batch.column(0), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends one row a bucket at most."""
    parts = rows.select(text_of(text).alias("t")).mapInArrow(_counter(buckets), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: Sequence[int], target: Sequence[int]) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: a thousand times the log of the ratio of its smoothed shares."""
    buckets, s_all, t_all = float(len(source)), float(sum(source)), float(sum(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source, target)], np.int64)


def _dense(found: DataFrame, buckets: int) -> list[int]:
    """Counts by bucket as a list: as many numbers as there are buckets."""
    out = [0] * buckets
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def weighed(docs: DataFrame, gain: np.ndarray, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, n_features and weight: the gains of a document's features added up, 0 if it has none."""
    keep = list(keep)
    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for bucket, doc in features(batch.column(len(keep)), len(gain)):
                firsts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                n[doc[firsts]] += np.diff(np.r_[firsts, len(doc)])
                weight[doc[firsts]] += np.add.reduceat(gain[bucket], firsts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n), pa.array(weight)], [*(f"k{i}" for i in range(len(keep))), "n_features", "weight"])

    schema = source.drop("t").schema.add("n_features", "long").add("weight", "long")
    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_features", "weight")


def noise(doc_id: str = "doc_id", seed: int = SEED) -> Column:
    """A thousandfold Gumbel draw, rounded down, that the seed and the id decide; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(share)))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``: rank is null for what is not drawn.

    The highest ``percent`` % of scores, rounded down, of documents with ``least_words`` words or more are drawn,
    ties to the smaller id, null ids last and equal rows in any order. Null and empty texts have no features, score
    as others do and are not drawn; repeated rows count each; an empty table gives an empty result, and so does an
    empty target a draw by the documents alone; other columns are ignored.
    """
    gain = gains(_dense(counts(docs, buckets=buckets), buckets), _dense(counts(target, buckets=buckets), buckets))
    scored = saved(weighed(docs, gain).withColumn("score", F.col("weight") + noise("doc_id", seed)))
    eligible = scored.where(F.col("n_features") >= least_words)
    drawn = eligible.count() * percent // 100
    placed = numbered(eligible, F.desc("score"), F.asc_nulls_last("doc_id"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*columns, rank.alias("rank")).union(scored.where(F.col("n_features") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def query(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's draw: one in ten documents of 20 words or more, towards the texts of ``target``."""
    return resampled(docs, target)
