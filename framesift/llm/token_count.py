"""Token counts by heap-and-linked-list merging, without identifiers.

Symbols form a linked list; a heap holds the adjacent pairs that form a piece, by rank and then position. The
count is the number of initial symbols less the number of merges. A character outside the vocabulary falls
back to its bytes, so it starts as that many symbols.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import CACHE_ENTRIES, text_of

#: How the library writes a space.
SPACE = "▁"


def count(text: str, ranks: dict[str, int]) -> int:
    """Tokens of ``text``: heap merges over its characters; lower ranks merge first, ties from the left."""
    n = len(text)
    if n < 2:
        return n if text in ranks else len(text.encode())
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(text[i : i + 2])) is not None]
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    merges = 0
    while heap:
        _, i, end = heappop(heap)
        middle = after[i]
        if middle < 0 or middle >= n or after[middle] != end:
            continue  # one of the two has merged with another meanwhile
        merges += 1
        after[i], after[middle] = end, -1
        before[end] = i
        left = before[i]
        if left >= 0 and (rank := ranks.get(text[left:end])) is not None:
            heappush(heap, (rank, left, end))
        if end < n and (rank := ranks.get(text[i : after[end]])) is not None:
            heappush(heap, (rank, i, after[end]))
    initial = n
    for c in set(text):
        if c not in ranks:
            initial += text.count(c) * (len(c.encode()) - 1)
    return initial - merges


class PieceCounter:
    """Counts for one model file; words it has counted stay in a bounded cache."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        self.ranks = {model.id_to_piece(i): place[model.get_score(i)] for i in plain}
        #: Pieces never hold a space after another character, so nothing merges across the start of a word.
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in self.ranks)
        self.words: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a whole text, a space put before it as the library does."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return count(text, self.ranks)
        words, total, spaces = self.words, 0, 0
        for word in text.split(SPACE)[1:]:
            if not word:
                spaces += 1  # a run of spaces belongs to the word that follows it
                continue
            if spaces:
                word = SPACE * spaces + word
                spaces = 0
            n = words.get(word)
            if n is None:
                if len(words) > CACHE_ENTRIES:
                    words.clear()
                n = count(SPACE + word, self.ranks)
                if len(word) < 100:
                    words[word] = n
            total += n
        return total + (count(SPACE * spaces, self.ranks) if spaces else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter for each worker and file."""
    return PieceCounter(path)


def counted(docs: DataFrame, path: str, limit: int, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of each whole text.

    A null or empty text has 0 bytes and 0 tokens. A text of any length is counted whole, as one string.
    Repeated rows count each by itself; an empty table gives an empty result; columns outside ``keep`` are
    ignored, whatever their names; a kept column must not have the name of one that is made.
    """
    keep = list(keep)
    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            numbers = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([pieces.count(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *numbers], [*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    schema = source.drop("t").schema.add("n_bytes", "long").add("n_tokens", "long")
    return source.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
