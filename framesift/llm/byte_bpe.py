"""Byte-level BPE by segment trees.

The tree's leaves are the byte positions of a piece; a leaf holds the rank of the pair that starts there,
an inner node the least (rank, position) below it, so the root is the leftmost pair of lowest rank. A merge
changes the pair at the position itself and at its live left neighbour and removes the right one: three
point updates of logarithmic cost, so a piece of n bytes takes O(n log n) steps whatever it holds.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import text_of

#: Entries of each of the two caches of a Python worker, about 200 bytes each.
KNOWN_PIECES = 400_000

_SHIFT = 40
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << _SHIFT | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # the start of the next live symbol
    before = list(range(-1, n - 1))
    at_mask = (1 << _SHIFT) - 1

    def put(i: int, start: int, end: int) -> None:
        rank = get(piece[start:end]) if end >= 0 else None
        k = size + i
        tree[k] = _NONE if rank is None else rank << _SHIFT | i
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
            k >>= 1

    while (least := tree[1]) < _NONE:
        i = least & at_mask
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
        put(j, 0, -1)
        put(i, i, after[end] if end < n else -1)
        if (left := before[i]) >= 0:
            put(left, left, end)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class PieceForest:
    """The same merges for many short pieces at once: one segment tree a piece, all in one array."""

    LONGEST = 64
    _FREE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf for pairs of tokens that start at ``at``: rank and position, or free."""
        key = left << 32 | right
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.values[found] << 6 | at.astype(np.int32), self._FREE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pieces of 2 to ``LONGEST`` bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for size in (4, 8, 16, 32, self.LONGEST):
            chosen = np.flatnonzero((sizes <= size) & (sizes > (size // 2 if size > 4 else 0)))
            if len(chosen):
                for i, packed in zip(chosen.tolist(), self._merge_class([pieces[i] for i in chosen.tolist()], size)):
                    out[i] = packed
        return out

    def _merge_class(self, pieces: list[bytes], size: int) -> list[bytes]:
        count = len(pieces)
        n = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        place = np.arange(size, dtype=np.int64)
        token = self.single[raw]
        tree = np.full((count, 2 * size), self._FREE, np.int32)
        leaves = self._leaf(token[:, :-1], token[:, 1:], np.broadcast_to(place[:-1], (count, size - 1)))
        tree[:, size : 2 * size - 1] = np.where(place[1:] < n[:, None], leaves, self._FREE)
        width = size
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half
        after = np.broadcast_to(place + 1, (count, size)).copy()
        before = np.broadcast_to(place - 1, (count, size)).copy()
        live = place < n[:, None]

        def put(rows: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
            node = size + at
            tree[rows, node] = leaf
            while node[0] > 1:  # all nodes are at the same depth
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(count)
        while True:
            least = tree[rows, 1]
            rows = rows[least < self._FREE]
            if not len(rows):
                break
            least = tree[rows, 1].astype(np.int64)
            i = least & 63
            j = after[rows, i]
            end = after[rows, j]
            token[rows, i] = least >> 6
            live[rows, j] = False
            after[rows, i] = end
            inside = end < n[rows]
            before[rows[inside], end[inside]] = i[inside]
            put(rows, j, np.full(len(rows), self._FREE, np.int32))
            right = token[rows, np.minimum(end, size - 1)]
            put(rows, i, np.where(inside, self._leaf(token[rows, i], right, i), self._FREE))
            left = before[rows, i]
            has = left >= 0
            if has.any():
                r, at = rows[has], left[has]
                put(r, at, self._leaf(token[r, at], token[r, i[has]], at))
        flat, ends = token[live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(1))
        starts = [0, *ends[:-1].tolist()]
        return [flat[a:b] for a, b in zip(starts, ends.tolist())]


class ByteBPE:
    """Encoder and decoder for one rank file and pattern; keeps what it has encoded in bounded caches."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.forest = PieceForest(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _encode_pieces(self, lists: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of pieces; pieces not met before are merged together."""
        pieces = self.pieces
        if len(pieces) > KNOWN_PIECES:
            pieces.clear()
        new = list(set().union(*lists).difference(pieces))
        raw = [p.encode() for p in new]
        many = [i for i, p in enumerate(raw) if 1 < len(p) <= self.forest.LONGEST and p not in self.ranks]
        for i, packed in zip(many, self.forest.merge([raw[i] for i in many])):
            pieces[new[i]] = packed
        long = {}
        for piece, data in zip(new, raw):
            if piece not in pieces:
                known = pieces if len(data) <= self.forest.LONGEST else long
                known[piece] = array("I", merge(data, self.ranks)).tobytes()
        if long:
            return [b"".join([pieces[p] if p in pieces else long[p] for p in x]) for x in lists]
        get = pieces.__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native (little-endian) unsigned 32-bit integers.

        A single space between two characters that are not space always begins a piece, so texts are cut there
        and the chunks are encoded on their own; where spaces stand otherwise, the pattern runs over the whole
        text.
        """
        chunks, split = self.chunks, self.split
        if len(chunks) > KNOWN_PIECES:
            chunks.clear()
        parts = [t.split(" ") for t in texts]
        new, long = [], {}
        for chunk in set().union(*(p[1:] for p in parts)).difference(chunks):
            if chunk and not chunk[0].isspace() and not chunk[-1].isspace():
                new.append(chunk)
            else:
                long[chunk] = None
        for chunk, packed in zip(new, self._encode_pieces([split(" " + c) for c in new])):
            if len(chunk) < 100:
                chunks[chunk] = packed
            else:
                long[chunk] = packed
        bad = {chunk for chunk, packed in long.items() if packed is None}
        heads, whole = [], []
        for i, p in enumerate(parts):
            spaced = len(p) > 1 and (not p[0] or p[0][-1].isspace() or not bad.isdisjoint(p[1:]))
            whole.append(spaced)
            heads.append(split(texts[i] if spaced else p[0]))
        get = chunks.__getitem__
        out = []
        for p, spaced, head in zip(parts, whole, self._encode_pieces(heads)):
            if spaced:
                out.append(head)
            elif long and not long.keys().isdisjoint(p):
                out.append(head + b"".join([chunks[c] if c in chunks else long[c] for c in p[1:]]))
            else:
                out.append(head + b"".join(map(get, p[1:])))
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.vocabulary.__getitem__, array("I", packed)))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker, file and pattern."""
    return ByteBPE(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``ids``, the token ids of each whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids; so does an empty one. Texts of any length are encoded whole.
    Repeated rows are encoded each by itself, an empty table gives an empty result, and columns outside
    ``keep`` are ignored. A kept column named ``ids`` raises, as it would be ambiguous; any other name is fine.
    """
    keep = list(keep)
    if "ids" in keep:
        raise ValueError("a kept column can't be named ids")
    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids = pa.array(bpe.encode_batch(batch.column(len(keep)).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    kept = source.drop("t").schema
    return source.mapInArrow(run, kept.add("ids", "binary")).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "ids")


def decoded(coded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the bytes that its ids stand for; null ids give no bytes."""
    schema = coded.select("*").schema.add(out, "binary")
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            plain = pa.array([bpe.decode(x or b"") for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, plain], [*batch.schema.names, out])

    return coded.mapInArrow(run, schema)


def query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's digests of the ids and of what they decode to.

    Encoding and decoding share one pass of Python, as a second one would only move the ids to and fro.
    """
    source = docs.select(F.col("doc_id").cast("long"), text_of().alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            n, ids_sha, plain_sha = [], [], []
            for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                plain_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(plain_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
