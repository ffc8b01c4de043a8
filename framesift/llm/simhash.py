"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in four bits or fewer differ in at most one bit in one of three segments. Each
distinct fingerprint is therefore indexed under every segment with one bit left out (64 variants); fingerprints
that share a variant meet by equality and are verified on all 64 bits. A bucket that grows beyond ``bucket``
is indexed anew under longer keys: its free bits in five parts, of which one is equal for every pair within
four bits. That is exact at any size, and it ends, as distinct fingerprints that agree in all but r bits are
2**r at most. Within a bucket only a spanning forest of the links goes on, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import join_facts, saved, text_of
from framesift.llm.graph import components

SEED = 42
SHINGLE = 4
DISTANCE = 4
SEGMENTS = (range(0, 22), range(22, 43), range(43, 64))
#: Larger buckets are indexed anew; at most this many fingerprints of one bucket are in memory.
BUCKET = 4096
#: Shingles whose bits are counted at once, and links a task remembers so as not to repeat them.
COUNTED, REMEMBERED = 1 << 15, 500_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of a text, as an unsigned integer; 0 if it has no words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0D as space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist())], "<u8")
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[k : k + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``fp``, the fingerprint of each whole text as a signed long.

    A null, empty or blank text has fingerprint 0. Repeated rows each give a row, an empty table gives an empty
    result, and columns outside ``keep`` are ignored.
    """
    keep = list(keep)
    source = docs.select(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep)), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], "fp"])

    rows = source.mapInArrow(run, source.drop("t").schema.add("fp", "long"))
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "fp")


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variants() -> list[int]:
    """The masks of all deletion variants: a segment without one of its bits."""
    return [sum(1 << b for b in segment) & ~(1 << gone) for segment in SEGMENTS for gone in segment]


def longer(mask: int, distance: int = DISTANCE) -> list[int]:
    """``mask`` with each of ``distance + 1`` parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = (free[i :: distance + 1] for i in range(distance + 1))
    return [mask | sum(1 << b for b in part) for part in parts]


class Forest:
    """Links seen by a task, so that it passes on only those that join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.parent) > REMEMBERED:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _near(a: list[np.ndarray], b: list[np.ndarray], wide: int) -> np.ndarray:
    """Where two rows of prints are near: fingerprints within ``DISTANCE``, and sketches, if there are any, within ``wide`` unless one of the rows stands for many."""
    near = np.bitwise_count(a[0] ^ b[0]) <= DISTANCE
    if len(a) > 1:
        at = np.flatnonzero(near)
        pick = lambda x: x if x.ndim == 0 else x[at]
        far = sum(np.bitwise_count(pick(x) ^ pick(y)).astype(np.int64) for x, y in zip(a[1:-1], b[1:-1]))
        near[at] = (far <= wide) | ((pick(a[-1]) | pick(b[-1])) != 0)
    return near


def _short_runs(run: np.ndarray, ids: np.ndarray, prints: list[np.ndarray], wide: int = 0) -> Iterator[tuple[int, int]]:
    """Linked pairs of equal runs, all runs at once."""
    at, step = np.arange(len(ids)), 1
    while True:
        at = at[at + step < len(ids)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            return
        near = at[_near([x[at] for x in prints], [x[at + step] for x in prints], wide)]
        yield from zip(ids[near].tolist(), ids[near + step].tolist())
        step += 1


def _long_run(ids: np.ndarray, prints: list[np.ndarray], wide: int = 0) -> Iterator[tuple[int, int]]:
    """A spanning forest of one run: each member is met once, and compared with those not yet reached."""
    rest = np.arange(len(ids))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _near([p[rest] for p in prints], [p[x] for p in prints], wide)
            found, rest = rest[near], rest[~near]
            yield from ((int(ids[x]), other) for other in ids[found].tolist())
            front.extend(found)


def _linker(bucket: int, more: int = 0, wide: int = 0, short: int = 32):
    """Batches of (mask, key, fp) or (mask, key, fp, id, sketches, many), equal keys together, to links and to members of buckets that are too large."""

    def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["a", "b", "mask"])

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        """Masks, keys, ids, fingerprints, sketches and whether a row stands for many."""
        mask, key, fp, *rest = (c.to_numpy() for c in batch.columns)
        return [mask, key, rest[0] if rest else fp, fp.view(np.uint64), *(x.view(np.uint64) for x in rest[1:])]

    def runs(mask: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])

    def judge(rows: list[np.ndarray], forest: Forest) -> list[tuple[int, int, int]]:
        """Links of whole runs."""
        mask, key, ids, *prints = rows
        if len(ids) < 2:
            return []
        run = runs(mask, key)
        sizes = np.bincount(run)
        few = (sizes[run] > 1) & (sizes[run] <= short)
        found = [(a, b, 0) for a, b in _short_runs(run[few], ids[few], [x[few] for x in prints], wide) if forest.joins(a, b)]
        ends = np.cumsum(sizes)
        for r in np.flatnonzero(sizes > short).tolist():
            here = slice(ends[r] - sizes[r], ends[r])
            found += [(a, b, 0) for a, b in _long_run(ids[here], [x[here] for x in prints], wide) if forest.joins(a, b)]
        return found

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.int64, np.int64, np.int64] + [np.uint64] * (1 + more)
        forest, held, large = Forest(), [np.empty(0, t) for t in kinds], None
        for batch in batches:
            rows = columns(batch)
            if large is not None:  # the bucket that was too large goes on
                n = int(np.argmin(np.r_[(rows[0] == large[0]) & (rows[1] == large[1]), False]))
                yield out([(x, 0, large[0]) for x in rows[2][:n].tolist()])
                if n == len(rows[2]):
                    continue
                large, rows = None, [x[n:] for x in rows]
            rows = [np.concatenate(x) for x in zip(held, rows)]
            mask, key, ids = rows[:3]
            if not len(ids):
                continue
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            run = runs(mask, key)
            over = np.bincount(run)[run] > bucket
            too_large = [(x, 0, m) for x, m in zip(ids[over].tolist(), mask[over].tolist())]
            whole = ~over
            whole[cut:] = False
            yield out(too_large + judge([x[whole] for x in rows], forest))
            if over[-1]:
                large, cut = (int(mask[-1]), int(key[-1])), len(ids)
            held = [x[cut:] for x in rows]
        yield out(judge(held, forest))

    return link


def _indexed(rows: DataFrame, *more: str) -> DataFrame:
    """(mask, fp) as (mask, key, fp), equal keys together."""
    keyed = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", *more)
    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key")


def links(prints: DataFrame, bucket: int = BUCKET, id_column: str = "fp", sketches: Sequence[str] = (), wide: int = 0) -> DataFrame:
    """Links (a, b) that join all distinct ids within four bits of ``fp`` into their components.

    Fingerprints are ids of their own, or there is a long ``id_column`` and ``sketches``, longs that are compared where
    fingerprints are near, and may differ in ``wide`` bits in all. Ids that share one fingerprint can't be told
    apart by longer keys: more than ``crowded(bucket)`` of them are linked to the least of them, which stands for all in
    the index, and links to it whatever the sketches. So links are a superset there, and buckets always come to an end.
    """
    bucket = max(bucket, 1 << DISTANCE)  # so that a bucket to index anew has more free bits than DISTANCE
    masks = F.array(*(F.lit(_signed(m)) for m in variants()))
    if id_column != "fp":
        per_print = saved(prints.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n")).where(F.col("n") > crowded(bucket)).select("fp", "least", "n"))
        crowds = saved(join_facts(prints.select("fp", id_column), per_print, "fp", prints.count()).where(F.col(id_column) != F.col("least")).select("least", id_column))
        alone = prints.join(crowds.select(id_column), id_column, "left_anti").join(per_print.select(F.col("least").alias(id_column), F.lit(1).alias("crowd")), id_column, "left")
        prints = saved(alone.select(id_column, "fp", *sketches, F.coalesce("crowd", F.lit(0)).cast("long").alias("many")))
        within = crowds.select(F.col("least").alias("a"), F.col(id_column).alias("b"))
        sketches = [*sketches, "many"]
    more = [] if id_column == "fp" else [id_column, *sketches]
    found, level = None, prints.select(F.explode(masks).alias("mask"), "fp", *more)
    while True:
        out = saved(_indexed(level, *more).mapInArrow(_linker(bucket, max(len(more) - 1, 0), wide), "a long, b long, mask long"))
        some = out.where("mask = 0").select("a", "b")
        found = some if found is None else found.union(some)
        large = out.where("mask != 0").select("mask", F.col("a").alias(id_column))
        if large.isEmpty():
            return (found.union(within) if more else found).distinct()
        masks_in_use = {m: longer(m % (1 << 64)) for m in (r["mask"] for r in large.select("mask").distinct().collect())}  # masks, not data
        table = prints.sparkSession.createDataFrame([(m, _signed(x)) for m, xs in masks_in_use.items() for x in xs], "mask long, next long")
        level = large.join(F.broadcast(table), "mask").select(F.col("next").alias("mask"), id_column).distinct()
        if more:
            level = level.join(prints.select(*more, "fp"), id_column)


def crowded(bucket: int) -> int:
    """Ids of one fingerprint that a bucket can hold with those of all its neighbours under one of the longest keys."""
    return max(1, max(bucket, 1 << DISTANCE) >> DISTANCE)


def groups(prints: DataFrame, id_column: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Rows (fp, component_id, n): the least id that each distinct fingerprint can reach, and its number of rows.

    Ids are joined on the fingerprint, so copies of one text cost one row here. A null id counts only where a
    component has no other.
    """
    least = saved(prints.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n")))
    roots = components(links(least, bucket))
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = roots.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    return least.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")


def query(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of ``docs``.

    Null, empty and blank texts share fingerprint 0, which links like any other. Repeated rows give a row each;
    a null id gets its component's id; an empty table gives an empty result; other columns are ignored.
    """
    prints = saved(fingerprints(docs))
    found = saved(groups(prints, bucket=bucket))
    return join_facts(prints, found, "fp", prints.count()).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
