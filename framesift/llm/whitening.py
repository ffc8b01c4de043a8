"""Whitening of embeddings by a randomised range finder.

Every distinct vector counts once. A random basis of some columns more than there are components is multiplied by
the covariance in passes over all centred rows; each task sums its own rows' part of the product, so what leaves a
task has the size of the basis. Rayleigh-Ritz in the basis gives components and residuals after each pass. If the
residuals are not down to rounding after the last pass, the basis is expanded to the full dimension, whose one pass
gives the covariance itself. Only matrices of the vectors' dimension reach the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import saved

#: Entries become whole numbers: this many steps to one, and an offset.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Columns of the basis beyond the components, passes before it is expanded, and what a residual may be, as a share of the largest eigenvalue.
OVERSAMPLE, PASSES, RESIDUAL = 8, 4, 1e-13
#: Eigenvalues below this share of the largest are rounding: the vectors don't extend that way.
NOISE = 1e-12
#: Entries of larger size than this many steps are no embeddings, and a long can't hold what is derived from them.
LARGEST = 1 << 52
SEED = 7


@dataclass(frozen=True)
class Fit:
    """What the fit list says: its number and sums, exact, the trace of the covariance, and components by falling eigenvalue, one a column."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    expanded: bool

    @property
    def floors(self) -> np.ndarray:
        """The whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rests(self) -> np.ndarray:
        """Sums less n times the whole part of the mean."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, to double precision: differences of whole numbers are exact."""
        return (x - self.floors) - self.rests / self.n

    @property
    def scale(self) -> np.ndarray:
        """Projects centred rows on whitened components."""
        return self.vectors / np.sqrt(self.values)


def quantised(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x): vectors as whole numbers, ``floor(64 * c) + 1000000`` of each entry.

    Rows go whose vector is null or empty, has a null, infinite or NaN entry, or one beyond 2**52 steps. Repeated
    rows and ids, and null ids, stay.
    """
    source = rows.select(rows[id_column].alias("id"), F.col(column).cast("array<double>").alias("c"))
    fine = (F.size("c") > 0) & F.forall("c", lambda v: F.coalesce(F.abs(v) < LARGEST / STEPS, F.lit(False)))  # NaN is above all numbers
    whole = F.transform("c", lambda v: (F.floor(v * STEPS) + OFFSET).cast("long"))
    return source.where(F.col("c").isNotNull() & fine).select("id", whole.alias("x"))


def of_one_length(vectors: DataFrame) -> DataFrame:
    """The vectors of the length that most have, of equally many the longer: others can't be compared with them."""
    usual = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return vectors.where(F.size("x") == F.lit(usual["d"] if usual else 0))


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = batch.column(batch.schema.names.index(name)).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x) to (at, n, s) of a task: for each dimension its rows and their exact sum."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch)
            part = x.sum(axis=0) if np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(axis=0)
            total = part.astype(object) if total is None else total + part
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([int(s) for s in total], pa.decimal128(38, 0))], ["at", "n", "s"]
        )


def _product(fit: Fit, basis: np.ndarray):
    """(x) to a task's part of the covariance times ``basis``: (at, row), and as ``at`` -1 the squares of all entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros_like(basis), np.zeros(1)
        for batch in batches:
            if batch.num_rows:
                x = fit.centred(_rows(batch))
                total += x.T @ (x @ basis)
                squares += np.vdot(x, x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([squares, *total], pa.list_(pa.float64()))], ["at", "row"])

    return run


def _outer(fit: Fit):
    """(x) to a task's sums of whitened rows, as ``at`` -1, and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        total, ones = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = fit.centred(_rows(batch)) @ fit.scale
                total += w.T @ w
                ones += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(k)], pa.int32()), pa.array([ones, *total], pa.list_(pa.float64()))], ["at", "row"])

    return run


def _summed(parts: DataFrame, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of all tasks added up by entry: row -1, and the others. As many numbers reach the driver as the matrix has."""
    entries = parts.select("at", F.posexplode("row").alias("k", "v")).groupBy("at", "k").agg(F.sum("v").alias("v"))
    first, rest = np.zeros(width), np.zeros((height, width))
    for at, k, v in entries.collect():
        if at < 0:
            first[k] = v
        else:
            rest[at, k] = v
    return first, rest


def _ritz(basis: np.ndarray, product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Rayleigh-Ritz in an orthonormal basis: values, vectors, and the largest residual of the first ``k`` as a share of the first value."""
    small = basis.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    vectors = basis @ turn
    far = np.linalg.norm(product @ turn - vectors * values, axis=0)
    return values, vectors, float(far.max(initial=0.0) / values[0]) if len(values) and values[0] > 0 else 0.0


def fitted(vectors: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, residual: float = RESIDUAL) -> Fit | None:
    """The fit to the distinct rows of ``vectors`` (x, all of one length), which should be written; None for no rows.

    Components along which the rows don't extend are left out, so there may be fewer than asked for, or none.
    Signs are those that make the largest entry of a component positive, of equal ones the first.
    """
    found = vectors.select("x").mapInArrow(_sums, "at int, n long, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    if not found:
        return None
    d, n = len(found), found[0]["n"]
    fit = Fit(n, tuple(int(r["s"]) for r in found), 0.0, np.empty(0), np.empty((d, 0)), False)

    def times(basis: np.ndarray) -> tuple[float, np.ndarray]:
        squares, product = _summed(vectors.select("x").mapInArrow(_product(fit, basis), "at int, row array<double>"), *basis.shape)
        return squares[0] / n, product / n

    k, width = min(d, components), min(d, components + oversample)
    basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    expanded, far = False, np.inf
    for _ in range(passes):
        trace, product = times(basis)
        values, found_vectors, far = _ritz(basis, product, k)
        if far <= residual:
            break
        basis = np.linalg.qr(product)[0]
    if far > residual:
        trace, product = times(np.eye(d))
        values, found_vectors, _ = _ritz(np.eye(d), product, k)
        expanded = True
    good = values > NOISE * max(float(values[0]), 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    values, found_vectors = values[good], found_vectors[:, good]
    if found_vectors.size:
        largest = found_vectors[np.argmax(np.round(np.abs(found_vectors), 9), axis=0), np.arange(found_vectors.shape[1])]
        found_vectors = found_vectors * np.where(largest < 0, -1.0, 1.0)
    return Fit(n, fit.sums, trace, values, found_vectors, expanded)


def identity_error(vectors: DataFrame, fit: Fit) -> float:
    """How far the covariance of the whitened fit list is from the identity, at its worst entry."""
    k = len(fit.values)
    ones, products = _summed(vectors.select("x").mapInArrow(_outer(fit), "at int, row array<double>"), k, k)
    mean = ones / fit.n
    return float(np.abs(products / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """For each row the sum of ``(n*x - S)**2``, exact; None where a long can't hold it."""
    moved, n, rests = x - fit.floors, fit.n, fit.rests
    if (float(np.abs(moved).max(initial=0)) * n + n) ** 2 * x.shape[1] < 2.0**62:
        return ((n * moved - rests) ** 2).sum(axis=1).tolist()
    exact = ((n * moved.astype(object) - rests.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, fit: Fit, error: float) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row of ``vectors`` (id, x) and component."""
    k = len(fit.values)
    explained = fit.values / fit.trace if k else np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch)
            m = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            columns = (
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), pa.array([v for v in deviations(x, fit) for _ in range(k)], pa.int64()),
                pa.array((fit.centred(x) @ fit.scale).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            )
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = vectors.select("id").schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    return vectors.mapInArrow(run, schema)


def query(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of all vectors of ``rows`` that can be used.

    Left out are the vectors that ``quantised`` and ``of_one_length`` leave out. Repeated rows give rows each, a null
    id stays null, an empty table gives an empty result, and vectors that are all alike have no component; other
    columns are ignored. A deviation that a long can't hold is null.
    """
    vectors = of_one_length(saved(quantised(rows)))
    once = saved(vectors.select("x").distinct())
    fit = fitted(once, components)
    if fit is None:
        fit = Fit(1, (), 0.0, np.empty(0), np.empty((0, 0)), False)
    error = identity_error(once, fit) if len(fit.values) else 0.0
    return whitened(vectors, fit, error).withColumnRenamed("id", "vec_id")
