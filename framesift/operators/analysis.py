"""Work on single files: bounded in time, errors kept in a column, results that are known not made again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TookTooLong

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions.hashing import difference_hash, hash_text, luma
from framesift.operators.catalogue import cache_state

#: Seconds that one file may take, and files of one task that may be stuck before the task is given up.
TIMEOUT_S, MOST_STUCK = 15.0, 16


def each(rows: DataFrame, work: Callable[[dict], object], result: T.DataType, keep: tuple[str, ...], timeout_s: float = TIMEOUT_S, most_stuck: int = MOST_STUCK) -> DataFrame:
    """``keep``, ``value`` and ``error``: what ``work`` makes of each row.

    A row that raises, or takes longer than ``timeout_s``, has a null value and says why; the others go on. Spark
    runs as many at once as it has task slots. A late result is thrown away with the thread that made it; as a thread
    that is stuck can't be ended, a task with more than ``MOST_STUCK`` of them fails.
    """
    schema = rows.select(*keep).schema.add("value", result).add("error", "string")
    kind = T.StructType([T.StructField("value", result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        pool, arrow, stuck = ThreadPoolExecutor(1), to_arrow_schema(kind).field("value").type, 0
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                try:
                    values.append(pool.submit(work, row).result(timeout_s))
                    errors.append(None)
                except TookTooLong:
                    stuck += 1
                    if stuck > most_stuck:
                        raise RuntimeError(f"{stuck} files of one task took more than {timeout_s:g} s") from None
                    pool.shutdown(wait=False)
                    pool = ThreadPoolExecutor(1)
                    values.append(None)
                    errors.append(f"took more than {timeout_s:g} s")
                except Exception as e:  # noqa: BLE001  any failure of one row is that row's result
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, arrow), pa.array(errors, pa.string())], [*keep, "value", "error"])

    return rows.mapInArrow(run, schema)


def without_done(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows that are not done yet, with the same fingerprint; null fingerprints are alike."""
    marks = done.select(*keys, F.struct("fingerprint_mtime", "fingerprint_size").alias("_done")).distinct()
    left = rows.withColumn("_print", F.struct("fingerprint_mtime", "fingerprint_size"))
    both = (left[k] == marks[k] for k in keys)
    condition = left["_print"].eqNullSafe(marks["_done"])
    for k in both:
        condition = condition & k
    return left.join(marks, condition, "left_anti").drop("_print")


def with_cache(photos: DataFrame, rehash: Callable[[dict], object], regenerate: Callable[[dict], object], result: T.DataType, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """project_id, id, outcome, value and error of visible photos, with what is stored used as far as it holds.

    A photo whose analysis is stored whole is a "hit" and costs no work; one whose thumbnail holds goes through
    ``rehash``, any other through ``regenerate``; one whose work fails or takes too long is "failed" and says why.
    """
    rows = photos.where(~F.col("is_missing")).withColumn("_state", cache_state())
    hits = rows.where("_state = 'hit'").select("project_id", "id", F.lit("hit").alias("outcome"), F.lit(None).cast(result).alias("value"), F.lit(None).cast("string").alias("error"))
    out = hits
    for state, work in (("rehash", rehash), ("regenerate", regenerate)):
        done = each(rows.where(F.col("_state") == state).drop("_state"), work, result, ("project_id", "id"), timeout_s)
        out = out.unionByName(done.withColumn("outcome", F.when(F.col("error").isNull(), F.lit(state)).otherwise(F.lit("failed"))))
    return out


def hashes_of_pixels(rows: DataFrame, width: int = 9, height: int = 8) -> DataFrame:
    """``d_hash`` of pictures scaled to a grid: ``red``, ``green`` and ``blue`` arrays in row order."""
    grid = F.transform(F.arrays_zip("red", "green", "blue"), lambda p: luma(p["red"], p["green"], p["blue"]))
    whole = F.size("red") == width * height
    return rows.withColumn("_grid", grid).withColumn("d_hash", F.when(whole, hash_text(difference_hash(F.col("_grid"), width, height)))).drop("_grid")


def oriented(grid: Column, width: int, height: int, orientation: Column) -> Column:
    """A grid in row order turned upright by its EXIF orientation; 5 to 8 exchange width and height."""

    def pick(index: Callable[[int, int], int], w: int, h: int) -> Column:
        return F.array(*(grid[index(x, y)] for y in range(h) for x in range(w)))

    at = lambda x, y: y * width + x
    w, h = width, height
    turned = {
        2: pick(lambda x, y: at(w - 1 - x, y), w, h), 3: pick(lambda x, y: at(w - 1 - x, h - 1 - y), w, h), 4: pick(lambda x, y: at(x, h - 1 - y), w, h),
        5: pick(lambda x, y: at(y, x), h, w), 6: pick(lambda x, y: at(y, h - 1 - x), h, w), 7: pick(lambda x, y: at(w - 1 - y, h - 1 - x), h, w), 8: pick(lambda x, y: at(w - 1 - y, x), h, w),
    }
    out = F.when(orientation == 2, turned[2])
    for k in range(3, 9):
        out = out.when(orientation == k, turned[k])
    return out.otherwise(grid)
