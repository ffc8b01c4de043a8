"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.storage import saved, shared_dir  # noqa: F401  the operators take them from here

#: Rows and bytes in one Arrow batch: a batch of usual texts is a few megabytes, and one of long texts has fewer rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Python workers keep at most so many entries in a cache, then start it anew.
CACHE_ENTRIES = 600_000
#: Rows that a task remembers so as not to pass on their repeats.
REMEMBERED = 1 << 15
#: A key is hot if it has more than one in so many rows; so many keys at most can be hot.
HOT = 10_000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of its input at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table below ``sf_dir``."""
    return read(spark, sf_dir, "documents")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table below ``sf_dir``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as a string, a null one as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The id as a long; for a null one a number below -2**62, by the hash of the text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 61)))


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, from one small aggregate."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def packed(source: DataFrame, text: str, once: Sequence[str] = ()) -> DataFrame:
    """``source`` with a text column compressed and put last, for a shuffle of whole texts.

    With ``once``, whole numbers that tell rows apart, most repeats go, within tasks: a row that a third of the table
    repeats is one row a task.
    """
    names = source.columns
    order = [n for n in names if n != text]
    schema = source.select(*order).schema.add(text, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            if once:
                new = []
                for key in zip(*(batch.column(names.index(c)).to_pylist() for c in once)):
                    new.append(key not in seen)
                    seen.add(key)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not all(new):
                    batch = batch.filter(pa.array(new, pa.bool_()))
            column = pa.array([press(t.encode()) for t in batch.column(names.index(text)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in order), column], [*order, text])

    return source.mapInArrow(run, schema)


def unpacked(column: pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 texts of a compressed column."""
    return map(zstandard.ZstdDecompressor().decompress, column.to_pylist())


def join_facts(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has a row for each ``key``, and in ``n`` how many of ``total`` rows have it.

    Rows without facts go. Facts on hot keys, ``HOT`` at most, are sent to every task, so the rows of a key that a
    third of all rows share stay where they are; all others meet by a shuffle.
    """
    hot = facts.where(F.col("n") * HOT > total).drop("n")
    rest = facts.where(F.col("n") * HOT <= total).drop("n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, from 0 in the given order over the whole table; equal rows come in any order.

    Rows are dealt out by ranges of the order, sorted in each, and written with their number in their range; the sizes
    of the ranges before are added. Equal rows are spread over ranges, so no key ends in a task of its own, and only
    the sizes, one for each partition of the shuffle, are summed in one place. ``rows`` must have no columns
    ``place``, ``_at`` and ``_range``.
    """
    sort = [*order, F.asc("_at")]
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort)
    held = saved(dealt.withColumn("_at", F.monotonically_increasing_id()))
    bits = 33  # of the number within a partition, by the definition of that function
    ranges = held.groupBy(F.shiftright("_at", bits).alias("_range")).agg(F.count("*").alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = held.withColumn("_range", F.shiftright("_at", bits)).join(F.broadcast(before), "_range")
    return placed.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << bits) - 1))).drop("_range", "_at", "_before")
