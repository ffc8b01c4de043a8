"""Shards along a Hilbert curve, so that files can be skipped by several columns at once.

Each of some columns is cut into cells that hold about equally many rows; the cells are the coordinates of a row, and
rows are sorted by their place on a Hilbert curve through them. The curve is cut into runs of equal numbers of rows (or
bytes), the shards. Neighbours on the curve are neighbours in all columns, so a shard covers a small range of each, and
a manifest of those ranges tells which shards a filter on any of the columns has to read.

All is built-in functions: no Python runs in tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.llm.common import numbered, shared_dir, text_of

SHARDS, BITS = 24, 4
#: Bytes that a row has beside its text.
OVERHEAD = 8
#: Columns of documents that shards are laid out by; ``size`` is that of the text.
DIMENSIONS = ("source", "lang", "size")
#: Columns that are added; a column of the rows with such a name is kept as own_<name>.
ADDED = ("size", "text_crc32", "law", "shard", "slot")
#: Bits of a cell's number up to which the places of all cells are a table, of 65,536 rows at most.
LOOKED_UP = 16
#: Rows of a numbered table that are summed in one task.
STRETCH = 1 << 16


def _running(placed: DataFrame, value: str) -> DataFrame:
    """``placed`` (with ``place``) and ``before``, the sum of a column over all earlier rows, by stretches of places."""
    rows = placed.withColumn("_stretch", F.floor(F.col("place") / STRETCH))
    earlier = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    sums = rows.groupBy("_stretch").agg(F.sum(value).alias("_sum")).select("_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    summed = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, "_stretch")
    return summed.withColumn("before", F.col("_base") + F.col("_inside")).drop("_stretch", "_inside", "_base")


def cuts(rows: DataFrame, column: str, bits: int = BITS) -> list[tuple[int, object]]:
    """The cells of a column that have values, with the least value of each, in order; 2**bits at most.

    The cell of a value is the share of rows with lesser values. Values are counted first, so one that a third of
    all rows have is one row here, and many different ones are numbered by ranges. Nulls have no cell.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    below = _running(numbered(counts, F.asc("value")), "n")
    total = below.agg(F.sum("n")).first()[0]
    if not total:
        return []
    cell = F.expr(f"(before * {1 << bits}) div {total}")
    return sorted(tuple(r) for r in below.groupBy(cell.alias("cell")).agg(F.min("value")).collect())


def cell(value: Column, found: Sequence[tuple[int, object]]) -> Column:
    """The cell of a value by its ``cuts``; 0 for a null."""
    of = F.lit(0)
    for number, low in found:
        of = F.when(value >= F.lit(low), F.lit(number)).otherwise(of)
    return of.cast("int")


def hilbert(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The place of a cell on the Hilbert curve through a cube of 2**bits cells a side.

    From the highest bit down, each coordinate's bit mirrors the lower bits of the first coordinate, or exchanges
    them with its own; the coordinates that remain are a Gray code, and its bits in turn are the place.
    """
    n, xor = len(cells), lambda a, b: a.bitwiseXOR(b)
    steps = lambda last: F.array(*(F.struct(F.lit(i).alias("axis"), F.lit(1 << b).alias("bit")) for b in range(bits - 1, last, -1) for i in range(n)))

    def turn(x: Column, step: Column) -> Column:
        lower, own = step["bit"] - 1, F.get(x, step["axis"])
        on = own.bitwiseAND(step["bit"]) != 0
        exchanged = xor(F.get(x, F.lit(0)), own).bitwiseAND(lower)
        mask = lambda j: F.when(on, F.when(j == 0, lower).otherwise(0)).when((j == 0) | (j == step["axis"]), exchanged).otherwise(0)
        return F.transform(x, lambda v, j: F.when((step["axis"] == 0) & ~on, v).otherwise(xor(v, mask(j))))

    x = F.array(*(c.cast("int") for c in cells))
    if bits > 1:
        x = F.aggregate(steps(0), x, turn)
    x = F.transform(x, lambda _, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), xor))
    last = F.element_at(x, -1)
    flip = F.lit(0)
    for b in range(1, bits):
        flip = xor(flip, F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    both = F.struct(x.alias("x"), flip.alias("flip"))
    bit_of = lambda s, step: F.when(xor(F.get(s["x"], step["axis"]), s["flip"]).bitwiseAND(step["bit"]) != 0, 1).otherwise(0)
    digits = F.transform(F.array(both), lambda s: F.aggregate(steps(-1), F.lit(0).cast("long"), lambda t, step: t * 2 + bit_of(s, step)))
    return F.get(digits, F.lit(0))


def _on_curve(rows: DataFrame, cells: Sequence[Column], bits: int) -> DataFrame:
    """``rows`` with ``curve``, the place of their cell. Places of a cube of few cells are worked out once and looked up."""
    n = len(cells)
    if n * bits > LOOKED_UP:
        return rows.withColumn("curve", hilbert(cells, bits))
    code = sum((c.cast("long") * F.lit(1 << bits * i) for i, c in enumerate(cells)), F.lit(0))
    axes = [F.shiftright("_code", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
    table = rows.sparkSession.range(1 << n * bits, numPartitions=1).toDF("_code").select("_code", hilbert(axes, bits).alias("curve"))
    return rows.withColumn("_code", code).join(F.broadcast(table), "_code").drop("_code")


def arranged(docs: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32 and ``place``, from 0 along the curve.

    Within a cell equal texts are together, by their CRC, and then in order of ids, null ones first. The CRC is that of the
    UTF-8 bytes, unsigned; a null text has no bytes.
    """
    renamed = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c in (*ADDED, "place", "curve")})
    rows = renamed.withColumn("size", (F.octet_length(text_of(text)) + OVERHEAD).cast("long")).withColumn("text_crc32", F.crc32(text_of(text).cast("binary")))
    cells = [cell(F.col(c), cuts(rows, c, bits)) for c in dimensions]
    return numbered(_on_curve(rows, cells, bits), F.asc("curve"), F.asc("text_crc32"), F.asc("size"), F.asc(doc_id)).drop("curve")


def cut(placed: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """Rows with ``place`` and size dealt out to runs: law, shard and slot, from 0 in each shard.

    By ``rows`` the shards' numbers of rows are one apart at most; by ``bytes`` a shard begins with the row at which
    its share of all bytes does, so a shard is off by one row's size at most.
    """
    if law == "rows":
        total = placed.count()
        number = F.expr(f"(place * {shards}) div {max(total, 1)}")
        slot = F.col("place") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
        dealt = placed.withColumn("shard", number).withColumn("slot", slot)
    elif law == "bytes":
        summed = _running(placed, "size")
        total = placed.agg(F.sum("size")).first()[0] or 1
        dealt = summed.withColumn("shard", F.expr(f"(before * {shards}) div {total}")).drop("before")
        first = dealt.groupBy("shard").agg(F.min("place").alias("_first"))
        dealt = dealt.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("_first")).drop("_first")
    else:
        raise ValueError(f"no such law: {law}")
    return dealt.drop("place").withColumn("law", F.lit(law)).withColumn("shard", F.col("shard").cast("int"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, law: str = "rows", bits: int = BITS) -> None:
    """Shards as Parquet below ``path``: a folder for each with its rows in order, and a manifest.

    The manifest has a row a shard: rows, bytes, and the least and greatest value of each dimension.
    """
    spark = docs.sparkSession
    dealt = cut(arranged(docs, dimensions, bits), shards, law)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    ranges = [e for c in dimensions for e in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"greatest_{c}"))]
    held = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    held.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ranges).write.parquet(f"{path}/manifest")


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of shards that were written with this schema."""
    return spark.read.schema(schema).parquet(f"{path}/rows")


def matching(spark: SparkSession, path: str, ranges: Mapping[str, tuple[object, object]]) -> list[int]:
    """The shards that may hold rows with each of some dimensions from a least to a greatest value, by the manifest."""
    rows = spark.read.parquet(f"{path}/manifest")
    for c, (low, high) in ranges.items():
        rows = rows.where((F.col(f"greatest_{c}") >= F.lit(low)) & (F.col(f"least_{c}") <= F.lit(high)))
    return sorted(r["shard"] for r in rows.select("shard").collect())


def read(spark: SparkSession, path: str, ranges: Mapping[str, tuple[object, object]]) -> DataFrame:
    """The rows with each of some dimensions in a range; of other shards than ``matching`` no file is opened."""
    rows = spark.read.parquet(f"{path}/rows").where(F.col("shard").isin(matching(spark, path, ranges)))
    for c, (low, high) in ranges.items():
        rows = rows.where(F.col(c).between(F.lit(low), F.lit(high)))
    return rows


def query(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of all rows, read back from the shards' files.

    Null and empty texts have the size of a row without text; null dimensions are in the first cell; repeated rows
    take a place each; with fewer rows than shards some are empty; an empty table gives an empty result; other columns are ignored.
    """
    spark, path = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    own = docs.select("doc_id", "text", *(c for c in DIMENSIONS if c != "size"))
    write(own, path, shards)
    schema = own.schema
    for name, kind in (("size", "long"), ("text_crc32", "long"), ("slot", "long"), ("law", "string"), ("shard", "integer")):
        schema = schema.add(name, kind)
    rows = written(spark, path, schema)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
