"""Pictures decoded by Spark's own reader (JPEG, PNG and others), and their hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.hashing import difference_hash, hash_text, luma
from framesift.functions.scalars import fit_long_edge

#: Points that are taken of each cell of a grid, along each side.
POINTS = 8


def decoded(spark: SparkSession, folder: str, names: str = "*") -> DataFrame:
    """path, width, height, channels, data (rows of pixels from the top, blue before red) and error of the pictures below a folder with names like ``names``.

    A file that can't be decoded has an error and no data; the others go on.
    """
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder).select("image.*")
    broken = (F.col("height") <= 0) | (F.col("width") <= 0) | (F.col("nChannels") <= 0)
    fine = lambda c: F.when(~broken, F.col(c))
    return read.select(
        F.regexp_replace("origin", "^file:(//)?", "").alias("path"), fine("width").alias("width"), fine("height").alias("height"), fine("nChannels").alias("channels"), fine("data").alias("data"),
        F.when(broken, F.lit("can't be decoded")).alias("error"),
    )


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int")


def grid(width: int = 9, height: int = 8, points: int = POINTS) -> Column:
    """The picture scaled to a grid of brightness in row order: the mean of points spread over each cell."""
    w, h, n, data = F.col("width").cast("int"), F.col("height").cast("int"), F.col("channels").cast("int"), F.col("data")

    def brightness(x: Column, y: Column) -> Column:
        at = (y * w + x) * n
        colour = luma(_byte(data, at + 2), _byte(data, at + 1), _byte(data, at))
        return F.when(n >= 3, colour).otherwise(_byte(data, at))

    def cell(i: Column) -> Column:
        def add(total: Column, k: Column) -> Column:
            x = F.floor((i % width * points + k % points + 0.5) * w / (width * points)).cast("int")
            y = F.floor((F.floor(i / width) * points + F.floor(k / points) + 0.5) * h / (height * points)).cast("int")
            return total + brightness(x, y)

        return F.floor(F.aggregate(F.sequence(F.lit(0), F.lit(points * points - 1)), F.lit(0), add) / (points * points)).cast("int")

    return F.when(data.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), cell))


def hashed(pictures: DataFrame, edge: int = 256) -> DataFrame:
    """path, d_hash, the size of a thumbnail with a long side of ``edge`` at most, and error; JVM-side throughout."""
    rows = pictures.withColumn("_grid", grid()).withColumn("_size", F.when(F.col("data").isNotNull(), fit_long_edge(F.col("width"), F.col("height"), F.lit(edge))))
    of = F.when(F.col("_grid").isNotNull(), hash_text(difference_hash(F.col("_grid"))))
    return rows.select("path", of.alias("d_hash"), F.col("_size.width").alias("thumbnail_width"), F.col("_size.height").alias("thumbnail_height"), "error")
