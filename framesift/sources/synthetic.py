"""Made-up pictures for measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pictures(spark: SparkSession, n: int, edge: int = 64, first: int = 0) -> DataFrame:
    """``n`` pictures of edge x edge: name, and red, green and blue in row order; patterns shift with the number."""
    seed = F.col("id") * 37
    places = F.sequence(F.lit(0), F.lit(edge * edge - 1))
    plane = lambda value: F.transform(places, lambda i: (value(i % edge, F.floor(i / edge)) % 256).cast("int"))
    rows = spark.range(first, first + n)
    return rows.select(
        F.format_string("synthetic-%06d.jpg", "id").alias("name"),
        plane(lambda x, y: 4 * x + seed).alias("red"),
        plane(lambda x, y: 4 * y + F.floor(seed / 3)).alias("green"),
        plane(lambda x, y: x + y + F.floor(seed / 7)).alias("blue"),
    )
