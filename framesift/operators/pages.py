"""Pages, lookups, histograms, seeds and backlogs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions.scalars import clamped_rating
from framesift.schema import DEFAULT_PAGE, HASH_VERSION, MAX_RATING, PAGE_LIMIT, THUMBNAIL_VERSION
from framesift.storage import saved

NAME_ORDER = (F.asc, "relative_path"), (F.asc, "id")
RATING_ORDER = (F.desc, "rating"), (F.asc, "relative_path"), (F.asc, "id")
CAPTURE_ORDER = (F.asc_nulls_last, "captured_at"), (F.asc, "relative_path"), (F.asc, "id")


def ordering(order: Sequence) -> list[Column]:
    return [direction(name) for direction, name in order]


def visible(photos: DataFrame, project: str | None = None, rating: int | None = None) -> DataFrame:
    """Photos that are not missing, of a project and of exactly a rating (0 is one); None takes all."""
    rows = photos.where(~F.col("is_missing"))
    rows = rows if project is None else rows.where(F.col("project_id") == project)
    return rows if rating is None else rows.where(F.col("rating") == rating)


def page(photos: DataFrame, project: str, offset: int = 0, limit: int = 80, rating: int | None = None, order: Sequence = NAME_ORDER) -> DataFrame:
    """A page of photos with ``total``, the number over all pages. Limits are kept within 1 to 200, offsets from 0.

    The sort stops at the page's last row; the total is a count of its own.
    """
    rows = visible(photos, project, rating)
    total = rows.agg(F.count("*").alias("total"))
    some = rows.orderBy(*ordering(order)).offset(max(0, offset)).limit(min(max(1, limit), PAGE_LIMIT))
    return some.crossJoin(F.broadcast(total))  # one row


def selection_seed(photos: DataFrame, project: str, rating: int | None = None) -> DataFrame:
    """id and rating in order of capture, undated photos last."""
    return visible(photos, project, rating).orderBy(*ordering(CAPTURE_ORDER)).select("id", "rating")


def rating_summary(photos: DataFrame) -> DataFrame:
    """For each project the number of visible photos of each rating, and in all; ratings are clamped into range."""
    counts = [F.count_if(clamped_rating(F.col("rating")) == r).alias(f"n{r}") for r in range(MAX_RATING + 1)]
    return visible(photos).groupBy("project_id").agg(*counts, F.count("*").alias("total"))


def by_ids(photos: DataFrame, ids: DataFrame) -> DataFrame:
    """Visible photos of ``ids`` (pos, id) in the order of pos; unknown ids are left out, repeated ones come once."""
    first = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return visible(photos).join(first, "id").orderBy("pos")


def analysis_backlog(photos: DataFrame) -> DataFrame:
    """Visible photos of each project that still need analysis."""
    needs = (
        F.col("captured_at").isNull()
        | F.col("timestamp_source").isNull()
        | F.col("d_hash").isNull()
        | ~F.col("d_hash_version").eqNullSafe(F.lit(HASH_VERSION))
        | F.col("thumbnail_path").isNull()
        | ~F.col("thumbnail_version").eqNullSafe(F.lit(THUMBNAIL_VERSION))
    )
    return visible(photos).groupBy("project_id").agg(F.count_if(needs).alias("backlog"))


def _needs_display(edge: int) -> Column:
    return F.col("display_path").isNull() | ~F.col("display_edge").eqNullSafe(F.lit(edge))


def display_backlog(photos: DataFrame, edge: int) -> DataFrame:
    """Visible photos of each project without a display image of this edge."""
    return visible(photos).groupBy("project_id").agg(F.count_if(_needs_display(edge)).alias("backlog"))


def to_display(photos: DataFrame, edge: int) -> DataFrame:
    """Visible photos without a display image of this edge; they are worked on in order of capture."""
    return visible(photos).where(_needs_display(edge))


def failed_count(photos: DataFrame) -> DataFrame:
    """Visible photos of each project whose analysis failed."""
    return visible(photos).groupBy("project_id").agg(F.count_if(F.col("analysis_error").isNotNull()).alias("failed"))


def needs_metadata(photos: DataFrame) -> DataFrame:
    """Visible photos without a capture time or without its source."""
    return visible(photos).where(F.col("captured_at").isNull() | F.col("timestamp_source").isNull())


def display_url(photos: DataFrame) -> DataFrame:
    """The image to show: the display image, else the thumbnail, else the file itself."""
    return photos.select("id", F.coalesce("display_path", "thumbnail_path", "relative_path").alias("url"))


def source_histogram(photos: DataFrame, column: str = "timestamp_source") -> DataFrame:
    """Visible photos by project and the values of a column, with their share of the project."""
    counts = visible(photos).groupBy("project_id", column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("project_id")))


def nearest_rank(rows: DataFrame, value: str, points: Sequence[float], *by: str) -> DataFrame:
    """Values at nearest ranks (place round((n - 1) * p) of the sorted values), mean and maximum, for each group.

    Values are counted before the shuffle and dealt out by ranges, which are written; the sums of ranges tell in which
    one each rank lies, and only those are looked into. So neither many rows nor many different values of a group are one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    keys = [*(F.asc(c) for c in by), F.asc("_value")]
    dealt = saved(counts.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"), F.sum(F.col("_value") * F.col("_c")).alias("_sum"), F.max("_value").alias("_max"))
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    summed = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0)))
    totals = ranges.groupBy(*by).agg(F.sum("_n").alias("_all"), F.sum("_sum").alias("_sum"), F.max("_max").alias("max"))
    nth = F.inline(F.array(*(F.struct(F.lit(i).alias("_point"), F.floor((F.col("_all") - 1) * F.lit(p) + 0.5).alias("_rank")) for i, p in enumerate(points))))
    ranks = totals.select(*by, nth)
    if not by:
        summed, ranks, totals = (x.withColumn("_one", F.lit(1)) for x in (summed, ranks, totals))
        dealt = dealt.withColumn("_one", F.lit(1))
    group = list(by) or ["_one"]
    holding = summed.join(ranks, group).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    inside = dealt.join(holding.select(*group, "_part", "_point", "_rank", "_before"), [*group, "_part"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*group, "_part", "_point").orderBy("_value"))
    found = inside.withColumn("_upto", upto).where(F.col("_upto") > F.col("_rank")).groupBy(*group).agg(*(F.min(F.when(F.col("_point") == i, F.col("_value"))).alias(f"p{round(p * 100)}") for i, p in enumerate(points)))
    names = [f"p{round(p * 100)}" for p in points]
    return found.join(totals, group).select(*by, *names, (F.col("_sum") / F.col("_all")).alias("mean"), "max")


def write_index(photos: DataFrame, path: str, order: Sequence = NAME_ORDER, by: Sequence[str] = ("project_id",)) -> None:
    """Visible photos in ``order`` within each group of ``by``, as Parquet by ranges, with an index of the ranges' places.

    A page at any offset then reads the ranges that hold it, and no row is sorted that isn't in them.
    """
    keys = [*(F.asc(c) for c in by), *ordering(order)]
    dealt = visible(photos).repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("part", *keys).write.partitionBy("part").parquet(f"{path}/rows")
    held = photos.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    counts = held.groupBy(*by, "part").agg(F.count("*").alias("n"))
    over = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).write.parquet(f"{path}/index")


def indexed_total(spark: SparkSession, path: str, group: Mapping[str, object]) -> int:
    """Photos of a group, by the index."""
    return _of_group(spark.read.parquet(f"{path}/index"), group).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _of_group(rows: DataFrame, group: Mapping[str, object]) -> DataFrame:
    return rows.where(reduce(and_, (F.col(c).eqNullSafe(F.lit(v)) for c, v in group.items())))


def indexed_page(spark: SparkSession, path: str, group: Mapping[str, object], offset: int = 0, limit: int = DEFAULT_PAGE, order: Sequence = NAME_ORDER) -> DataFrame:
    """A page by an index of ``write_index``, with ``total``; limits and offsets are kept within range as in ``page``."""
    offset, limit = max(0, offset), min(max(1, limit), PAGE_LIMIT)
    ranges, total = _of_group(spark.read.parquet(f"{path}/index"), group), indexed_total(spark, path, group)
    held = ranges.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select("part", "before").collect()  # those of one page
    rows = _of_group(spark.read.parquet(f"{path}/rows").where(F.col("part").isin([r["part"] for r in held])), group)
    skipped = offset - min((r["before"] for r in held), default=offset)
    return rows.orderBy(*ordering(order)).offset(skipped).limit(limit).drop("part").withColumn("total", F.lit(total).cast("bigint"))


def page_after(photos: DataFrame, project: str, last: Mapping[str, object] | None, limit: int = DEFAULT_PAGE, rating: int | None = None, order: Sequence = NAME_ORDER) -> DataFrame:
    """The page that follows a row, given by its columns of ``order``; None gives the first page. No row before it is sorted.

    Columns of the order must not be null.
    """
    rows = visible(photos, project, rating)
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for direction, name in order:
            value = F.lit(last[name])
            beyond = beyond | (same & ((F.col(name) < value) if direction is F.desc else (F.col(name) > value)))
            same = same & (F.col(name) == value)
        rows = rows.where(beyond)
    return rows.orderBy(*ordering(order)).limit(min(max(1, limit), PAGE_LIMIT))


def with_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with each of ``columns`` (name to type) that it lacks, as null."""
    return rows.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in columns.items() if name not in rows.columns))
