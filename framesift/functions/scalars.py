"""Small calculations on ratings, sizes and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.schema import DEFAULT_EDGE, DISPLAY_EDGES, LARGE_GROUPS, MAX_RATING, MAX_THRESHOLD, MIN_GROUP, SMALL_GROUPS, SOURCES, WEAK_SOURCES


def clamp(value: Column, low: int, high: int) -> Column:
    """``value`` within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def clamped_rating(value: Column) -> Column:
    return clamp(value, 0, MAX_RATING).cast("int")


def clamped_threshold(value: Column) -> Column:
    return clamp(value, 0, MAX_THRESHOLD).cast("int")


def group_size(value: Column, large: bool = True) -> Column:
    """A wanted size of groups, rounded and within bounds; the default where it is no finite number."""
    default, most = LARGE_GROUPS if large else SMALL_GROUPS
    number = value.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, clamp(F.round(number), MIN_GROUP, most)).otherwise(F.lit(default)).cast("int")


def display_edge(value: Column) -> Column:
    """An allowed edge length; the default for any other."""
    return F.when(value.isin(*DISPLAY_EDGES), value).otherwise(F.lit(DEFAULT_EDGE)).cast("int")


def resolved_edge(project_edge: Column, setting: Column) -> Column:
    """The project's edge, else the global setting if it is a number, else the default."""
    return display_edge(F.coalesce(project_edge.cast("bigint"), setting.try_cast("bigint"), F.lit(DEFAULT_EDGE).cast("bigint")))


def fit_long_edge(width: Column, height: Column, edge: Column) -> Column:
    """struct<width,height> with the long side at ``edge`` or less; never larger than before, never below 1."""
    long_side = F.greatest(width, height)
    scaled = lambda side: F.greatest(F.lit(1), F.round(side * edge / long_side)).cast("int")
    fits = long_side <= edge
    return F.struct(F.when(fits, width).otherwise(scaled(width)).cast("int").alias("width"), F.when(fits, height).otherwise(scaled(height)).cast("int").alias("height"))


def known_source(source: Column) -> Column:
    """A source of capture times; unknown for null or any other text."""
    return F.when(source.isin(*SOURCES), source).otherwise(F.lit("unknown"))


def is_weak(source: Column) -> Column:
    """True for times that say when a file was written, not when the picture was taken."""
    return known_source(source).isin(*WEAK_SOURCES)


def pair_key(left: Column, right: Column) -> Column:
    """left:right; the direction counts."""
    return F.concat_ws(":", left, right)


def is_selected(select_all: Column, deviations: Column, photo_id: Column) -> Column:
    """Membership in a selection that is stored as all or none with deviations."""
    return select_all != F.array_contains(deviations, photo_id)


def selected_count(select_all: Column, deviations: Column, total: Column) -> Column:
    return F.when(select_all, F.greatest(total - F.size(deviations), F.lit(0))).otherwise(F.size(deviations))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / F.nullif(whole, F.lit(0)))


def crc32(data: Column) -> Column:
    """CRC-32 of bytes, unsigned."""
    return F.crc32(data)


def dos_date_time(at_ms: Column) -> Column:
    """struct<date,time> as archives store it (UTC); years before 1980 become its first day."""
    at = F.timestamp_millis(at_ms)
    early = F.year(at) < 1980
    date = F.when(early, F.lit((1 << 5) | 1)).otherwise(F.shiftleft(F.year(at) - 1980, 9).bitwiseOR(F.shiftleft(F.month(at), 5)).bitwiseOR(F.dayofmonth(at)))
    time = F.when(early, F.lit(0)).otherwise(F.shiftleft(F.hour(at), 11).bitwiseOR(F.shiftleft(F.minute(at), 5)).bitwiseOR(F.floor(F.second(at) / 2).cast("int")))
    return F.struct(date.alias("date"), time.alias("time"))


def shuffled_order(photo_id: Column, seed: int) -> Column:
    """A key that orders rows at random, but always alike for one seed."""
    return F.xxhash64(photo_id, F.lit(seed))


def toggled(items: Column, item: Column) -> Column:
    """The array without ``item`` if it holds it, else with it at the end."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def default_move_target(rating: Column) -> Column:
    """Where photos of a rating are offered to go: one up, from the top one down."""
    return F.when(rating >= MAX_RATING, F.lit(MAX_RATING - 1)).otherwise(rating + 1).cast("int")
