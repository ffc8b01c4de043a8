"""Ratings, rounds and bursts in a round.

Ratings are a log of events (project_id, photo_id, seq, op, rating): the current rating is that of the last
event, and to undo is to leave the last step out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.scalars import clamped_rating
from framesift.operators.pages import CAPTURE_ORDER, ordering
from framesift.schema import MAX_RATING
from framesift.storage import saved


#: Bits of a row's number within its partition, by the definition of Spark's increasing ids.
_AT_BITS = 33


def placed(rows: DataFrame, order: Sequence = CAPTURE_ORDER, *by: str) -> DataFrame:
    """``rows`` with ``place``, from 1 in the given order, within each group of ``by``.

    Rows are dealt out by a range of the order, sorted in it and written with their number; each range adds what stands
    before it, so neither a large group nor the lack of one ends in a single task, and no window runs over rows. They
    are written, as another run of the same plan may draw other ranges.
    """
    keys = [*(F.asc(c) for c in by), *ordering(order)]
    dealt = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _AT_BITS)
    counts = dealt.groupBy(part.alias("_part"), *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = dealt.withColumn("_part", part).join(before, ["_part", *by])
    return joined.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def save_results(photos: DataFrame, results: DataFrame) -> DataFrame:
    """``photos`` with the ratings of ``results`` (project_id, id, rating), clamped; ids of other projects do nothing."""
    new = results.select("project_id", "id", clamped_rating(F.col("rating")).alias("_new"))
    return photos.join(new, ["project_id", "id"], "left").withColumn("rating", F.coalesce("_new", "rating")).drop("_new")


def reset_results(photos: DataFrame) -> DataFrame:
    """All ratings back to 0, those of missing photos too; nothing else changes."""
    return photos.withColumn("rating", F.lit(0))


def move_rating(photos: DataFrame, project: str, source: int, target: int, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(id, rating) of the visible photos that change from one rating to another.

    Only ids of ``include`` move, if it is given, and none of ``exclude``. A rating out of range raises; equal
    ratings move nothing.
    """
    if not (0 <= source <= MAX_RATING and 0 <= target <= MAX_RATING):
        raise ValueError(f"ratings go from 0 to {MAX_RATING}")
    rows = photos.where((F.col("project_id") == project) & ~F.col("is_missing") & (F.col("rating") == source) & F.lit(source != target))
    if include is not None:
        rows = rows.join(include.select("id"), "id", "left_semi")
    if exclude is not None:
        rows = rows.join(exclude.select("id"), "id", "left_anti")
    return rows.select("id", F.lit(target).alias("rating"))


def move_arguments(select_all: Column, deviations: Column) -> Column:
    """struct<include,exclude>: a selection with deviations as lists; a null include means all."""
    none = F.lit(None).cast("array<string>")
    return F.struct(F.when(select_all, none).otherwise(deviations).alias("include"), F.when(select_all, deviations).otherwise(F.array().cast("array<string>")).alias("exclude"))


def latest_ratings(log: DataFrame) -> DataFrame:
    """The current rating of every photo in a log; an event without a rating counts as 0."""
    last = F.max_by(F.struct("rating"), "seq").getField("rating")
    return log.groupBy("project_id", "photo_id").agg(F.coalesce(clamped_rating(last), F.lit(0)).alias("rating"), F.max("seq").alias("seq"))


def undo(log: DataFrame) -> DataFrame:
    """``log`` without the last step of each project; earlier ratings show again as they were."""
    last = log.groupBy("project_id").agg(F.max("seq").alias("_last"))
    return log.join(last, "project_id").where(F.col("seq") < F.col("_last")).drop("_last")


def undo_by_one(rating: Column) -> Column:
    """The rating after an undo that takes off one, not below 0."""
    return clamped_rating(rating - 1)


def rounds(photos: DataFrame, size: int, order: Sequence = CAPTURE_ORDER) -> DataFrame:
    """Photos of each project in groups of ``size`` in order of capture: group_index, place and is_survivor.

    A group of one is no choice: its photo goes on as a survivor.
    """
    rows = placed(photos, order, "project_id")
    totals = photos.groupBy("project_id").agg(F.count("*").alias("_n"))
    index = F.floor((F.col("place") - 1) / size)
    alone = (F.col("_n") % size == 1) & (F.col("place") == F.col("_n"))
    return rows.join(totals, "project_id").select("project_id", "id", "place", index.alias("group_index"), alone.alias("is_survivor"))


def confirm(rows: DataFrame) -> DataFrame:
    """Ratings after a choice: those ``chosen`` go up one, to the top at most; the others stay."""
    return rows.withColumn("rating", F.when(F.col("chosen"), clamped_rating(F.col("rating") + 1)).otherwise(F.col("rating")))


def confirm_photo(rating: Column, target: Column) -> Column:
    """The top rating; pressed again, the round's rating."""
    return F.when(rating >= MAX_RATING, target).otherwise(F.lit(MAX_RATING)).cast("int")


def settle(rating: Column, wanted: Column, target: Column) -> Column:
    """The wanted rating of a photo in a burst; pressed again, the round's rating."""
    return F.when(rating == wanted, target).otherwise(wanted).cast("int")


def review(rows: DataFrame) -> DataFrame:
    """Ratings after a look at a burst: ``kept`` ones go up one, the others down one, within range."""
    return rows.withColumn("rating", clamped_rating(F.when(F.col("kept"), F.col("rating") + 1).otherwise(F.col("rating") - 1)))


def collapse(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Candidates with each burst reduced to its first member: adds ``representative`` and ``n_members``.

    ``members`` (project_id, island, id) may hold photos that are no candidates; they don't count. Of a burst
    with one candidate left, that one stands for itself.
    """
    place = F.struct("captured_at", "relative_path", "id")
    rows = candidates.join(members.select("project_id", "island", "id"), ["project_id", "id"], "left")
    rows = rows.withColumn("island", F.coalesce("island", "id"))
    first = rows.groupBy("project_id", "island").agg(F.min_by("id", place).alias("representative"), F.count("*").alias("n_members"))
    return first.select("project_id", "representative", "n_members")


def spread(chosen: DataFrame, members: DataFrame, settled: DataFrame) -> DataFrame:
    """(project_id, id, rating): the photos of a burst that its chosen representative's rating goes to.

    The representative has it already and is not among them, and settled photos keep what they were given.
    """
    rows = chosen.select("project_id", F.col("id").alias("representative"), "rating").join(members, ["project_id", "representative"])
    others = rows.where(F.col("id") != F.col("representative"))
    return others.join(settled.select("project_id", "id"), ["project_id", "id"], "left_anti").select("project_id", "id", "rating")


def chosen_with_confirmed(selected: Column, group: Column, ratings: Column, top: int = MAX_RATING) -> Column:
    """Ids selected, then those of the group that have the top rating, each once and in order."""
    rating = lambda x: F.coalesce(F.try_element_at(ratings, x), F.lit(0))
    return F.array_distinct(F.concat(selected, F.filter(group, lambda x: rating(x) >= top)))


def replaced_representative(ids: Column, current: Column, new: Column) -> Column:
    """A list of ids with one representative in the place of another."""
    return F.transform(ids, lambda x: F.when(x == current, new).otherwise(x))


def without_last(ids: Column, item: Column) -> Column:
    """A list without the last occurrence of an item."""
    back = F.array_position(F.reverse(ids), item)
    at = F.size(ids) - back + 1
    return F.when(back == 0, ids).otherwise(F.concat(F.slice(ids, F.lit(1), (at - 1).cast("int")), F.slice(ids, (at + 1).cast("int"), F.size(ids))))


def next_candidates(survivors: Column) -> Column:
    """The candidates of the next round: survivors in order, each once."""
    return F.array_distinct(survivors)


def insert_upcoming(groups: Column, index: Column, added: Column, size: int | Column) -> Column:
    """struct<groups,survivors,added>: groups with new ids at the head of those still to come; the current one and earlier ones stay.

    Ids that a group holds already are not new, and without new ids all groups stay as they are. A group of one is
    no choice: its photo goes on as a survivor.
    """
    known = F.flatten(groups)
    new = F.filter(added, lambda x: ~F.array_contains(known, x))
    done, rest = F.slice(groups, F.lit(1), (index + 1).cast("int")), F.flatten(F.slice(groups, (index + 2).cast("int"), F.size(groups)))
    dealt = deal(F.concat(new, rest), size)
    none = F.size(new) == 0
    return F.struct(
        F.when(none, groups).otherwise(F.concat(done, dealt["groups"])).alias("groups"),
        F.when(none, F.array().cast("array<string>")).otherwise(dealt["survivors"]).alias("survivors"), new.alias("added"),
    )


def regroup(groups: Column, index: Column, size: int | Column) -> Column:
    """struct<groups,survivors>: the current group and those not yet begun dealt anew in ``size``; earlier ones stay.

    A group of one is no choice: its photo goes on as a survivor.
    """
    done = F.slice(groups, F.lit(1), index.cast("int"))
    dealt = deal(F.flatten(F.slice(groups, (index + 1).cast("int"), F.size(groups))), size)
    return F.struct(F.concat(done, dealt["groups"]).alias("groups"), dealt["survivors"].alias("survivors"))


def deal(ids: Column, size: int | Column) -> Column:
    """struct<groups,survivors>: a list dealt out in groups of ``size``, those of one as survivors."""
    dealt = chunks(ids, size)
    return F.struct(F.filter(dealt, lambda g: F.size(g) > 1).alias("groups"), F.flatten(F.filter(dealt, lambda g: F.size(g) == 1)).alias("survivors"))


def chunks(ids: Column, size: int | Column) -> Column:
    """A list cut into lists of ``size``."""
    size = size if isinstance(size, Column) else F.lit(size)
    n = F.ceil(F.size(ids) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(ids, (i * size + 1).cast("int"), size.cast("int")))


def progress(groups: DataFrame) -> DataFrame:
    """Groups and photos of a round still to judge, the current group's among them, and percent done (0 if none)."""
    left = F.col("group_index") >= F.col("current")
    return groups.groupBy("project_id").agg(
        F.count_if(left).alias("groups_left"),
        F.coalesce(F.sum(F.when(left, F.col("n_photos"))), F.lit(0)).alias("photos_left"),
        F.coalesce(F.round(100 * F.count_if(~left) / F.nullif(F.count("*"), F.lit(0))), F.lit(0)).cast("bigint").alias("percent"),
    )
