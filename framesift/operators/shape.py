"""Cuts and blocks of a run of photos, and the pair decisions that a wanted shape needs.

A run is a set of rows (project_id, run, pos, id), pos from 0; a cut stands before a row. A run can be as long as a
project, so windows take a stretch of it at a time, and what passes from one stretch to the next comes from a summary
with a row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators import sequence

_RUN = ("project_id", "run")


#: Rows of a run in one window. Any number gives the same result.
STRETCH = 4096


def _with_previous(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """``rows`` with ``previous``: a struct with the ``value`` of the row before by pos, null for the first."""
    here = rows.withColumn("_value", F.struct(value.alias("value"))).withColumn("_stretch", F.floor(F.col("pos") / STRETCH))
    inside = here.withColumn("_inside", F.lag("_value").over(Window.partitionBy(*by, "_stretch").orderBy("pos")))
    edges = here.groupBy(*by, "_stretch").agg(F.max_by("_value", "pos").alias("_edge"))
    before = edges.select(*by, "_stretch", F.lag("_edge").over(Window.partitionBy(*by).orderBy("_stretch")).alias("_outside"))
    joined = inside.join(before, [*by, "_stretch"], "left")
    return joined.withColumn("previous", F.coalesce("_inside", "_outside")).drop("_value", "_stretch", "_inside", "_outside")


def cuts_from_groups(run: DataFrame, groups: DataFrame) -> DataFrame:
    """``run`` with ``cut``: true where two neighbours are not in one group of ``groups`` (project_id, id, group)."""
    rows = _with_previous(run.join(groups.select("project_id", "id", "group"), ["project_id", "id"], "left"), F.col("group"), *_RUN)
    same = F.coalesce(F.col("group") == F.col("previous.value"), F.lit(False))
    return rows.withColumn("cut", (F.col("pos") > 0) & ~same).drop("group", "previous")


def blocks(cuts: DataFrame) -> DataFrame:
    """``block`` from 0 for each row, with ``n``, the size of its block."""
    rows = cuts.withColumn("_starts", F.when((F.col("pos") > 0) & F.col("cut"), 1).otherwise(0)).withColumn("_stretch", F.floor(F.col("pos") / STRETCH))
    inside = rows.withColumn("_inside", F.sum("_starts").over(Window.partitionBy(*_RUN, "_stretch").orderBy("pos")))
    sums = rows.groupBy(*_RUN, "_stretch").agg(F.sum("_starts").alias("_sum"))
    earlier = Window.partitionBy(*_RUN).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*_RUN, "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    numbered = inside.join(before, [*_RUN, "_stretch"]).withColumn("block", F.col("_inside") + F.col("_before")).drop("_starts", "_stretch", "_inside", "_before")
    return numbered.join(numbered.groupBy(*_RUN, "block").agg(F.count("*").alias("n")), [*_RUN, "block"])


def cut_around(cuts: DataFrame, selected: DataFrame) -> DataFrame:
    """Cuts with one more at each edge of the selection; cuts within it stay, an empty or whole selection adds none."""
    marks = selected.select("project_id", "id").distinct().withColumn("_s", F.lit(True))
    rows = cuts.join(marks, ["project_id", "id"], "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    edge = F.coalesce(F.col("_s") != F.col("previous.value"), F.lit(False))
    return _with_previous(rows, F.col("_s"), *_RUN).withColumn("cut", F.col("cut") | edge).drop("_s", "previous")


def join_at(cuts: DataFrame, pos: int) -> DataFrame:
    """Cuts without the one before row ``pos``."""
    return cuts.withColumn("cut", F.col("cut") & (F.col("pos") != pos))


def cut_all(cuts: DataFrame) -> DataFrame:
    """A cut before every row but the first."""
    return cuts.withColumn("cut", F.col("pos") > 0)


def boundaries(cuts: DataFrame) -> DataFrame:
    """Cuts in each run."""
    return cuts.groupBy(*_RUN).agg(F.count_if((F.col("pos") > 0) & F.col("cut")).alias("n_cuts"))


def representatives(blocked: DataFrame, nominated: DataFrame, original: DataFrame) -> DataFrame:
    """For each block: its nominated member, else its first, and whether no member was in the burst before."""
    marks = nominated.select("project_id", "id").distinct().withColumn("_nominated", F.lit(True))
    old = original.select("project_id", "id").distinct().withColumn("_old", F.lit(True))
    rows = blocked.join(marks, ["project_id", "id"], "left").join(old, ["project_id", "id"], "left")
    chosen = F.min_by(F.when(F.col("_nominated"), F.col("id")), F.when(F.col("_nominated"), F.col("pos")))
    return rows.groupBy(*_RUN, "block").agg(F.coalesce(chosen, F.min_by("id", "pos")).alias("representative"), (F.count("_old") == 0).alias("is_outside"))


def exceptions(photos: DataFrame, wanted: DataFrame, threshold: Column | int) -> DataFrame:
    """The decisions that make a wanted shape: (project_id, left_id, right_id, joined).

    ``wanted`` (project_id, pos, id, block) lists photos in order; neighbours in it are wanted together if they
    have the same block. Only pairs for which time and likeness would decide otherwise are returned, so saving
    the same shape twice leaves the same rows.
    """
    level = threshold if isinstance(threshold, Column) else F.lit(threshold)
    facts = sequence.usable(photos).select("project_id", "id", "captured_at", "d_hash")
    rows = _with_previous(wanted.join(facts, ["project_id", "id"]), F.struct("id", "captured_at", "d_hash", "block"), "project_id")
    pairs = rows.where(F.col("previous").isNotNull()).withColumn("p", F.col("previous.value"))
    raw = sequence.joins_by_threshold(F.col("captured_at") - F.col("p.captured_at"), sequence.distance(F.col("p.d_hash"), F.col("d_hash")), level)
    joined = F.coalesce(F.col("block") == F.col("p.block"), F.lit(False))
    return pairs.where(joined != raw).select("project_id", F.col("p.id").alias("left_id"), F.col("id").alias("right_id"), joined.alias("joined"))


def save_shape(overrides: DataFrame, photos: DataFrame, wanted: DataFrame, threshold: Column | int) -> DataFrame:
    """``overrides`` after a shape is saved: old ones of its pairs go, its exceptions come."""
    pairs = _with_previous(wanted, F.col("id"), "project_id").where(F.col("previous").isNotNull())
    touched = pairs.select("project_id", F.col("previous.value").alias("left_id"), F.col("id").alias("right_id"))
    kept = overrides.join(touched, ["project_id", "left_id", "right_id"], "left_anti").select("project_id", "left_id", "right_id", "joined")
    return kept.unionByName(exceptions(photos, wanted, threshold))
