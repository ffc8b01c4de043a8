"""Photos in order of capture: neighbours, pairs, candidates, bursts and neighbourhoods.

A project can hold any number of photos, and so can a millisecond, so no window runs over a whole project or time. Rows
are windowed within stretches of time, cut further by ranges of rows where they are crowded, and what passes from one
stretch to the next (its last row, its last break) comes from a summary with one row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.hashing import distance
from framesift.functions.scalars import is_weak, pair_key
from framesift.schema import CANDIDATE_LIMIT, CANDIDATE_SHARE, DEFAULT_THRESHOLD, HASH_BITS, WINDOW_FLOOR_MS, WINDOW_MS
from framesift.storage import saved

#: Length of a stretch. Any length gives the same result.
STRETCH_MS = 3_600_000
#: Photos of a stretch of time that are one task; of more, ranges of rows are. Any number gives the same result.
STRETCH_ROWS = 1 << 20
STRETCH = ("stretch", "sub")
ORDER = ("captured_at", "relative_path", "id")


def usable(photos: DataFrame) -> DataFrame:
    """Photos that can be in a burst: not missing, with a time and a hash."""
    return photos.where(~F.col("is_missing") & F.col("captured_at").isNotNull() & F.col("d_hash").isNotNull())


def timed(photos: DataFrame) -> DataFrame:
    """Photos that are not missing and have a time."""
    return photos.where(~F.col("is_missing") & F.col("captured_at").isNotNull())


def _stretched(photos: DataFrame, stretch_ms: int, most: int) -> DataFrame:
    """``photos`` with ``stretch`` and ``sub``: a stretch of time, and a range of its rows where it has more than ``most``.

    Times may be equal by the million, so time alone bounds nothing. Rows of crowded stretches are dealt out by
    ranges of their order, drawn from a sample, and written, as another run may draw others.
    """
    if "sub" in photos.columns:
        return photos
    rows = photos.withColumn("stretch", F.floor(F.col("captured_at") / stretch_ms))
    crowded = rows.groupBy("project_id", "stretch").agg(F.count("*").alias("n")).where(F.col("n") > most)
    total = crowded.agg(F.sum("n")).first()[0]
    if not total:
        return rows.withColumn("sub", F.lit(0))
    crowded = F.broadcast(saved(crowded.select("project_id", "stretch")))  # a row for ``most`` photos, at most
    calm = rows.join(crowded, ["project_id", "stretch"], "left_anti").withColumn("sub", F.lit(0))
    dealt = rows.join(crowded, ["project_id", "stretch"]).repartitionByRange(-(-total // most), "project_id", *ORDER).withColumn("sub", F.spark_partition_id())
    return calm.unionByName(saved(dealt))


def with_neighbours(photos: DataFrame, stretch_ms: int = STRETCH_MS, sides: tuple[str, ...] = ("previous", "following"), most: int = STRETCH_ROWS) -> DataFrame:
    """``photos`` with ``previous`` and ``following``: the structs of the photos beside each in its project; null at the ends.

    Ties in time are ordered by path, then id. Rows need a time. The stretch of each photo stays with it, as ``stretch`` and ``sub``.
    """
    here = F.struct(*ORDER, "d_hash", "timestamp_source")
    rows = _stretched(photos, stretch_ms, most)
    within, across = Window.partitionBy("project_id", *STRETCH).orderBy(*ORDER), Window.partitionBy("project_id").orderBy(*STRETCH)
    ends = {"previous": (F.lag, F.max_by), "following": (F.lead, F.min_by)}
    inside = rows.select("*", *(ends[s][0](here).over(within).alias(f"in_{s}") for s in sides))
    edges = rows.groupBy("project_id", *STRETCH).agg(*(ends[s][1](here, F.struct(*ORDER)).alias(f"edge_{s}") for s in sides))
    beside = edges.select("project_id", *STRETCH, *(ends[s][0](f"edge_{s}").over(across).alias(f"out_{s}") for s in sides))
    joined = inside.join(beside, ["project_id", *STRETCH], "left")
    return joined.select(*photos.columns, *STRETCH, *(F.coalesce(f"in_{s}", f"out_{s}").alias(s) for s in sides))


def with_previous(photos: DataFrame, stretch_ms: int = STRETCH_MS, most: int = STRETCH_ROWS) -> DataFrame:
    """``photos`` with ``previous`` only."""
    return with_neighbours(photos, stretch_ms, ("previous",), most)


def eligibility(left_at: Column, right_at: Column, left_source: Column, right_source: Column, window_ms: Column | int = WINDOW_MS) -> Column:
    """eligible, out_of_window or weak_evidence (both times weak), in that order of precedence."""
    gap = right_at - left_at
    window = window_ms if isinstance(window_ms, Column) else F.lit(window_ms)
    return F.when((gap < 0) | (gap > window), "out_of_window").when(is_weak(left_source) & is_weak(right_source), "weak_evidence").otherwise("eligible")


def joins_by_threshold(gap_ms: Column, bits: Column, threshold: Column) -> Column:
    """Whether two neighbours belong together by time and likeness alone."""
    return (gap_ms <= WINDOW_MS) & (bits <= threshold)


def adjacent(photos: DataFrame, stretch_ms: int = STRETCH_MS, most: int = STRETCH_ROWS) -> DataFrame:
    """Usable photos with ``previous``, the gap to it and the distance from it."""
    rows = with_previous(usable(photos), stretch_ms, most)
    return rows.withColumn("gap_ms", F.col("captured_at") - F.col("previous.captured_at")).withColumn(
        "distance", F.when(F.col("previous").isNotNull(), distance(F.col("previous.d_hash"), F.col("d_hash")))
    )


def burst_pairs(photos: DataFrame) -> DataFrame:
    """Neighbours close in time that are not both weakly dated, however different: id, both ids, distance, gap_ms."""
    rows = adjacent(photos).where(F.col("previous").isNotNull())
    fine = eligibility(F.col("previous.captured_at"), F.col("captured_at"), F.col("previous.timestamp_source"), F.col("timestamp_source")) == "eligible"
    left = F.col("previous.id")
    return rows.where(fine).select("project_id", pair_key(left, F.col("id")).alias("id"), left.alias("left_id"), F.col("id").alias("right_id"), "distance", "gap_ms")


def _islands(rows: DataFrame, threshold: Column, overrides: DataFrame | None, stretch_ms: int) -> DataFrame:
    """Adjacent photos with ``island``: the struct of the first photo of each one's run."""
    raw = joins_by_threshold(F.col("gap_ms"), F.col("distance"), threshold)
    if overrides is not None:
        said = overrides.select("project_id", F.col("left_id").alias("o_left"), F.col("right_id").alias("id"), F.col("joined").alias("said"))
        rows = rows.withColumn("o_left", F.col("previous.id")).join(said, ["project_id", "o_left", "id"], "left")
        raw = F.coalesce("said", raw)
    rows = _stretched(rows, stretch_ms, STRETCH_ROWS).withColumn("starts", F.col("previous").isNull() | ~raw)
    first = F.when(F.col("starts"), F.struct(*ORDER, "d_hash"))
    inside = Window.partitionBy("project_id", *STRETCH).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.last(first, ignorenulls=True).over(inside))
    lasts = rows.groupBy("project_id", *STRETCH).agg(F.max(first).alias("last"))
    earlier = Window.partitionBy("project_id").orderBy(*STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select("project_id", *STRETCH, F.last("last", ignorenulls=True).over(earlier).alias("outside"))
    joined = rows.join(before, ["project_id", *STRETCH], "left")
    return joined.withColumn("island", F.coalesce("inside", "outside")).drop("inside", "outside", *STRETCH)


def burst_members(photos: DataFrame, threshold: Column | int = DEFAULT_THRESHOLD, overrides: DataFrame | None = None, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """project_id, island, id, captured_at, relative_path of every usable photo; a row each, whatever a run's length.

    ``photos`` may be ``adjacent`` ones, written once for several uses.
    """
    level = threshold if isinstance(threshold, Column) else F.lit(threshold)
    rows = _islands(photos if "previous" in photos.columns else adjacent(photos, stretch_ms), level, overrides, stretch_ms)
    return rows.select("project_id", F.col("island.id").alias("island"), "id", "captured_at", "relative_path", "d_hash", F.col("island.d_hash").alias("first_hash"), "rating")


def burst_groups(photos: DataFrame, threshold: Column | int = DEFAULT_THRESHOLD, overrides: DataFrame | None = None, stretch_ms: int = STRETCH_MS) -> DataFrame:
    """Runs of two photos or more: id (first:last), members in order, span, and likeness of the rest to the first.

    ``overrides`` (project_id, left_id, right_id, joined) decide for their directed pair of neighbours, whatever
    its gap or distance. A run's ids are one list; for runs beyond a task's memory there is ``burst_members``.
    """
    members = burst_members(photos, threshold, overrides, stretch_ms)
    place = F.struct("captured_at", "relative_path", "id")
    grouped = members.groupBy("project_id", "island").agg(
        F.count("*").alias("n"),
        (F.max("captured_at") - F.min("captured_at")).alias("span_ms"),
        F.sum(distance(F.col("first_hash"), F.col("d_hash"))).alias("bits"),
        F.transform(F.sort_array(F.collect_list(place)), lambda x: x["id"]).alias("photo_ids"),
    )
    mean = F.col("bits") / F.nullif(F.col("n") - 1, F.lit(0))
    likeness = F.round(F.greatest(F.lit(0.0), 1 - mean / HASH_BITS) * 100).cast("bigint")
    name = pair_key(F.element_at("photo_ids", 1), F.element_at("photo_ids", -1))
    return grouped.where("n > 1").select("project_id", name.alias("id"), "photo_ids", F.col("n").alias("n_photos"), "span_ms", likeness.alias("similarity"))


def _windows() -> list[int]:
    out = [WINDOW_MS]
    while out[-1] // 2 >= WINDOW_FLOOR_MS:
        out.append(out[-1] // 2)
    return out


def sided(photos: DataFrame) -> DataFrame:
    """Timed photos with the smaller of their gaps to an eligible neighbour on either side; null if none."""
    both = with_neighbours(timed(photos))

    def gap(near: Column, sign: int) -> Column:
        weak = is_weak(F.col("timestamp_source")) & is_weak(near["timestamp_source"])
        return F.when(near.isNotNull() & ~weak, sign * (F.col("captured_at") - near["captured_at"]))

    back = F.col("captured_at") - F.col("previous.captured_at")
    weak = is_weak(F.col("timestamp_source")) & is_weak(F.col("previous.timestamp_source"))
    near = F.least(gap(F.col("previous"), 1), gap(F.col("following"), -1))
    return both.select("project_id", "id", "captured_at", near.alias("near_ms"), F.when(weak, back).alias("weak_ms"))


def candidate_window(photos: DataFrame) -> DataFrame:
    """For each project: the window, its candidates, their share of timed photos, and weakly dated pairs in it.

    The window is halved while more than 2000 candidates are more than 80 % of the photos, down to a floor. The
    counts for every window come from one pass. ``photos`` may be ``sided`` ones.
    """
    windows = _windows()
    counts = [F.count_if(F.col(c) <= w).alias(f"{c}_{w}") for c in ("near_ms", "weak_ms") for w in windows]
    rows = (photos if "near_ms" in photos.columns else sided(photos)).groupBy("project_id").agg(F.count("*").alias("n"), *counts)
    many = lambda n: (n > CANDIDATE_LIMIT) & (n / F.col("n") > CANDIDATE_SHARE)
    chosen = F.lit(windows[-1])
    for w in reversed(windows[:-1]):
        chosen = F.when(~many(F.col(f"near_ms_{w}")), F.lit(w)).otherwise(chosen)
    picked = rows.withColumn("window_ms", chosen)
    of = lambda c: F.coalesce(*(F.when(F.col("window_ms") == w, F.col(f"{c}_{w}")) for w in windows))
    return picked.select("project_id", "window_ms", of("near_ms").alias("n_candidates"), (of("near_ms") / F.col("n")).alias("share"), of("weak_ms").alias("weak_pairs"))


def burst_candidates(photos: DataFrame) -> DataFrame:
    """Photos worth hashing: both ends of every eligible pair within the project's window."""
    rows = saved(sided(photos))
    windows = candidate_window(rows).select("project_id", "window_ms")
    return rows.join(windows, "project_id").where(F.col("near_ms") <= F.col("window_ms")).select("project_id", "id", "captured_at", "window_ms")


def neighbourhood(photos: DataFrame, ids: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Usable photos taken from ``window_ms`` before the first of ``ids`` (project_id, id) to as long after the last."""
    rows = usable(photos)
    wanted = rows.join(ids.select("project_id", "id").distinct(), ["project_id", "id"], "left_semi")
    span = wanted.groupBy("project_id").agg(F.min("captured_at").alias("low"), F.max("captured_at").alias("high"))
    near = rows.join(span, "project_id").where(F.col("captured_at").between(F.col("low") - window_ms, F.col("high") + window_ms))
    return near.drop("low", "high")


def decision_flips(photos: DataFrame, other: str, threshold: int = DEFAULT_THRESHOLD, margin: int = 4) -> DataFrame:
    """How often a second hash column decides otherwise than d_hash for neighbours: one row."""
    first = adjacent(photos).where(F.col("previous").isNotNull()).select("project_id", "id", "distance")
    second = adjacent(photos.withColumn("d_hash", F.col(other))).where(F.col("previous").isNotNull()).select("project_id", "id", F.col("distance").alias("other"))
    both = first.join(second, ["project_id", "id"])
    change = F.abs(F.col("distance") - F.col("other"))
    return both.agg(
        F.count("*").alias("pairs"),
        F.count_if((F.col("distance") <= threshold) != (F.col("other") <= threshold)).alias("flips"),
        F.coalesce(F.sum(change) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias("mean_change"),
        F.coalesce(F.max(change), F.lit(0)).alias("max_change"),
        F.count_if(F.abs(F.col("distance") - threshold) <= margin).alias("near_threshold"),
    )
