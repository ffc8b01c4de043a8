"""Selection sessions: how they start, and what a corrected burst does to what is still to be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.hashing import distance
from framesift.operators import sequence, shape
from framesift.operators.pages import visible
from framesift.schema import HASH_BITS
from framesift.storage import is_folder


def pair_facts(pairs: DataFrame) -> DataFrame:
    """For each project the number of its pairs and their largest distance."""
    return pairs.groupBy("project_id").agg(F.count("*").alias("n_pairs"), F.max("distance").alias("largest"))


def start(photos: DataFrame, pairs: DataFrame, projects: DataFrame, group_bursts: bool, rating: int | None = None) -> DataFrame:
    """A row for each project (id, burst_threshold): what a session starts with, and at which stage.

    Without pairs, or if bursts are not to be grouped, the round begins at once; with a learned threshold its
    bursts are shown first; else the threshold is to be learned. ``can_start`` needs two photos or more.
    """
    seeds = visible(photos, rating=rating).groupBy("project_id").agg(F.count("*").alias("n_candidates"))
    facts = projects.select(F.col("id").alias("project_id"), "burst_threshold").join(seeds, "project_id", "left").join(pair_facts(pairs), "project_id", "left")
    n, n_pairs = F.coalesce("n_candidates", F.lit(0)), F.coalesce("n_pairs", F.lit(0))
    bursts = F.lit(group_bursts) & (n_pairs > 0)
    stage = F.when(~bursts, "tournament").when(F.col("burst_threshold").isNull(), "burst-threshold").otherwise("burst-preview")
    return facts.select(
        "project_id", n.alias("n_candidates"), n_pairs.alias("n_pairs"), F.coalesce("largest", F.lit(HASH_BITS)).alias("largest_distance"),
        F.when(bursts, F.col("burst_threshold")).alias("burst_threshold"), stage.alias("stage"), (n >= 2).alias("can_start"),
    )


def grouped_photos(groups: DataFrame) -> DataFrame:
    """Photos in bursts, for each project."""
    return groups.groupBy("project_id").agg(F.sum("n_photos").alias("n_photos"), F.count("*").alias("n_groups"))


def open_burst(photos: DataFrame, members: DataFrame) -> DataFrame:
    """The run to correct a burst in: usable photos around ``members`` (project_id, id), in order, with cuts.

    ``members`` with an ``island`` column; cuts stand where two neighbours are not in one burst. Rows have
    project_id, run (the project's own), pos, id and cut. Runs are as long as the time they cover.
    """
    from framesift.operators.curation import placed

    near = sequence.neighbourhood(photos, members).select("project_id", "id", *(c for c in sequence.ORDER if c != "id"))
    rows = placed(near, [(F.asc, c) for c in sequence.ORDER], "project_id")
    run = rows.select("project_id", F.lit(0).alias("run"), (F.col("place") - 1).alias("pos"), "id")
    return shape.cuts_from_groups(run, members.select("project_id", "id", F.col("island").alias("group")))


def collapsed(order: DataFrame, blocks: DataFrame) -> DataFrame:
    """``order`` (project_id, pos, id) with each block's members as its representative, at the place of the first.

    ``blocks`` has (project_id, id, representative) for members of blocks of two or more.
    """
    rows = order.join(blocks.select("project_id", "id", "representative"), ["project_id", "id"], "left")
    shown = rows.withColumn("shown", F.coalesce("representative", "id"))
    return shown.groupBy("project_id", "shown").agg(F.min("pos").alias("pos")).select("project_id", "pos", F.col("shown").alias("id"))


def collapsed_list(ids: Column, members: Column, representative: Column) -> Column:
    """The same for one list and one block."""
    shown = F.transform(ids, lambda x: F.when(F.array_contains(members, x), representative).otherwise(x))
    return F.filter(shown, lambda x, i: (x != representative) | (F.array_position(shown, x) == i + 1))


def released(blocked: DataFrame, original: DataFrame) -> DataFrame:
    """Members of the old burst that stand alone now, and so have to be shown again: (project_id, pos, id)."""
    return blocked.where("n = 1").join(original.select("project_id", "id"), ["project_id", "id"], "left_semi").select("project_id", "pos", "id")


def upcoming(order: DataFrame, current: DataFrame, added: DataFrame) -> DataFrame:
    """``order`` (project_id, pos, id) after new ids come in behind the place ``last`` of ``current`` (project_id, last).

    Ids that are listed already are not added again; those that are keep the order of ``added`` (project_id, pos, id).
    """
    new = added.join(order.select("project_id", "id"), ["project_id", "id"], "left_anti")
    n = new.groupBy("project_id").agg(F.count("*").alias("_n"), F.min("pos").alias("_low"))
    from framesift.operators.curation import placed

    ranked = placed(new, [(F.asc, "pos"), (F.asc, "id")], "project_id").join(current, "project_id").select("project_id", (F.col("last") + F.col("place")).alias("pos"), "id")
    moved = order.join(current, "project_id").join(n, "project_id", "left")
    pos = F.when(F.col("pos") > F.col("last"), F.col("pos") + F.coalesce("_n", F.lit(0))).otherwise(F.col("pos"))
    return moved.select("project_id", pos.alias("pos"), "id").unionByName(ranked)


def create_project(projects: DataFrame, project_id: str, name: str, folder: str, at: int) -> DataFrame:
    """``projects`` with a new one; raises if the id is taken, or if there is no such folder on its file system."""
    if not is_folder(projects.sparkSession, folder):
        raise ValueError(f"there is no folder {folder}")
    if not projects.where(F.col("id") == project_id).isEmpty():
        raise ValueError(f"there is a project {project_id}")
    known = {"id": F.lit(project_id), "name": F.lit(name), "folder_path": F.lit(folder), "photo_count": F.lit(0), "status": F.lit("new"), "created_at": F.lit(at), "updated_at": F.lit(at)}
    kinds = dict(projects.dtypes)
    row = projects.sparkSession.range(1).select(*(known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in projects.columns))
    return projects.unionByName(row)


def counts(sessions: DataFrame) -> DataFrame:
    """Survivors, answers and rated photos of each session (project_id, session)."""
    n = lambda c: F.size(F.col(f"session.{c}")).cast("bigint")
    return sessions.select("project_id", n("survivors").alias("n_survivors"), F.coalesce(F.greatest(n("history"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_answers"), n("ratings").alias("n_rated"))


def share_within(rows: DataFrame, left: str, right: str, most: int, *by: str) -> DataFrame:
    """Of each group the share of rows whose two hashes are ``most`` bits apart or fewer."""
    near = (distance(F.col(left), F.col(right)) <= most).cast("int")
    return rows.groupBy(*by).agg(F.avg(near).alias("share"))
