"""The catalogue of files: upserts from listings, projects, settings and sessions.

Every function takes a snapshot and gives the next one; write it under a new version and publish that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.scalars import clamp
from framesift.schema import SESSION

#: Columns that hold for the bytes of a file, and go when the file changes.
ANALYSIS = (
    "captured_at", "timestamp_source", "d_hash", "d_hash_version", "thumbnail_path", "thumbnail_mtime", "thumbnail_size", "thumbnail_source",
    "thumbnail_version", "display_path", "display_edge", "analysis_error", "analysis_error_at",
)


def stable_id(project: Column, path: Column) -> Column:
    """An id that a file always gets."""
    return F.substring(F.sha2(F.concat_ws("\0", project, path), 256), 1, 32)


def upsert(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """The next snapshot after a scan. ``listing``: project_id, path, relative_path, name, mtime, size.

    Files that are listed are not missing; files of a scanned project that aren't listed are. What was analysed
    stays where modification time and size are the same as before (two nulls are the same), else it is cleared;
    id and rating always stay. A path listed twice counts once. Projects that are not in the listing stay as
    they are. Running it again with the same listing changes nothing.
    """
    keys = ["project_id", "path"]
    files = listing.groupBy(*keys).agg(F.max(F.struct("relative_path", "name", "mtime", "size")).alias("f"), F.lit(True).alias("_seen"))
    scanned = listing.select("project_id").distinct().withColumn("_scanned", F.lit(True))
    rows = photos.withColumn("_known", F.lit(True)).join(files, keys, "full_outer").join(scanned, "project_id", "left")
    seen = F.coalesce("_seen", F.lit(False))
    same = F.col("_known").isNotNull() & F.col("fingerprint_mtime").eqNullSafe(F.col("f.mtime")) & F.col("fingerprint_size").eqNullSafe(F.col("f.size"))
    analysis = {c: F.when(~seen | same, F.col(c)) for c in ANALYSIS if c in photos.columns}
    new = {
        "id": F.coalesce("id", stable_id(F.col("project_id"), F.col("path"))),
        "relative_path": F.when(seen, F.col("f.relative_path")).otherwise(F.col("relative_path")),
        "name": F.when(seen, F.col("f.name")).otherwise(F.col("name")),
        "rating": F.coalesce("rating", F.lit(0)),
        "fingerprint_mtime": F.when(seen, F.col("f.mtime")).otherwise(F.col("fingerprint_mtime")),
        "fingerprint_size": F.when(seen, F.col("f.size")).otherwise(F.col("fingerprint_size")),
        "is_missing": F.when(seen, F.lit(False)).when(F.col("_scanned"), F.lit(True)).otherwise(F.col("is_missing")),
    }
    return rows.select(*((analysis | new).get(c, F.col(c)).alias(c) for c in photos.columns))


def backfill_fingerprints(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """``photos`` with absent modification times and sizes taken from a listing; what was analysed stays."""
    files = listing.groupBy("project_id", "path").agg(F.max(F.struct("mtime", "size")).alias("f"))
    both = F.col("fingerprint_mtime").isNull() & F.col("fingerprint_size").isNull()
    rows = photos.join(files, ["project_id", "path"], "left")
    fill = {"fingerprint_mtime": F.when(both, F.col("f.mtime")).otherwise(F.col("fingerprint_mtime")), "fingerprint_size": F.when(both, F.col("f.size")).otherwise(F.col("fingerprint_size"))}
    return rows.select(*(fill.get(c, F.col(c)).alias(c) for c in photos.columns))


def photo_counts(projects: DataFrame, photos: DataFrame) -> DataFrame:
    """``projects`` with the number of their photos that are not missing, and the status that follows."""
    counts = photos.groupBy("project_id").agg(F.count_if(~F.col("is_missing")).alias("_n")).withColumnRenamed("project_id", "id")
    rows = projects.join(counts, "id", "left")
    n = F.coalesce("_n", F.lit(0))
    return rows.withColumn("photo_count", n).withColumn("status", F.when(n > 0, "ready").otherwise("missing")).drop("_n")


def write_capture(photos: DataFrame, found: DataFrame) -> DataFrame:
    """``photos`` with capture times of ``found`` (project_id, id, at, source); without a source it is unknown."""
    new = found.select("project_id", "id", F.col("at").alias("_at"), F.coalesce("source", F.lit("unknown")).alias("_source"), F.lit(True).alias("_said"))
    rows = photos.join(new, ["project_id", "id"], "left")
    pick = {"captured_at": F.when(F.col("_said"), F.col("_at")).otherwise(F.col("captured_at")), "timestamp_source": F.coalesce("_source", "timestamp_source")}
    return rows.select(*(pick.get(c, F.col(c)).alias(c) for c in photos.columns))


def write_analysis(photos: DataFrame, done: DataFrame, hash_version: int = 2, thumbnail_version: int = 2) -> DataFrame:
    """``photos`` with hashes and thumbnails of ``done`` (project_id, id, hash, thumb_path, thumb_source, error, at).

    Versions come with a value only; a thumbnail's source stays where none is given; an error is cleared by
    success. Rows without news stay as they are.
    """
    news = done.select("project_id", "id", F.struct(*(c for c in done.columns if c not in ("project_id", "id"))).alias("_new"))
    rows = photos.join(news, ["project_id", "id"], "left")
    new, said = F.col("_new"), F.col("_new").isNotNull()
    changed = {
        "d_hash": new["hash"],
        "d_hash_version": F.when(new["hash"].isNotNull(), F.lit(hash_version)),
        "thumbnail_path": new["thumb_path"],
        "thumbnail_version": F.when(new["thumb_path"].isNotNull(), F.lit(thumbnail_version)),
        "thumbnail_mtime": F.when(new["thumb_path"].isNotNull(), F.col("fingerprint_mtime")),
        "thumbnail_size": F.when(new["thumb_path"].isNotNull(), F.col("fingerprint_size")),
        "thumbnail_source": F.coalesce(new["thumb_source"], F.col("thumbnail_source")),
        "analysis_error": new["error"],
        "analysis_error_at": F.when(new["error"].isNotNull(), new["at"]),
    }
    return rows.select(*((F.when(said, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in photos.columns))


def cache_state(hash_version: int = 2, thumbnail_version: int = 2) -> Column:
    """What a photo's stored analysis is good for: "hit", "rehash" (the thumbnail holds, its hash doesn't) or "regenerate"."""
    thumbnail = (
        F.col("fingerprint_mtime").isNotNull()
        & F.col("thumbnail_mtime").eqNullSafe(F.col("fingerprint_mtime"))
        & F.col("thumbnail_size").eqNullSafe(F.col("fingerprint_size"))
        & F.col("thumbnail_version").eqNullSafe(F.lit(thumbnail_version))
        & F.col("thumbnail_path").isNotNull()
    )
    hashed = F.col("d_hash_version").eqNullSafe(F.lit(hash_version)) & F.col("d_hash").isNotNull()
    return F.when(~thumbnail, "regenerate").when(hashed, "hit").otherwise("rehash")


def to_analyse(photos: DataFrame, hash_version: int = 2, thumbnail_version: int = 2) -> DataFrame:
    """Visible photos whose stored analysis can't be used again: file changed since, other version, or none."""
    return photos.where(~F.col("is_missing") & (cache_state(hash_version, thumbnail_version) != "hit"))


def reset_display(photos: DataFrame, project: str) -> DataFrame:
    """``photos`` with the display images of one project forgotten."""
    here = F.col("project_id") == project
    return photos.withColumn("display_path", F.when(~here, F.col("display_path"))).withColumn("display_edge", F.when(~here, F.col("display_edge")))


def latest(rows: DataFrame, *keys: str, at: str = "updated_at") -> DataFrame:
    """The last row of each key, by time and then by content; a later row replaces an earlier one."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(at, *(c for c in rest if c != at))).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert_rows(rows: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with those of ``new`` in place of the ones with the same keys."""
    return rows.join(new.select(*keys), list(keys), "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def without_project(rows: DataFrame, project: str, column: str = "project_id") -> DataFrame:
    """Any table of the catalogue without one project; its pair decisions and sessions go the same way."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(project)))


def delete_project(projects: DataFrame, project: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """``projects`` without one, and each of ``tables`` (by project_id) without its rows; raises if there is no such project."""
    if projects.where(F.col("id") == project).isEmpty():
        raise ValueError(f"there is no project {project}")
    return without_project(projects, project, "id"), *(without_project(t, project) for t in tables)


def list_projects(projects: DataFrame) -> DataFrame:
    """Projects, the last updated first."""
    return projects.orderBy(F.desc("updated_at"), "id")


def encode_session(rows: DataFrame) -> DataFrame:
    """(project_id, state_json, updated_at) of session rows (project_id, session, updated_at)."""
    return rows.select("project_id", F.to_json("session").alias("state_json"), "updated_at")


def parsed_names(ddl: str) -> list[str]:
    """The top-level names of a schema in text form."""
    names, depth = [], 0
    for part in ddl.split(","):
        if depth == 0:
            names.append(part.split()[0])
        depth += part.count("<") - part.count(">")
    return names


def decode_session(states: DataFrame) -> DataFrame:
    """Sessions from their text. Fields that older texts lack get defaults; text that is no object gives null."""
    parsed = F.from_json("state_json", SESSION)
    empty = {"candidates": "array<string>", "groups": "array<array<string>>", "selectedInGroup": "array<string>", "survivors": "array<string>", "burstSettled": "array<string>"}
    s = lambda c: F.col("_s").getField(c)
    maps = {"ratings": "map<string,int>", "burstMembers": "map<string,array<string>>"}
    values = {c: F.coalesce(s(c), F.array().cast(kind)) for c, kind in empty.items()}
    values |= {c: F.coalesce(s(c), F.create_map().cast(kind)) for c, kind in maps.items()}
    values |= {"groupIndex": F.coalesce(s("groupIndex"), F.lit(0)), "multiSelect": F.coalesce(s("multiSelect"), F.lit(False)), "round": F.coalesce(s("round"), F.lit(1)), "targetRating": clamp(F.coalesce(s("targetRating"), F.lit(0)), 0, 5), "stage": F.coalesce(s("stage"), F.lit("settings"))}
    names = parsed_names(SESSION)
    fields = [values.get(n, s(n)).alias(n) for n in names]
    rows = states.withColumn("_s", F.when(F.get_json_object("state_json", "$").startswith("{"), parsed))
    return rows.select("project_id", F.when(F.col("_s").isNotNull(), F.struct(*fields)).alias("session"), "updated_at")


def shares(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``share``: percent of each value in the sum over its group, or over all rows."""
    totals = rows.groupBy(*by).agg(F.sum(value).alias("_total"))
    joined = rows.join(totals, list(by)) if by else rows.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumn("share", 100.0 * F.col(value) / F.nullif(F.col("_total"), F.lit(0))).drop("_total")


def speed_up(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """``speed_up``: the first row's value over each one's, in its group."""
    first = rows.groupBy(*by).agg(F.min_by(value, order).alias("_first"))
    return rows.join(first, list(by)).withColumn("speed_up", F.col("_first") / F.nullif(F.col(value), F.lit(0))).drop("_first")
