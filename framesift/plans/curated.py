"""Registered queries: curation, catalogue, thresholds, shapes, times and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import capture, hashing, scalars
from framesift.operators import catalogue, curation, export, pages, sequence, session, shape, threshold
from framesift.plans import views
from framesift.plans.queries import query
from framesift.plans.views import LARGEST, OVERRIDES, PHOTOS, USABLE, groups_sql

_CAPTURE = "captured_at NULLS LAST, relative_path, id"


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.photos(spark, sf_dir)


def _number() -> Column:
    return F.col("id").cast("bigint")


@query(f"WITH {PHOTOS} SELECT id, 4 AS rating FROM photos WHERE project_id = 'click' AND NOT is_missing AND rating = 2 AND CAST(id AS BIGINT) % 5 = 0")
def move_rating_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir)
    return curation.move_rating(photos, "click", 2, 4, include=photos.where(_number() % 5 == 0).select("id"))


@query(f"WITH {PHOTOS} SELECT id, 0 AS rating FROM photos WHERE project_id = 'click' AND NOT is_missing AND rating = 3 AND CAST(id AS BIGINT) % 5 <> 0")
def move_rating_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir)
    return curation.move_rating(photos, "click", 3, 0, exclude=photos.where(_number() % 5 == 0).select("id"))


@query(f"WITH {PHOTOS} SELECT project_id, id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CAST(greatest(0, least(5, CAST(id AS BIGINT) % 11 - 3)) AS INTEGER) ELSE rating END AS rating FROM photos")
def save_results_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir)
    results = photos.where(_number() % 3 == 0).select("project_id", "id", (_number() % 11 - 3).alias("rating"))
    return curation.save_results(photos, results).select("project_id", "id", "rating")


@query(f"WITH {PHOTOS} SELECT project_id, id, 0 AS rating, captured_at, d_hash FROM photos")
def reset_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.reset_results(_photos(spark, sf_dir)).select("project_id", "id", "rating", "captured_at", "d_hash")


_ROUNDS = f"""{PHOTOS}, seeds AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_CAPTURE}) AS place, count(*) OVER (PARTITION BY project_id) AS n FROM photos WHERE NOT is_missing AND rating = 2)"""


@query(f"WITH {_ROUNDS} SELECT project_id, id, place, (place - 1) // 4 AS group_index, n % 4 = 1 AND place = n AS is_survivor FROM seeds")
def round_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.rounds(pages.visible(_photos(spark, sf_dir), rating=2), 4)


@query(f"WITH {_ROUNDS} SELECT project_id, id FROM seeds WHERE n % 2 = 1 AND place = n")
def round_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = curation.rounds(pages.visible(_photos(spark, sf_dir), rating=2), 2)
    return rounds.where("is_survivor").select("project_id", "id")


@query(f"""WITH {_ROUNDS}, parts AS (SELECT project_id, (place - 1) // 4 AS g, count(*) AS n FROM seeds GROUP BY ALL)
SELECT project_id, count(*) FILTER (g >= 2) AS groups_left, CAST(coalesce(sum(n) FILTER (g >= 2), 0) AS BIGINT) AS photos_left, CAST(round(100 * count(*) FILTER (g < 2) / count(*)) AS BIGINT) AS percent FROM parts GROUP BY project_id""")
def round_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = curation.rounds(pages.visible(_photos(spark, sf_dir), rating=2), 4)
    groups = rounds.groupBy("project_id", "group_index").agg(F.count("*").alias("n_photos")).withColumn("current", F.lit(2))
    return curation.progress(groups)


@query(f"""WITH {groups_sql(24)}, part AS (SELECT * FROM members WHERE rating <> 1)
SELECT project_id, arg_min(id, (captured_at, relative_path, id)) AS representative, count(*) AS n_members FROM part GROUP BY project_id, island""")
def collapse_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, near = _photos(spark, sf_dir), views.adjacent(spark, sf_dir)
    members = sequence.burst_members(near, 24, views.overrides(near))
    candidates = sequence.usable(photos).where("rating <> 1").select("project_id", "id", "captured_at", "relative_path")
    return curation.collapse(candidates, members)


@query(f"""WITH {groups_sql(24)}
SELECT m.project_id, m.id, CAST(r.rating AS INTEGER) AS rating FROM members m JOIN members r ON r.id = m.island WHERE m.id <> m.island AND r.rating >= 3 AND CAST(m.id AS BIGINT) % 5 <> 0""")
def spread_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, near = _photos(spark, sf_dir), views.adjacent(spark, sf_dir)
    members = sequence.burst_members(near, 24, views.overrides(near)).select("project_id", F.col("island").alias("representative"), "id")
    chosen = sequence.usable(photos).where("rating >= 3")
    return curation.spread(chosen, members, photos.where(_number() % 5 == 0))


@query(f"WITH {PHOTOS} SELECT project_id, id, CAST(CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN least(5, rating + 1) ELSE greatest(0, rating - 1) END AS INTEGER) AS rating FROM photos WHERE NOT is_missing")
def review_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.visible(_photos(spark, sf_dir)).withColumn("kept", _number() % 4 == 0)
    return curation.review(rows).select("project_id", "id", "rating")


@query(f"WITH {PHOTOS} SELECT project_id, id, CAST(CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN least(5, rating + 1) ELSE rating END AS INTEGER) AS rating FROM photos WHERE NOT is_missing")
def confirm_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.visible(_photos(spark, sf_dir)).withColumn("chosen", _number() % 4 == 0)
    return curation.confirm(rows).select("project_id", "id", "rating")


@query(f"""WITH {PHOTOS} SELECT id, CAST(CASE WHEN rating >= 5 THEN 1 ELSE 5 END AS INTEGER) AS confirmed, CAST(CASE WHEN rating = 3 THEN 1 ELSE 3 END AS INTEGER) AS settled,
CAST(greatest(0, rating - 1) AS INTEGER) AS undone, CAST(CASE WHEN rating >= 5 THEN 4 ELSE rating + 1 END AS INTEGER) AS move_target FROM photos""")
def rating_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rating")
    return _photos(spark, sf_dir).select("id", curation.confirm_photo(r, F.lit(1)).alias("confirmed"), curation.settle(r, F.lit(3), F.lit(1)).alias("settled"), curation.undo_by_one(r).alias("undone"), scalars.default_move_target(r).alias("move_target"))


_LOG = """log AS (SELECT o_orderstatus AS project_id, CAST(o_custkey AS VARCHAR) AS photo_id, o_orderkey AS seq, CAST(o_orderkey % 9 - 2 AS INTEGER) AS rating FROM orders)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderstatus").alias("project_id"), F.col("o_custkey").cast("string").alias("photo_id"), F.col("o_orderkey").alias("seq"), F.lit("set").alias("op"), (F.col("o_orderkey") % 9 - 2).cast("int").alias("rating"))


@query(f"WITH {_LOG} SELECT project_id, photo_id, CAST(greatest(0, least(5, arg_max(rating, seq))) AS INTEGER) AS rating, max(seq) AS seq FROM log GROUP BY ALL")
def rating_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.latest_ratings(_log(spark, sf_dir))


@query(f"""WITH {_LOG}, cut AS (SELECT * FROM log QUALIFY seq < max(seq) OVER (PARTITION BY project_id))
SELECT project_id, photo_id, CAST(greatest(0, least(5, arg_max(rating, seq))) AS INTEGER) AS rating, max(seq) AS seq FROM cut GROUP BY ALL""")
def rating_log_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.latest_ratings(curation.undo(_log(spark, sf_dir)))


_FILES = f"""{PHOTOS}, files AS (SELECT id, project_id, '/m/' || relative_path AS path, relative_path, relative_path AS name, captured_at, d_hash, rating, fingerprint_mtime, fingerprint_size, is_missing FROM photos WHERE CAST(id AS BIGINT) % 10 <> 0),
listing AS (SELECT project_id, '/m/' || relative_path AS path, relative_path, fingerprint_mtime AS mtime, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN fingerprint_size + 1 ELSE fingerprint_size END AS size FROM photos WHERE CAST(id AS BIGINT) % 13 <> 0)"""


@query(f"""WITH {_FILES}
SELECT project_id, path, CASE WHEN l.path IS NULL OR (f.path IS NOT NULL AND f.fingerprint_mtime IS NOT DISTINCT FROM l.mtime AND f.fingerprint_size IS NOT DISTINCT FROM l.size) THEN f.captured_at END AS captured_at,
  CASE WHEN l.path IS NULL OR (f.path IS NOT NULL AND f.fingerprint_mtime IS NOT DISTINCT FROM l.mtime AND f.fingerprint_size IS NOT DISTINCT FROM l.size) THEN f.d_hash END AS d_hash,
  coalesce(f.rating, 0) AS rating, CASE WHEN l.path IS NULL THEN f.fingerprint_size ELSE l.size END AS fingerprint_size, l.path IS NULL AS is_missing
FROM files f FULL JOIN listing l USING (project_id, path)""")
def upsert_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir).withColumn("path", F.concat(F.lit("/m/"), "relative_path")).withColumn("name", F.col("relative_path"))
    listing = photos.where(_number() % 13 != 0).select("project_id", "path", "relative_path", "name", F.col("fingerprint_mtime").alias("mtime"), F.when(_number() % 7 == 0, F.col("fingerprint_size") + 1).otherwise(F.col("fingerprint_size")).alias("size"))
    after = catalogue.upsert(photos.where(_number() % 10 != 0), listing)
    return after.select("project_id", "path", "captured_at", "d_hash", "rating", "fingerprint_size", "is_missing")


@query(f"WITH {PHOTOS} SELECT project_id AS id, count(*) FILTER (NOT is_missing) AS photo_count, 'ready' AS status FROM photos GROUP BY 1")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir)
    projects = photos.select(F.col("project_id").alias("id")).distinct()
    return catalogue.photo_counts(projects, photos).select("id", "photo_count", "status")


@query("SELECT o_custkey AS key, o_orderdate AS updated_at, max(o_totalprice) AS value FROM (SELECT * FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)) GROUP BY ALL")
def settings_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("updated_at"))
    return catalogue.latest(rows, "key")


@query("SELECT event_type AS project_id, event_id AS updated_at, CAST(json_extract(props, '$.k') AS INTEGER) AS round, 'settings' AS stage, 0 AS n_groups FROM events")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    states = events.select(F.col("event_type").alias("project_id"), F.regexp_replace("props", '"k"', '"round"').alias("state_json"), F.col("event_id").alias("updated_at"))
    decoded = catalogue.decode_session(states)
    again = catalogue.decode_session(catalogue.encode_session(decoded))
    return again.select("project_id", "updated_at", F.col("session.round").alias("round"), F.col("session.stage").alias("stage"), F.size("session.groups").alias("n_groups"))


_ANSWERS = f"""{USABLE}, answers AS (SELECT project_id, distance, distance <= 22 OR CAST(id AS BIGINT) % 17 = 0 AS grouped FROM adjacent WHERE left_id IS NOT NULL)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.adjacent(_photos(spark, sf_dir)).where(F.col("previous").isNotNull())
    return rows.select("project_id", "distance", ((F.col("distance") <= 22) | (_number() % 17 == 0)).alias("grouped"))


@query(f"""WITH {_ANSWERS}, errors AS (SELECT project_id, t, count(*) FILTER (grouped <> (distance <= t)) AS e FROM answers, range(65) r(t) GROUP BY ALL),
best AS (SELECT project_id, list(t ORDER BY t) AS ts FROM (SELECT * FROM errors QUALIFY e = min(e) OVER (PARTITION BY project_id)) GROUP BY project_id)
SELECT project_id, CAST(ts[len(ts) // 2 + 1] AS INTEGER) AS threshold FROM best""")
def infer_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.infer(_answers(spark, sf_dir), "project_id")


@query(f"WITH {_ANSWERS} SELECT CAST(t AS INTEGER) AS t, count(*) FILTER (grouped <> (distance <= t)) AS errors FROM answers, range(65) r(t) GROUP BY t")
def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.error_matrix(_answers(spark, sf_dir))


@query(f"WITH {_ANSWERS} SELECT project_id, coalesce(max(distance) FILTER (grouped), -1) AS grouped_up_to, coalesce(min(distance) FILTER (NOT grouped), 65) AS separate_from FROM answers GROUP BY project_id")
def evidence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.evidence(_answers(spark, sf_dir), "project_id")


@query(f"WITH {USABLE} SELECT project_id, left_id || ':' || id AS id, distance, row_number() OVER (PARTITION BY project_id ORDER BY distance, left_id || ':' || id) - 1 AS i FROM adjacent WHERE left_id IS NOT NULL AND gap_ms <= 4000 AND NOT (timestamp_source IN ('filesystem_mtime', 'unknown') AND left_source IN ('filesystem_mtime', 'unknown'))")
def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sequence.burst_pairs(_photos(spark, sf_dir)).select("project_id", "id", "distance")
    return threshold.ranked_pairs(pairs, "project_id")


_WANTED = f"""{USABLE}, wanted AS (SELECT project_id, id, captured_at, bits, CAST(id AS BIGINT) // 50 AS block, row_number() OVER (PARTITION BY project_id ORDER BY captured_at, relative_path, id) - 1 AS pos FROM usable),
paired AS (SELECT project_id, lag(id) OVER w AS left_id, id AS right_id, block = lag(block) OVER w AS joined, captured_at - lag(captured_at) OVER w <= 4000 AND bit_count(xor(bits, lag(bits) OVER w)) <= 24 AS raw FROM wanted WINDOW w AS (PARTITION BY project_id ORDER BY pos))"""


@query(f"WITH {_WANTED} SELECT project_id, left_id, right_id, joined FROM paired WHERE left_id IS NOT NULL AND joined <> raw")
def shape_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir)
    rows = sequence.usable(photos).select("project_id", "id", "captured_at", "relative_path")
    wanted = curation.placed(rows, sequence_order(), "project_id").select("project_id", "id", (F.col("place") - 1).alias("pos"), F.floor(_number() / 50).alias("block"))
    return shape.exceptions(photos, wanted, 24)


def sequence_order() -> list:
    return [(F.asc, c) for c in sequence.ORDER]


_RUNS = f"""{PHOTOS}, runs AS (SELECT project_id, CAST(id AS BIGINT) // 12 AS run, id, CAST(id AS BIGINT) % 12 AS pos, CAST(id AS BIGINT) % 3 = 0 AND CAST(id AS BIGINT) % 12 > 0 AS cut, rating >= 3 AS chosen FROM photos)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _number()
    return _photos(spark, sf_dir).select("project_id", F.floor(n / 12).alias("run"), "id", (n % 12).alias("pos"), ((n % 3 == 0) & (n % 12 > 0)).alias("cut"), "rating")


@query(f"""WITH {_RUNS}, marked AS (SELECT *, CAST(sum(CASE WHEN pos > 0 AND cut THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, run ORDER BY pos) AS BIGINT) AS block FROM runs)
SELECT project_id, run, id, pos, block, count(*) OVER (PARTITION BY project_id, run, block) AS n FROM marked""")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.blocks(_runs(spark, sf_dir)).select("project_id", "run", "id", "pos", "block", "n")


@query(f"WITH {_RUNS} SELECT project_id, run, id, cut OR coalesce(chosen <> lag(chosen) OVER (PARTITION BY project_id, run ORDER BY pos), false) AS cut FROM runs")
def cut_around_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return shape.cut_around(runs, runs.where("rating >= 3")).select("project_id", "run", "id", "cut")


@query(f"WITH {_RUNS} SELECT project_id, run, count(*) FILTER (pos > 0 AND cut) AS n_cuts FROM runs GROUP BY ALL")
def boundary_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.boundaries(_runs(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id, [CAST(floor(x * 1000) AS INTEGER) for x in embedding] AS g FROM embeddings)
SELECT vec_id, format('{:016x}', CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN g[(i // 7) * 8 + i % 7 + 1] > g[(i // 7) * 8 + i % 7 + 2] THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)) AS d_hash FROM e""")
def dhash_from_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    grid = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    return rows.select("vec_id", hashing.hash_text(hashing.difference_hash(grid, 8, 8)).alias("d_hash"))


@query(f"""WITH {PHOTOS} SELECT a.id, CASE WHEN a.d_hash IS NULL OR b.d_hash IS NULL OR CAST(a.id AS BIGINT) % 10 = 0 THEN 64 ELSE CAST(bit_count(xor(CAST('0x' || a.d_hash AS BIGINT), CAST('0x' || b.d_hash AS BIGINT))) AS INTEGER) END AS distance
FROM photos a JOIN photos b ON CAST(b.id AS BIGINT) = CAST(a.id AS BIGINT) + 1""")
def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _photos(spark, sf_dir).select("id", _number().alias("n"), F.when(_number() % 10 == 0, F.lit("no hash")).otherwise(F.col("d_hash")).alias("d_hash"))
    b = _photos(spark, sf_dir).select((_number() - 1).alias("n"), F.col("d_hash").alias("other"))
    return a.join(b, "n").select("id", hashing.distance(F.col("d_hash"), F.col("other")).alias("distance"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 END AS at FROM events""")
def filename_capture_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    f = lambda pattern: F.date_format("ts", pattern)
    shapes = [F.concat(F.lit("IMG_"), f("yyyyMMdd_HHmmss"), F.lit(".jpg")), F.concat(f("yyyy-MM-dd_HH-mm-ss"), F.lit(".png")), F.concat(f("yyyyMMddHHmmss"), F.lit(".JPG")), F.concat(F.lit("12_IMG_"), f("yyyyMMdd_HHmmss")), F.lit("IMG_1234.HEIC")]
    name = F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select("event_id", capture.filename_ms(name).alias("at"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000 - CASE WHEN event_id % 4 = 1 THEN 9 * 3600000 WHEN event_id % 4 = 2 THEN -(5 * 3600000 + 30 * 60000) ELSE 0 END END AS at FROM events""")
def exif_datetime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = (F.col("event_id") % 4 + 1).cast("int")
    text = F.when(kind == 4, F.lit("2023:02:30 10:00:00")).otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    offset = F.element_at(F.array(F.lit("+25:00"), F.lit("+09:00"), F.lit("-05:30"), F.lit("")), kind)
    return events.select("event_id", capture.exif_ms(text, offset).alias("at"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 4 = 0 THEN event_id WHEN event_id % 4 = 1 THEN event_id + 1 WHEN event_id % 4 = 2 THEN NULL ELSE epoch_us(ts) // 1000 END AS BIGINT) AS at,
CASE event_id % 4 WHEN 0 THEN 'exif_original' WHEN 1 THEN 'exif_datetime' WHEN 2 THEN 'unknown' ELSE 'filesystem_mtime' END AS source FROM events""")
def capture_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    mtime = F.when(n % 4 != 2, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    found = capture.resolve(F.when(n % 4 == 0, n), F.when(n % 4 < 2, n + 1), F.lit("holiday.jpg"), mtime)
    return events.select("event_id", found["at"].alias("at"), found["source"].alias("source"))


@query(f"""WITH {PHOTOS}, files AS (SELECT project_id, id, rating, relative_path, 'IMG_' || lpad(CAST(CAST(id AS BIGINT) % 50 AS VARCHAR), 4, '0') || '.jpg' AS name FROM photos WHERE NOT is_missing),
numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, rating, name ORDER BY relative_path, id) AS n FROM files)
SELECT project_id, id, 'star-' || rating || '/' || CASE WHEN n = 1 THEN name ELSE replace(name, '.jpg', ' (' || n || ').jpg') END AS target FROM numbered""")
def export_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = pages.visible(_photos(spark, sf_dir)).withColumn("name", F.concat(F.lit("IMG_"), F.lpad((_number() % 50).cast("string"), 4, "0"), F.lit(".jpg")))
    return export.layout(files).select("project_id", "id", "target")


@query(f"WITH {PHOTOS} SELECT id, rating FROM photos WHERE NOT is_missing AND project_id = 'signup' AND rating IN (4, 5)")
def export_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.candidates(_photos(spark, sf_dir), "signup", [4, 5]).select("id", "rating")


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN greatest(w, h) <= 1024 THEN w ELSE greatest(1, round(w * 1024 / greatest(w, h))) END AS INTEGER) AS width, CAST(CASE WHEN greatest(w, h) <= 1024 THEN h ELSE greatest(1, round(h * 1024 / greatest(w, h))) END AS INTEGER) AS height,
CAST(CASE WHEN l_partkey % 2000 IN (768, 1024, 1280, 1536, 1920) THEN l_partkey % 2000 ELSE 1024 END AS INTEGER) AS edge, CAST(greatest(2, least(9, l_quantity)) AS INTEGER) AS group_size
FROM (SELECT *, CAST(l_quantity * 100 AS INTEGER) AS w, CAST(round(l_extendedprice / 20) AS INTEGER) + 1 AS h FROM lineitem)""")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w, h = (F.col("l_quantity") * 100).cast("int"), F.round(F.col("l_extendedprice") / 20).cast("int") + 1
    fitted = scalars.fit_long_edge(w, h, F.lit(1024))
    return lines.select("l_orderkey", "l_linenumber", fitted["width"].alias("width"), fitted["height"].alias("height"), scalars.display_edge(F.col("l_partkey") % 2000).alias("edge"), scalars.group_size(F.col("l_quantity"), large=False).alias("group_size"))


@query(f"WITH {PHOTOS} SELECT project_id, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM photos) AS share FROM photos GROUP BY project_id")
def phase_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _photos(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("n"))
    return catalogue.shares(counts, "n")


@query("SELECT o_orderkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / o_totalprice AS speed_up FROM orders")
def speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return catalogue.speed_up(orders, "o_totalprice", "o_orderkey", "o_custkey").select("o_orderkey", "speed_up")


@query(f"WITH {OVERRIDES} SELECT project_id, left_id, right_id, joined FROM overrides")
def pair_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.overrides(views.adjacent(spark, sf_dir))


_NEAR = "gap_ms <= 4000 AND NOT (timestamp_source IN ('filesystem_mtime', 'unknown') AND left_source IN ('filesystem_mtime', 'unknown'))"


@query(f"""WITH {USABLE}, pairs AS (SELECT project_id, count(*) AS n_pairs, max(distance) AS largest FROM adjacent WHERE left_id IS NOT NULL AND {_NEAR} GROUP BY 1),
seeds AS (SELECT project_id, count(*) AS n FROM photos WHERE NOT is_missing AND rating = 1 GROUP BY 1)
SELECT project_id, n AS n_candidates, coalesce(n_pairs, 0) AS n_pairs, coalesce(largest, 64) AS largest_distance, CASE WHEN n_pairs > 0 AND project_id <> 'view' THEN 24 END AS burst_threshold,
  CASE WHEN n_pairs IS NULL THEN 'tournament' WHEN project_id = 'view' THEN 'burst-threshold' ELSE 'burst-preview' END AS stage, n >= 2 AS can_start
FROM seeds LEFT JOIN pairs USING (project_id)""")
def session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir)
    projects = photos.select(F.col("project_id").alias("id")).distinct().withColumn("burst_threshold", F.when(F.col("id") != "view", F.lit(24)))
    return session.start(photos, sequence.burst_pairs(photos), projects, True, 1)


@query(f"WITH {groups_sql(24)} SELECT project_id, CAST(sum(n_photos) AS BIGINT) AS n_photos, count(*) AS n_groups FROM bursts GROUP BY project_id")
def grouped_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, near = _photos(spark, sf_dir), views.adjacent(spark, sf_dir)
    return session.grouped_photos(sequence.burst_groups(near, 24, views.overrides(near)))


@query(f"""WITH {groups_sql(24)}, {LARGEST}, wanted AS (SELECT m.*, l.island IS NOT NULL AS held FROM members m LEFT JOIN largest l USING (project_id, island)),
span AS (SELECT project_id, min(captured_at) - 4000 AS low, max(captured_at) + 4000 AS high FROM wanted WHERE held GROUP BY 1),
near AS (SELECT m.*, row_number() OVER w - 1 AS pos, lag(held) OVER w AS before FROM wanted m JOIN span s ON s.project_id = m.project_id AND m.captured_at BETWEEN s.low AND s.high
  WINDOW w AS (PARTITION BY m.project_id ORDER BY m.captured_at, m.relative_path, m.id))
SELECT project_id, pos, id, pos > 0 AND NOT (before AND held) AS cut FROM near""")
def open_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    members = views.largest_burst(sequence.burst_members(near, 24, views.overrides(near))).select("project_id", "island", "id")
    return session.open_burst(near, members).select("project_id", "pos", "id", "cut")


@query(f"""WITH {groups_sql(24)}, ordered AS (SELECT project_id, id, island, row_number() OVER (PARTITION BY project_id ORDER BY rating, id) AS pos FROM members)
SELECT project_id, min(pos) AS pos, island AS id FROM ordered GROUP BY project_id, island""")
def collapsed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    members = sequence.burst_members(near, 24, views.overrides(near))
    order = curation.placed(members, [(F.asc, "rating"), (F.asc, "id")], "project_id").select("project_id", F.col("place").alias("pos"), "id")
    return session.collapsed(order, members.select("project_id", "id", F.col("island").alias("representative")))


@query(f"""WITH {PHOTOS} SELECT project_id, avg(CASE WHEN d_hash IS NOT NULL AND bit_count(xor(CAST('0x' || d_hash AS BIGINT), CAST(id AS BIGINT))) <= 28 THEN 1 ELSE 0 END) AS share FROM photos GROUP BY project_id""")
def share_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _photos(spark, sf_dir).withColumn("other", hashing.hash_text(_number()))
    return session.share_within(photos, "d_hash", "other", 28, "project_id")
