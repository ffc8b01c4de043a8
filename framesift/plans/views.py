"""The photos view over the driver's tables, and small views around it, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.hashing import difference_hash, hash_text
from framesift.operators import sequence
from framesift.schema import SOURCES
from framesift.storage import saved

def _ms(ts: Column, per: int = 1000) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(per)).cast("bigint")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo an event; hashes from the embeddings as 8 x 8 grids; some times and hashes are null."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hashes = vectors.select("vec_id", hash_text(difference_hash(F.col("embedding"), 8, 8)).alias("full_hash"))
    n = F.col("event_id")
    photo_id = F.lpad(n.cast("string"), 10, "0")
    rows = events.withColumn("vec_id", n % max(1, vectors.count())).join(hashes, "vec_id", "left")
    return rows.select(
        photo_id.alias("id"),
        F.col("event_type").alias("project_id"),
        F.concat(photo_id, F.lit(".jpg")).alias("relative_path"),
        F.when(n % 89 != 0, _ms(F.col("ts"), 300_000)).alias("captured_at"),
        F.when(n % 83 != 0, F.col("full_hash")).alias("d_hash"),
        (n % 6).cast("int").alias("rating"),
        (n % 97 == 0).alias("is_missing"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (n % 5 + 1).cast("int")).alias("timestamp_source"),
        F.when(n % 7 != 0, F.lit(2)).when(n % 14 != 0, F.lit(1)).cast("int").alias("d_hash_version"),
        F.when(n % 11 != 0, F.concat(F.lit("t/"), photo_id)).alias("thumbnail_path"),
        F.when(n % 13 != 0, F.lit(2)).cast("int").alias("thumbnail_version"),
        F.when(n % 3 != 0, F.concat(F.lit("d/"), photo_id)).alias("display_path"),
        F.when(n % 4 != 0, F.lit(1024)).otherwise(F.lit(1536)).cast("int").alias("display_edge"),
        F.when(n % 29 == 0, F.lit("unreadable")).alias("analysis_error"),
        F.col("user_id").alias("fingerprint_size"),
        _ms(F.col("ts")).alias("fingerprint_mtime"),
    )


PHOTOS = f"""photos AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, event_type AS project_id, lpad(CAST(event_id AS VARCHAR), 10, '0') || '.jpg' AS relative_path,
    CASE WHEN event_id % 89 <> 0 THEN epoch_us(ts) // 300000 END AS captured_at,
    CASE WHEN event_id % 83 <> 0 THEN h END AS d_hash,
    CAST(event_id % 6 AS INTEGER) AS rating, event_id % 97 = 0 AS is_missing,
    (['exif_original', 'exif_datetime', 'filename_inferred', 'filesystem_mtime', 'unknown'])[event_id % 5 + 1] AS timestamp_source,
    CASE WHEN event_id % 7 <> 0 THEN 2 WHEN event_id % 14 <> 0 THEN 1 END AS d_hash_version,
    CASE WHEN event_id % 11 <> 0 THEN 't/' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS thumbnail_path,
    CASE WHEN event_id % 13 <> 0 THEN 2 END AS thumbnail_version,
    CASE WHEN event_id % 3 <> 0 THEN 'd/' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS display_path,
    CASE WHEN event_id % 4 <> 0 THEN 1024 ELSE 1536 END AS display_edge,
    CASE WHEN event_id % 29 = 0 THEN 'unreadable' END AS analysis_error,
    user_id AS fingerprint_size, epoch_us(ts) // 1000 AS fingerprint_mtime
  FROM events LEFT JOIN (
    SELECT vec_id, format('{{:016x}}', CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[(i // 7) * 8 + i % 7 + 1] > embedding[(i // 7) * 8 + i % 7 + 2] THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)) AS h
    FROM embeddings) v ON v.vec_id = event_id % (SELECT count(*) FROM embeddings))"""

USABLE = f"""{PHOTOS},
usable AS (SELECT *, CAST('0x' || d_hash AS BIGINT) AS bits FROM photos WHERE NOT is_missing AND captured_at IS NOT NULL AND d_hash IS NOT NULL),
adjacent AS (
  SELECT *, lag(id) OVER w AS left_id, captured_at - lag(captured_at) OVER w AS gap_ms, CAST(bit_count(xor(bits, lag(bits) OVER w)) AS INTEGER) AS distance,
    lag(timestamp_source) OVER w AS left_source
  FROM usable WINDOW w AS (PARTITION BY project_id ORDER BY captured_at, relative_path, id))"""


def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable photos beside their previous ones, written once for several uses."""
    return saved(sequence.adjacent(photos(spark, sf_dir)))


def overrides(adjacent: DataFrame) -> DataFrame:
    """Decisions for two of every 37 neighbours: by the number of the left one, one joins and one splits."""
    pairs = adjacent.where("previous is not null")
    left = F.col("previous.id")
    rest = left.cast("bigint") % 37
    return pairs.where(rest < 2).select("project_id", left.alias("left_id"), F.col("id").alias("right_id"), (rest == 0).alias("joined"))


OVERRIDES = f"""{USABLE},
overrides AS (SELECT project_id, left_id, id AS right_id, CAST(left_id AS BIGINT) % 37 = 0 AS joined FROM adjacent WHERE left_id IS NOT NULL AND CAST(left_id AS BIGINT) % 37 < 2)"""


def groups_sql(threshold: int, base: str = OVERRIDES) -> str:
    """CTEs up to ``members`` (a row a photo with its island) and ``bursts`` (a row a group)."""
    return f"""{base},
marked AS (SELECT a.*, CASE WHEN a.left_id IS NULL OR NOT coalesce(o.joined, a.gap_ms <= 4000 AND a.distance <= {threshold}) THEN 1 ELSE 0 END AS starts
  FROM adjacent a LEFT JOIN overrides o ON o.project_id = a.project_id AND o.left_id = a.left_id AND o.right_id = a.id),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY project_id ORDER BY captured_at, relative_path, id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
members AS (SELECT *, first_value(id) OVER r AS island, first_value(bits) OVER r AS first_bits FROM numbered WINDOW r AS (PARTITION BY project_id, run ORDER BY captured_at, relative_path, id)),
bursts AS (SELECT project_id, island, count(*) AS n_photos, max(captured_at) - min(captured_at) AS span_ms, sum(bit_count(xor(bits, first_bits))) AS bits,
    string_agg(id, ',' ORDER BY captured_at, relative_path, id) AS photo_ids, arg_max(id, (captured_at, relative_path, id)) AS last_id
  FROM members GROUP BY project_id, island HAVING count(*) > 1)"""


def largest_burst(members: DataFrame) -> DataFrame:
    """The members of the largest burst of each project, of equal ones the one with the last island."""
    sizes = members.groupBy("project_id", "island").agg(F.count("*").alias("n")).where("n > 1")
    largest = sizes.groupBy("project_id").agg(F.max(F.struct("n", "island"))["island"].alias("island"))
    return members.join(largest, ["project_id", "island"])


LARGEST = "largest AS (SELECT project_id, arg_max(island, (n_photos, island)) AS island FROM bursts GROUP BY project_id)"
