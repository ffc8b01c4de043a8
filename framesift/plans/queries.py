"""Registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import curation, pages, sequence
from framesift.plans import views
from framesift.plans.views import LARGEST, OVERRIDES, PHOTOS, USABLE, groups_sql
from framesift.storage import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that has the same result."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def _flat(groups: DataFrame) -> DataFrame:
    """Groups with their members as text, which every engine writes alike."""
    return groups.select("project_id", "id", F.array_join("photo_ids", ",").alias("photo_ids"), "n_photos", "span_ms", "similarity")


def _bursts_sql(threshold: int, base: str = OVERRIDES) -> str:
    return f"""WITH {groups_sql(threshold, base)}
SELECT project_id, island || ':' || last_id AS id, photo_ids, n_photos, span_ms,
  CAST(round(greatest(0.0, 1 - bits / (n_photos - 1) / 64) * 100) AS BIGINT) AS similarity FROM bursts"""


@query(_bursts_sql(24))
def burst_groups_t24(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    return _flat(sequence.burst_groups(near, 24, views.overrides(near)))


@query(_bursts_sql(14))
def burst_groups_t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    return _flat(sequence.burst_groups(near, 14, views.overrides(near)))


@query(_bursts_sql(24, f"{USABLE}, overrides AS (SELECT '' AS project_id, '' AS left_id, '' AS right_id, true AS joined)"))
def burst_groups_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(sequence.burst_groups(views.photos(spark, sf_dir), 24))


@query(f"WITH {groups_sql(24)} SELECT project_id, island, id, captured_at FROM members")
def burst_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    return sequence.burst_members(near, 24, views.overrides(near)).select("project_id", "island", "id", "captured_at")


_ELIGIBLE = "gap_ms <= 4000 AND NOT (timestamp_source IN ('filesystem_mtime', 'unknown') AND left_source IN ('filesystem_mtime', 'unknown'))"


@query(f"WITH {USABLE} SELECT project_id, left_id || ':' || id AS id, left_id, id AS right_id, distance, gap_ms FROM adjacent WHERE left_id IS NOT NULL AND {_ELIGIBLE}")
def burst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.burst_pairs(views.photos(spark, sf_dir))


_TIMED = f"""{PHOTOS},
timed AS (SELECT *, timestamp_source IN ('filesystem_mtime', 'unknown') AS weak FROM photos WHERE NOT is_missing AND captured_at IS NOT NULL),
sided AS (SELECT project_id, id, captured_at,
    least(CASE WHEN NOT (weak AND lag(weak) OVER w) THEN captured_at - lag(captured_at) OVER w END, CASE WHEN NOT (weak AND lead(weak) OVER w) THEN lead(captured_at) OVER w - captured_at END) AS near_ms,
    CASE WHEN weak AND lag(weak) OVER w THEN captured_at - lag(captured_at) OVER w END AS weak_ms
  FROM timed WINDOW w AS (PARTITION BY project_id ORDER BY captured_at, relative_path, id)),
counted AS (SELECT project_id, w AS window_ms, count(*) FILTER (near_ms <= w) AS n_candidates, count(*) FILTER (near_ms <= w) / count(*) AS share, count(*) FILTER (weak_ms <= w) AS weak_pairs
  FROM sided, (VALUES (4000), (2000), (1000), (500)) v(w) GROUP BY project_id, w),
chosen AS (SELECT * FROM counted WHERE window_ms = 500 OR NOT (n_candidates > 2000 AND share > 0.8) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY window_ms DESC) = 1)"""


@query(f"WITH {_TIMED} SELECT * FROM chosen")
def candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.candidate_window(views.photos(spark, sf_dir))


@query(f"WITH {_TIMED} SELECT project_id, id, captured_at, window_ms FROM sided JOIN chosen USING (project_id) WHERE near_ms <= window_ms")
def burst_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.burst_candidates(views.photos(spark, sf_dir))


@query(f"""WITH {groups_sql(24)}, {LARGEST},
span AS (SELECT project_id, min(captured_at) - 4000 AS low, max(captured_at) + 4000 AS high FROM members JOIN largest USING (project_id, island) GROUP BY project_id)
SELECT u.project_id, u.id, u.captured_at FROM usable u JOIN span s ON s.project_id = u.project_id AND u.captured_at BETWEEN s.low AND s.high""")
def burst_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    members = views.largest_burst(sequence.burst_members(near, 24, views.overrides(near)))
    return sequence.neighbourhood(near, members).select("project_id", "id", "captured_at")


@query(f"WITH {USABLE} SELECT project_id, distance, count(*) AS n FROM adjacent WHERE left_id IS NOT NULL AND gap_ms <= 4000 GROUP BY ALL")
def pair_distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = sequence.adjacent(views.photos(spark, sf_dir)).where(F.col("previous").isNotNull() & (F.col("gap_ms") <= 4000))
    return near.groupBy("project_id", "distance").agg(F.count("*").alias("n"))


@query(f"""WITH {USABLE}, ranked AS (SELECT project_id, gap_ms, row_number() OVER (PARTITION BY project_id ORDER BY gap_ms) - 1 AS rank, count(*) OVER (PARTITION BY project_id) AS n FROM adjacent WHERE left_id IS NOT NULL)
SELECT project_id, max(gap_ms) FILTER (rank = CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT)) AS p50, max(gap_ms) FILTER (rank = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT)) AS p90,
  max(gap_ms) FILTER (rank = CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT)) AS p95, CAST(sum(gap_ms) AS BIGINT) / count(*) AS mean, max(gap_ms) AS max FROM ranked GROUP BY project_id""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = sequence.adjacent(views.photos(spark, sf_dir)).where(F.col("previous").isNotNull())
    return pages.nearest_rank(gaps, "gap_ms", (0.5, 0.9, 0.95), "project_id")


@query(f"""WITH {PHOTOS}, shifted AS (SELECT project_id, id, captured_at, relative_path, CAST('0x' || d_hash AS BIGINT) AS h, xor(CAST('0x' || d_hash AS BIGINT), CAST(id AS BIGINT) % 8) AS g FROM photos WHERE NOT is_missing AND captured_at IS NOT NULL AND d_hash IS NOT NULL),
pair AS (SELECT bit_count(xor(h, lag(h) OVER w)) AS a, bit_count(xor(g, lag(g) OVER w)) AS b FROM shifted WINDOW w AS (PARTITION BY project_id ORDER BY captured_at, relative_path, id))
SELECT count(*) AS pairs, count(*) FILTER ((a <= 24) <> (b <= 24)) AS flips, sum(abs(a - b)) / count(*) AS mean_change, CAST(max(abs(a - b)) AS INTEGER) AS max_change, count(*) FILTER (abs(a - 24) <= 4) AS near_threshold FROM pair WHERE a IS NOT NULL""")
def decision_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framesift.functions.hashing import hash_bits, hash_text

    photos = views.photos(spark, sf_dir)
    other = hash_text(hash_bits(F.col("d_hash")).bitwiseXOR(F.col("id").cast("bigint") % 8))
    return sequence.decision_flips(photos.withColumn("other", other), "other", 24)


def _page_sql(where: str, order: str, limit: int, offset: int) -> str:
    return f"""WITH {PHOTOS}, rows AS (SELECT id, project_id, relative_path, captured_at, rating FROM photos WHERE NOT is_missing AND {where})
SELECT *, (SELECT count(*) FROM rows) AS total FROM (FROM rows ORDER BY {order} LIMIT {limit} OFFSET {offset})"""


_PAGE = ("id", "project_id", "relative_path", "captured_at", "rating", "total")


@query(_page_sql("project_id = 'click'", "relative_path, id", 80, 40))
def photo_page_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page(views.photos(spark, sf_dir), "click", 40, 80).select(*_PAGE)


@query(f"""WITH {PHOTOS}, placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, id) - 1 AS place, count(*) OVER (PARTITION BY project_id) AS total FROM photos WHERE NOT is_missing AND project_id IN ('click', 'view'))
SELECT id, project_id, relative_path, captured_at, rating, total FROM placed WHERE place >= total * 9 // 10 AND place < total * 9 // 10 + 80""")
def photo_pages_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages nine tenths into two projects, by an index of ranges."""
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    pages.write_index(views.photos(spark, sf_dir).select(*_PAGE[:-1], "is_missing"), path)
    groups = [{"project_id": p} for p in ("click", "view")]
    deep = [pages.indexed_page(spark, path, g, pages.indexed_total(spark, path, g) * 9 // 10) for g in groups]
    return reduce(DataFrame.unionByName, deep).select(*_PAGE)


@query(_page_sql("project_id = 'view' AND rating = 0", "rating DESC, relative_path, id", 200, 0))
def photo_page_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page(views.photos(spark, sf_dir), "view", -5, 5000, 0, pages.RATING_ORDER).select(*_PAGE)


@query(f"WITH {PHOTOS} SELECT project_id, id, rating, row_number() OVER (PARTITION BY project_id ORDER BY captured_at NULLS LAST, relative_path, id) AS place FROM photos WHERE NOT is_missing")
def selection_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.placed(pages.visible(views.photos(spark, sf_dir)), pages.CAPTURE_ORDER, "project_id").select("project_id", "id", "rating", "place")


@query(f"WITH {PHOTOS} SELECT id, rating FROM photos WHERE NOT is_missing AND project_id = 'error' AND rating = 3")
def seed_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.selection_seed(views.photos(spark, sf_dir), "error", 3)


@query(f"WITH {PHOTOS} SELECT project_id, {', '.join(f'count(*) FILTER (rating = {r}) AS n{r}' for r in range(6))}, count(*) AS total FROM photos WHERE NOT is_missing GROUP BY project_id")
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.rating_summary(views.photos(spark, sf_dir))


@query(f"WITH {PHOTOS}, wanted AS (SELECT o_orderkey % (SELECT count(*) FROM events) AS n, min(o_custkey) AS pos FROM orders GROUP BY 1) SELECT id, project_id, rating, pos FROM photos JOIN wanted ON id = lpad(CAST(n AS VARCHAR), 10, '0') WHERE NOT is_missing")
def photos_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    photos = views.photos(spark, sf_dir)
    ids = orders.select(F.col("o_custkey").alias("pos"), F.lpad((F.col("o_orderkey") % photos.count()).cast("string"), 10, "0").alias("id"))
    return pages.by_ids(photos, ids).select("id", "project_id", "rating", "pos")


@query(f"""WITH {PHOTOS} SELECT project_id, count(*) FILTER (captured_at IS NULL OR timestamp_source IS NULL OR d_hash IS NULL OR d_hash_version IS DISTINCT FROM 2 OR thumbnail_path IS NULL OR thumbnail_version IS DISTINCT FROM 2) AS backlog
FROM photos WHERE NOT is_missing GROUP BY project_id""")
def analysis_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.analysis_backlog(views.photos(spark, sf_dir))


@query(f"WITH {PHOTOS} SELECT project_id, count(*) FILTER (display_path IS NULL OR display_edge IS DISTINCT FROM 1024) AS backlog FROM photos WHERE NOT is_missing GROUP BY project_id")
def display_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.display_backlog(views.photos(spark, sf_dir), 1024)


@query(f"WITH {PHOTOS} SELECT project_id, count(analysis_error) AS failed FROM photos WHERE NOT is_missing GROUP BY project_id")
def failed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.failed_count(views.photos(spark, sf_dir))


@query(f"WITH {PHOTOS} SELECT project_id, id FROM photos WHERE NOT is_missing AND (captured_at IS NULL OR timestamp_source IS NULL)")
def needs_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.needs_metadata(views.photos(spark, sf_dir)).select("project_id", "id")


@query(f"WITH {PHOTOS} SELECT id, coalesce(display_path, thumbnail_path, relative_path) AS url FROM photos")
def display_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.display_url(views.photos(spark, sf_dir))


@query(f"WITH {PHOTOS} SELECT project_id, timestamp_source, n, n / sum(n) OVER (PARTITION BY project_id) AS share FROM (SELECT project_id, timestamp_source, count(*) AS n FROM photos WHERE NOT is_missing GROUP BY ALL)")
def timestamp_source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.source_histogram(views.photos(spark, sf_dir))


from framesift.plans import curated, steps, stored  # noqa: E402, F401  they register further queries
