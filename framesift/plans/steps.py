"""Registered queries: steps of a session on lists of ids, questions, settings, and writes to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import hashing, scalars
from framesift.operators import analysis, catalogue, curation, export, pages, sequence, session, shape, threshold
from framesift.plans import views
from framesift.plans.curated import _RUNS, _runs
from framesift.plans.queries import query
from framesift.plans.views import OVERRIDES, PHOTOS, USABLE

# Lists of ids: the orders of each customer, a few each.
_LISTS = """lists AS (SELECT o_custkey AS custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey),
even AS (SELECT *, list_filter(ids, lambda x: CAST(x AS BIGINT) % 2 = 0) AS evens, list_filter(ids, lambda x: CAST(x AS BIGINT) % 2 = 1) AS odds FROM lists)"""


def _number(x: Column) -> Column:
    return x.cast("bigint")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    rows = keys.select("custkey", F.transform("keys", lambda x: x.cast("string")).alias("ids"))
    return rows.withColumn("evens", F.filter("ids", lambda x: _number(x) % 2 == 0))


def _text(ids: Column) -> Column:
    return F.array_join(ids, ",")


def _groups_text(groups: Column) -> Column:
    return F.array_join(F.transform(groups, _text), "|")


def _sql_text(ids: str) -> str:
    return f"array_to_string({ids}, ',')"


def _sql_chunks(ids: str, size: int) -> str:
    """A list of texts, one for each chunk."""
    return f"list_transform(range(0, CAST(ceil(len({ids}) / {size}) AS BIGINT)), lambda i: array_to_string(({ids})[i * {size} + 1 : i * {size} + {size}], ','))"


@query(f"WITH {_LISTS} SELECT custkey, array_to_string({_sql_chunks('ids', 4)}, '|') AS chunks FROM lists")
def list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("custkey", _groups_text(curation.chunks(F.col("ids"), 4)).alias("chunks"))


def _sql_parts(ids: str, size: str) -> str:
    """A list of lists of ``size``, the last one shorter."""
    return f"list_transform(range(0, CAST(ceil(len({ids}) / {size}) AS BIGINT)), lambda i: ({ids})[i * {size} + 1 : i * {size} + {size}])"


def _sql_groups(groups: str) -> str:
    return f"array_to_string(list_transform({groups}, lambda g: {_sql_text('g')}), '|')"


# A round in progress: groups of three, one of one at the end is none; the group that is looked at and the new size differ by customer.
_ROUND = f"""{_LISTS}, rounds AS (SELECT custkey, ids, custkey % 4 AS cur, 2 + custkey % 3 AS size, list_filter({_sql_parts('ids', '3')}, lambda g: len(g) > 1) AS groups FROM lists)"""


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).withColumn("groups", curation.deal(F.col("ids"), 3)["groups"])
    return rows.withColumn("at", (F.col("custkey") % 4).cast("int")).withColumn("size", (2 + F.col("custkey") % 3).cast("int"))


@query(f"""WITH {_ROUND}, dealt AS (SELECT *, {_sql_parts('flatten(groups[cur + 1 :])', 'size')} AS parts FROM rounds)
SELECT custkey, {_sql_groups("list_concat(groups[1 : cur], list_filter(parts, lambda g: len(g) > 1))")} AS regrouped, {_sql_text("flatten(list_filter(parts, lambda g: len(g) = 1))")} AS survivors FROM dealt""")
def regroup_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rounds(spark, sf_dir).withColumn("new", curation.regroup(F.col("groups"), F.col("at"), F.col("size")))
    return rows.select("custkey", _groups_text(F.col("new.groups")).alias("regrouped"), _text(F.col("new.survivors")).alias("survivors"))


# Released photos: the first of a list, which a group may hold, and for three in four lists another.
@query(f"""WITH {_ROUND}, asked AS (SELECT *, CASE WHEN custkey % 4 = 1 THEN [ids[1]] ELSE ['x' || custkey, ids[1]] END AS released FROM rounds),
new AS (SELECT *, list_filter(released, lambda x: NOT list_contains(flatten(groups), x)) AS added FROM asked),
dealt AS (SELECT *, {_sql_parts('list_concat(added, flatten(groups[cur + 2 :]))', 'size')} AS parts FROM new)
SELECT custkey, CASE WHEN len(added) = 0 THEN {_sql_groups('groups')} ELSE {_sql_groups("list_concat(groups[1 : cur + 1], list_filter(parts, lambda g: len(g) > 1))")} END AS inserted,
CASE WHEN len(added) = 0 THEN '' ELSE {_sql_text("flatten(list_filter(parts, lambda g: len(g) = 1))")} END AS survivors, {_sql_text('added')} AS added FROM dealt""")
def insert_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at("ids", 1)
    released = F.when(F.col("custkey") % 4 == 1, F.array(first)).otherwise(F.array(F.concat(F.lit("x"), F.col("custkey").cast("string")), first))
    rows = _rounds(spark, sf_dir).withColumn("new", curation.insert_upcoming(F.col("groups"), F.col("at"), released, F.col("size")))
    return rows.select("custkey", _groups_text(F.col("new.groups")).alias("inserted"), _text(F.col("new.survivors")).alias("survivors"), _text(F.col("new.added")).alias("added"))


# Survivors that hold some photos twice; the photo that is meant differs by customer.
_MEANT = f"""{_LISTS}, meant AS (SELECT *, ids[custkey % len(ids) + 1] AS item, list_contains(evens, ids[custkey % len(ids) + 1]) AS twice FROM even)"""


def _meant() -> Column:
    return F.element_at("ids", (F.col("custkey") % F.size("ids") + 1).cast("int"))


@query(f"""WITH {_MEANT} SELECT custkey, {_sql_text("CASE WHEN twice THEN list_concat(ids, list_filter(evens, lambda x: x <> item)) ELSE list_concat(list_filter(ids, lambda x: x <> item), evens) END")} AS survivors,
{_sql_text("CASE WHEN twice THEN ids ELSE list_filter(ids, lambda x: x <> item) END")} AS candidates FROM meant""")
def undo_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = curation.without_last(F.concat("ids", "evens"), _meant())
    return _lists(spark, sf_dir).select("custkey", _text(after).alias("survivors"), _text(curation.next_candidates(after)).alias("candidates"))


@query(f"""WITH {_MEANT} SELECT custkey, {_sql_text("list_transform(ids, lambda x: CASE WHEN x = item THEN 'new' || custkey ELSE x END)")} AS ids FROM meant""")
def replaced_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.concat(F.lit("new"), F.col("custkey").cast("string"))
    return _lists(spark, sf_dir).select("custkey", _text(curation.replaced_representative(F.col("ids"), _meant(), new)).alias("ids"))


@query(f"WITH {_LISTS} SELECT custkey, {_sql_text('list_concat(evens, list_filter(odds, lambda x: CAST(x AS BIGINT) % 7 >= 5))')} AS chosen FROM even")
def chosen_with_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = F.map_from_arrays("ids", F.transform("ids", lambda x: (_number(x) % 7).cast("int")))
    return _lists(spark, sf_dir).select("custkey", _text(curation.chosen_with_confirmed(F.col("evens"), F.col("ids"), ratings)).alias("chosen"))


@query(f"""WITH {_LISTS} SELECT custkey, {_sql_text("CASE WHEN CAST(ids[1] AS BIGINT) % 2 = 0 THEN evens[2:] ELSE list_concat(evens, [ids[1]]) END")} AS toggled,
(custkey % 2 = 0) <> (CAST(ids[1] AS BIGINT) % 2 = 0) AS first_selected, CAST(CASE WHEN custkey % 2 = 0 THEN len(odds) ELSE len(evens) END AS INTEGER) AS n_selected FROM even""")
def toggled_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, first = F.col("custkey") % 2 == 0, F.element_at("ids", 1)
    return _lists(spark, sf_dir).select(
        "custkey", _text(scalars.toggled(F.col("evens"), first)).alias("toggled"), scalars.is_selected(every, F.col("evens"), first).alias("first_selected"),
        scalars.selected_count(every, F.col("evens"), F.size("ids")).alias("n_selected"),
    )


@query(f"WITH {_LISTS} SELECT custkey, CASE WHEN custkey % 2 = 1 THEN {_sql_text('evens')} END AS included, CASE WHEN custkey % 2 = 0 THEN {_sql_text('evens')} ELSE '' END AS excluded FROM even")
def move_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = curation.move_arguments(F.col("custkey") % 2 == 0, F.col("evens"))
    return _lists(spark, sf_dir).select("custkey", _text(args["include"]).alias("included"), _text(args["exclude"]).alias("excluded"))


@query(f"WITH {_LISTS} SELECT custkey, {_sql_text('list_filter(ids, lambda x: CAST(x AS BIGINT) % 2 = 1 OR x = evens[1])')} AS ids FROM even")
def collapsed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.coalesce(F.try_element_at("evens", F.lit(1)), F.lit(""))
    return _lists(spark, sf_dir).select("custkey", _text(session.collapsed_list(F.col("ids"), F.col("evens"), first)).alias("ids"))


@query(f"WITH {_LISTS} SELECT custkey, {_sql_text('list_concat(evens, list_filter(ids[1:3], lambda x: CAST(x AS BIGINT) % 2 = 1))')} AS used FROM even")
def asked_or_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir).select("custkey", _text(threshold.used(F.col("evens"), F.slice("ids", 1, 3))).alias("used"))


@query(f"WITH {_LISTS} SELECT CAST(custkey AS VARCHAR) AS project_id, len(evens) AS n_survivors, len(ids) AS n_answers, len(odds) AS n_rated FROM even")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.filter("ids", lambda x: _number(x) % 2 == 1)
    history = F.transform("ids", lambda x: F.struct(F.lit(0).alias("groupIndex"), F.array(x).alias("chosen")))
    text = F.to_json(F.struct(F.col("evens").alias("survivors"), history.alias("history"), F.map_from_arrays(odd, F.transform(odd, lambda x: F.lit(3))).alias("ratings")))
    states = _lists(spark, sf_dir).select(F.col("custkey").cast("string").alias("project_id"), text.alias("state_json"), F.lit(0).cast("bigint").alias("updated_at"))
    return session.counts(catalogue.decode_session(states))


@query(f"""WITH {PHOTOS}, seeds AS (SELECT project_id, id, rating, row_number() OVER (PARTITION BY project_id ORDER BY captured_at NULLS LAST, relative_path, id) - 1 AS place, count(*) OVER (PARTITION BY project_id) AS n FROM photos WHERE NOT is_missing AND rating = 2)
SELECT project_id, id, CAST(CASE WHEN place // 4 % 2 = 0 AND place % 4 = 1 THEN 3 ELSE 2 END AS INTEGER) AS rating FROM seeds WHERE NOT (n % 4 = 1 AND place = n - 1)""")
def skipped_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a round in groups of four every other group is skipped; of the rest the second photo is chosen."""
    photos = pages.visible(views.photos(spark, sf_dir), rating=2)
    dealt = curation.rounds(photos, 4).where("not is_survivor").join(photos.select("project_id", "id", "rating"), ["project_id", "id"])
    chosen = (F.col("group_index") % 2 == 0) & (F.col("place") % 4 == 2)
    return curation.confirm(dealt.withColumn("chosen", chosen)).select("project_id", "id", "rating")


# Settings and thresholds.


@query("""WITH asked AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 5) * 256 + 768 END AS edge, (['1280', 'abc', NULL, '1920'])[c_custkey % 4 + 1] AS setting FROM customer),
found AS (SELECT c_custkey, coalesce(edge, TRY_CAST(setting AS BIGINT), 1024) AS e FROM asked)
SELECT c_custkey, CAST(CASE WHEN e IN (768, 1024, 1280, 1536, 1920) THEN e ELSE 1024 END AS INTEGER) AS edge FROM found""")
def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    own = F.when(key % 3 == 0, key % 5 * 256 + 768)
    setting = F.element_at(F.array(F.lit("1280"), F.lit("abc"), F.lit(None), F.lit("1920")), (key % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", scalars.resolved_edge(own, setting).alias("edge"))


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 70 WHEN c_custkey % 2 = 0 THEN greatest(0, least(64, c_custkey % 100 - 10)) ELSE 14 END AS INTEGER) AS threshold FROM customer""")
def effective_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    value = threshold.effective(F.when(key % 3 == 0, key % 70), F.when(key % 2 == 0, key % 100 - 10))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", value.alias("threshold"))


_PROJECTS = "projects AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS key, CAST(c_custkey % 65 AS INTEGER) AS burst_threshold, c_custkey AS burst_threshold_learned_at FROM customer)"


@query(f"""WITH {_PROJECTS} SELECT id, CASE WHEN key % 4 = 0 THEN CASE WHEN key % 8 = 0 THEN CAST(least(64, key % 90) AS INTEGER) END ELSE burst_threshold END AS burst_threshold,
CASE WHEN key % 4 = 0 THEN CASE WHEN key % 8 = 0 THEN key + 1 END ELSE key END AS burst_threshold_learned_at FROM projects""")
def saved_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    projects = rows.select(key.cast("string").alias("id"), (key % 65).cast("int").alias("burst_threshold"), key.alias("burst_threshold_learned_at"))
    learned = rows.where(key % 4 == 0).select(key.cast("string").alias("id"), F.when(key % 8 == 0, key % 90).alias("threshold"), (key + 1).alias("at"))
    return threshold.save(projects, learned)


_ASKED = f"""{_LISTS}, answers AS (SELECT custkey, k % 50 AS i, k % 11 = 0 AS unknown, k % 50 <= 20 OR k % 13 = 0 AS grouped FROM (SELECT custkey, CAST(unnest(ids) AS BIGINT) AS k FROM lists))"""


@query(f"""WITH {_ASKED} SELECT custkey, greatest(0, coalesce(max(i + 1) FILTER (grouped AND NOT unknown), 0)) AS low, least(49, coalesce(min(i - 1) FILTER (NOT grouped AND NOT unknown), 49)) AS high FROM answers GROUP BY custkey""")
def open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = F.transform("ids", lambda x: F.struct(F.when(_number(x) % 11 != 0, _number(x) % 50).alias("i"), ((_number(x) % 50 <= 20) | (_number(x) % 13 == 0)).alias("grouped")))
    found = threshold.answered(answers, F.lit(0), F.lit(49))
    return _lists(spark, sf_dir).select("custkey", found["low"].alias("low"), found["high"].alias("high"))


@query(f"""WITH {_ASKED}, seen AS (SELECT custkey, count(*) AS n, coalesce(max(i) FILTER (grouped), -1) AS g, coalesce(min(i) FILTER (NOT grouped), 65) AS s FROM answers GROUP BY custkey)
SELECT custkey, CAST(n AS INTEGER) AS asked, n >= 8 OR custkey % 5 = 0 OR (n >= 5 AND g >= 0 AND s <= 64 AND s - g <= 2) AS stops FROM seen""")
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _number(F.col("x"))
    rows = _lists(spark, sf_dir).select("custkey", F.explode("ids").alias("x")).select("custkey", (x % 50).alias("distance"), ((x % 50 <= 20) | (x % 13 == 0)).alias("grouped"))
    counts = rows.groupBy("custkey").agg(F.count("*").alias("n"))
    seen = counts.join(threshold.evidence(rows, "custkey"), "custkey")
    stops = threshold.should_stop(F.col("n"), F.col("custkey") % 5, F.col("grouped_up_to"), F.col("separate_from"))
    return seen.select("custkey", threshold.question_progress(F.col("n"))["asked"].alias("asked"), stops.alias("stops"))


_RANKED = f"""{USABLE}, ranked AS (SELECT project_id, left_id || ':' || id AS id, distance, row_number() OVER (PARTITION BY project_id ORDER BY distance, left_id || ':' || id) - 1 AS i FROM adjacent
WHERE left_id IS NOT NULL AND gap_ms <= 4000 AND NOT (timestamp_source IN ('filesystem_mtime', 'unknown') AND left_source IN ('filesystem_mtime', 'unknown')))"""


@query(f"""WITH {_RANKED}, open AS (SELECT *, n // 4 AS low, n * 3 // 4 AS high FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS n FROM ranked))
SELECT project_id, id, distance, i FROM open WHERE i % 3 <> 1 AND i BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY abs(i - (low + high) // 2), i) = 1""")
def next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next question of each project, in a range of half of its pairs, a third of which has been asked."""
    ranked = threshold.ranked_pairs(sequence.burst_pairs(views.photos(spark, sf_dir)).select("project_id", "id", "distance"), "project_id")
    ranges = ranked.groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", F.floor(F.col("n") / 4).alias("low"), F.floor(F.col("n") * 3 / 4).alias("high"))
    return threshold.next_questions(ranked, ranked.where("i % 3 = 1").select("project_id", "id"), ranges)


# Small calculations.


@query("""SELECT l_orderkey, l_linenumber, CAST((2126 * (l_partkey % 256) + 7152 * (l_suppkey % 256) + 722 * l_linenumber) // 10000 AS INTEGER) AS luma FROM lineitem""")
def luma_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", hashing.luma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber")).alias("luma"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * (p_size % 7) / (p_size % 5) END AS share FROM part")
def guarded_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", scalars.percentage((F.col("p_size") % 7).cast("double"), F.col("p_size") % 5).alias("share"))


@query("""WITH moments AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate - INTERVAL 10000 DAY ELSE o_orderdate + INTERVAL (o_orderkey % 86400) SECOND END AS t FROM orders)
SELECT o_orderkey, CAST(CASE WHEN year(t) < 1980 THEN 33 ELSE ((year(t) - 1980) << 9) | (month(t) << 5) | day(t) END AS INTEGER) AS dos_date,
CAST(CASE WHEN year(t) < 1980 THEN 0 ELSE (hour(t) << 11) | (minute(t) << 5) | (CAST(floor(second(t)) AS BIGINT) // 2) END AS INTEGER) AS dos_time FROM moments""")
def dos_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ms, key = F.unix_millis(F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey")
    at = F.when(key % 5 == 0, ms - 10_000 * 86_400_000).otherwise(ms + key % 86_400 * 1000)
    found = scalars.dos_date_time(at)
    return orders.select("o_orderkey", found["date"].cast("int").alias("dos_date"), found["time"].cast("int").alias("dos_time"))


@query("""WITH turned AS (SELECT vec_id, list_transform(range(0, 64), lambda i: embedding[CAST(1 + CASE vec_id % 8 WHEN 0 THEN i WHEN 1 THEN i // 8 * 8 + 7 - i % 8 WHEN 2 THEN (7 - i // 8) * 8 + 7 - i % 8 WHEN 3 THEN (7 - i // 8) * 8 + i % 8
    WHEN 4 THEN i % 8 * 8 + i // 8 WHEN 5 THEN (7 - i % 8) * 8 + i // 8 WHEN 6 THEN (7 - i % 8) * 8 + 7 - i // 8 ELSE i % 8 * 8 + 7 - i // 8 END AS BIGINT)]) AS g FROM embeddings)
SELECT vec_id, format('{:016x}', CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN g[(i // 7) * 8 + i % 7 + 1] > g[(i // 7) * 8 + i % 7 + 2] THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)) AS d_hash FROM turned""")
def oriented_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("turned", analysis.oriented(F.col("embedding"), 8, 8, (F.col("vec_id") % 8 + 1).cast("int")))
    return rows.select("vec_id", hashing.hash_text(hashing.difference_hash(F.col("turned"), 8, 8)).alias("d_hash"))


# Writes to the catalogue.


@query(f"""WITH {PHOTOS} SELECT project_id, id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CAST(id AS BIGINT) * 10 ELSE captured_at END AS captured_at,
CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'unknown' WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'exif_original' ELSE timestamp_source END AS timestamp_source FROM photos""")
def written_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, n = views.photos(spark, sf_dir), _number(F.col("id"))
    found = photos.where(n % 3 == 0).select("project_id", "id", (n * 10).alias("at"), F.when(n % 6 != 0, F.lit("exif_original")).alias("source"))
    return catalogue.write_capture(photos, found).select("project_id", "id", "captured_at", "timestamp_source")


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with the columns of a stored thumbnail; of every five one was made from an older file."""
    n = _number(F.col("id"))
    more = {"thumbnail_mtime": F.col("fingerprint_mtime"), "thumbnail_size": F.when(n % 5 == 0, F.col("fingerprint_size") + 1).otherwise(F.col("fingerprint_size")), "thumbnail_source": F.lit("exif"), "analysis_error_at": F.when(n % 29 == 0, n)}
    return views.photos(spark, sf_dir).withColumns(more)


_DONE = "CAST(id AS BIGINT) % 4 = 0"


@query(f"""WITH {PHOTOS}, n AS (SELECT *, CAST(id AS BIGINT) AS k FROM photos)
SELECT id, CASE WHEN k % 4 <> 0 THEN d_hash WHEN k % 8 = 0 THEN lpad('a', 16, '0') END AS d_hash, CASE WHEN k % 4 <> 0 THEN d_hash_version WHEN k % 8 = 0 THEN 2 END AS d_hash_version,
CASE WHEN k % 4 <> 0 THEN thumbnail_version WHEN k % 8 = 0 THEN 2 END AS thumbnail_version, CASE WHEN k % 4 <> 0 THEN fingerprint_mtime WHEN k % 8 = 0 THEN fingerprint_mtime END AS thumbnail_mtime,
CASE WHEN k % 16 = 0 THEN 'full' ELSE 'exif' END AS thumbnail_source, CASE WHEN k % 4 <> 0 THEN analysis_error WHEN k % 8 <> 0 THEN 'broken' END AS analysis_error,
CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 29 = 0 THEN k END WHEN k % 8 <> 0 THEN k + 1 END AS analysis_error_at FROM n""")
def written_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, n = _analysed(spark, sf_dir), _number(F.col("id"))
    fine = n % 8 == 0
    done = photos.where(n % 4 == 0).select(
        "project_id", "id", F.when(fine, F.lit("000000000000000a")).alias("hash"), F.when(fine, F.lit("t/new")).alias("thumb_path"), F.when(n % 16 == 0, F.lit("full")).alias("thumb_source"),
        F.when(~fine, F.lit("broken")).alias("error"), (n + 1).alias("at"),
    )
    return catalogue.write_analysis(photos, done).select("id", "d_hash", "d_hash_version", "thumbnail_version", "thumbnail_mtime", "thumbnail_source", "analysis_error", "analysis_error_at")


_STATE = """CASE WHEN thumbnail_path IS NULL OR thumbnail_version IS DISTINCT FROM 2 OR CAST(id AS BIGINT) % 5 = 0 OR fingerprint_mtime IS NULL THEN 'regenerate' WHEN d_hash IS NULL OR d_hash_version IS DISTINCT FROM 2 THEN 'rehash' ELSE 'hit' END"""


@query(f"WITH {PHOTOS} SELECT project_id, {_STATE} AS state, count(*) AS n FROM photos WHERE NOT is_missing GROUP BY ALL")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.visible(_analysed(spark, sf_dir)).withColumn("state", catalogue.cache_state())
    return rows.groupBy("project_id", "state").agg(F.count("*").alias("n"))


@query(f"WITH {PHOTOS} SELECT project_id, id FROM photos WHERE NOT is_missing AND {_STATE} <> 'hit'")
def photos_to_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.to_analyse(_analysed(spark, sf_dir)).select("project_id", "id")


@query(f"""WITH {PHOTOS} SELECT project_id, id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 AND CAST(id AS BIGINT) % 12 <> 0 THEN fingerprint_mtime + 1 WHEN CAST(id AS BIGINT) % 12 <> 0 THEN fingerprint_mtime END AS fingerprint_mtime,
CASE WHEN CAST(id AS BIGINT) % 12 <> 0 THEN fingerprint_size END AS fingerprint_size, d_hash FROM photos""")
def backfilled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, all_ = _number(F.col("id")), views.photos(spark, sf_dir).withColumn("path", F.concat(F.lit("/m/"), "relative_path"))
    empty = {c: F.when(n % 4 != 0, F.col(c)) for c in ("fingerprint_mtime", "fingerprint_size")}
    listing = all_.where(n % 12 != 0).select("project_id", "path", (F.col("fingerprint_mtime") + 1).alias("mtime"), F.col("fingerprint_size").alias("size"))
    return catalogue.backfill_fingerprints(all_.withColumns(empty), listing).select("project_id", "id", "fingerprint_mtime", "fingerprint_size", "d_hash")


@query(f"WITH {PHOTOS} SELECT id, CASE WHEN project_id <> 'click' THEN display_path END AS display_path, CASE WHEN project_id <> 'click' THEN display_edge END AS display_edge FROM photos")
def reset_display_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.reset_display(views.photos(spark, sf_dir), "click").select("id", "display_path", "display_edge")


@query(f"WITH {PHOTOS} SELECT project_id, count(*) AS n FROM photos WHERE project_id <> (SELECT min(event_type) FROM events) GROUP BY 1")
def deleted_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, photos = _projects(spark, sf_dir), views.photos(spark, sf_dir)
    left, rows = catalogue.delete_project(projects, projects.agg(F.min("id")).first()[0], photos)
    return rows.join(left.select(F.col("id").alias("project_id")), "project_id").groupBy("project_id").agg(F.count("*").alias("n"))


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("event_type").alias("id")).agg(F.max("event_id").alias("updated_at"), F.min("event_id").alias("created_at")).withColumn("name", F.upper("id"))


_PROJECT_ROWS = "projects AS (SELECT event_type AS id, max(event_id) AS updated_at, min(event_id) AS created_at, upper(event_type) AS name FROM events GROUP BY 1)"


@query(f"WITH {_PROJECT_ROWS} SELECT * FROM projects ORDER BY updated_at DESC, id")
def listed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.list_projects(_projects(spark, sf_dir))


@query(f"WITH {_PROJECT_ROWS} SELECT * FROM projects UNION ALL SELECT 'new' AS id, 7 AS updated_at, 7 AS created_at, 'New' AS name")
def created_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.create_project(_projects(spark, sf_dir), "new", "New", sf_dir, 7)


@query(f"WITH {PHOTOS} SELECT id, CAST(NULL AS INTEGER) AS added, rating FROM photos")
def added_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_columns(views.photos(spark, sf_dir).select("id", "rating"), {"added": "int", "rating": "string"})


@query(f"""WITH {PHOTOS} SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at NULLS LAST, relative_path, id) AS place FROM photos WHERE NOT is_missing AND (display_path IS NULL OR display_edge IS DISTINCT FROM 1024)""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.placed(pages.to_display(views.photos(spark, sf_dir), 1024), pages.CAPTURE_ORDER, "project_id").select("id", "place")


# Shapes of bursts.

_BLOCKS = f"""{_RUNS}, blocked AS (SELECT *, sum(CASE WHEN pos > 0 AND cut THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, run ORDER BY pos) AS block FROM runs)"""


@query(f"""WITH {_BLOCKS} SELECT project_id, run, CAST(block AS BIGINT) AS block, coalesce(arg_min(id, pos) FILTER (chosen), arg_min(id, pos)) AS representative, count(*) FILTER (CAST(id AS BIGINT) % 4 = 0) = 0 AS is_outside FROM blocked GROUP BY project_id, run, block""")
def block_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return shape.representatives(shape.blocks(runs), runs.where("rating >= 3"), runs.where(_number(F.col("id")) % 4 == 0))


@query(f"WITH {_RUNS} SELECT project_id, run, id, cut AND pos <> 6 AS joined, pos > 0 AS apart FROM runs")
def joined_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    apart = shape.cut_all(runs).select("project_id", "run", "id", F.col("cut").alias("apart"))
    return shape.join_at(runs, 6).select("project_id", "run", "id", F.col("cut").alias("joined")).join(apart, ["project_id", "run", "id"])


@query(f"""WITH {OVERRIDES}, wanted AS (SELECT project_id, id, captured_at, bits, CAST(id AS BIGINT) // 50 AS block, row_number() OVER (PARTITION BY project_id ORDER BY captured_at, relative_path, id) - 1 AS pos FROM usable WHERE CAST(id AS BIGINT) % 2 = 0),
paired AS (SELECT project_id, lag(id) OVER w AS left_id, id AS right_id, block = lag(block) OVER w AS joined, captured_at - lag(captured_at) OVER w <= 4000 AND bit_count(xor(bits, lag(bits) OVER w)) <= 24 AS raw FROM wanted WINDOW w AS (PARTITION BY project_id ORDER BY pos))
SELECT project_id, left_id, right_id, joined FROM overrides ANTI JOIN paired USING (project_id, left_id, right_id)
UNION ALL SELECT project_id, left_id, right_id, joined FROM paired WHERE left_id IS NOT NULL AND joined <> raw""")
def saved_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = views.adjacent(spark, sf_dir)
    rows = near.where(_number(F.col("id")) % 2 == 0).select("project_id", "id", "captured_at", "relative_path")
    wanted = curation.placed(rows, [(F.asc, c) for c in sequence.ORDER], "project_id").select("project_id", "id", (F.col("place") - 1).alias("pos"), F.floor(_number(F.col("id")) / 50).alias("block"))
    return shape.save_shape(views.overrides(near), near, wanted, 24)


@query(f"""WITH {_BLOCKS} SELECT project_id, pos, id FROM (SELECT *, count(*) OVER (PARTITION BY project_id, run, block) AS n FROM blocked) WHERE n = 1 AND rating_low""".replace("rating >= 3 AS chosen", "rating >= 3 AS chosen, rating < 3 AS rating_low"))
def released_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    return session.released(shape.blocks(runs), runs.where("rating < 3"))


_UPCOMING = f"""{PHOTOS}, listed AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS pos FROM photos WHERE CAST(id AS BIGINT) % 5 <> 0),
added AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY id) AS pos FROM photos WHERE CAST(id AS BIGINT) % 10 < 2),
fresh AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY pos, id) AS n FROM added WHERE CAST(id AS BIGINT) % 5 = 0)"""


@query(f"""WITH {_UPCOMING} SELECT project_id, CASE WHEN pos > 7 THEN pos + coalesce((SELECT count(*) FROM fresh f WHERE f.project_id = l.project_id), 0) ELSE pos END AS pos, id FROM listed l
UNION ALL SELECT project_id, 7 + n AS pos, id FROM fresh""")
def upcoming_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos, n = views.photos(spark, sf_dir).select("project_id", "id"), _number(F.col("id"))
    place = lambda rows: curation.placed(rows, [(F.asc, "id")], "project_id").select("project_id", F.col("place").alias("pos"), "id")
    current = photos.select("project_id").distinct().withColumn("last", F.lit(7))
    return session.upcoming(place(photos.where(n % 5 != 0)), current, place(photos.where(n % 10 < 2)))


# Exports.

_OUTCOME = "CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 'failed' WHEN CAST(id AS BIGINT) % 7 = 1 THEN 'skipped' ELSE 'processed' END"


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _number(F.col("id"))
    status = F.when(n % 7 == 0, "failed").when(n % 7 == 1, "skipped").otherwise("processed")
    return views.photos(spark, sf_dir).select("id", status.alias("status"), F.when(n % 7 == 0, F.concat(F.lit("no "), "id")).alias("error"))


@query(f"""WITH {PHOTOS}, outcomes AS (SELECT id, {_OUTCOME} AS status FROM photos)
SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
(SELECT string_agg('no ' || id, ',' ORDER BY id) FROM (SELECT id FROM outcomes WHERE status = 'failed' ORDER BY id LIMIT 20)) AS errors FROM outcomes""")
def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.report(_outcomes(spark, sf_dir)).withColumn("errors", F.array_join("errors", ","))


@query(f"WITH {PHOTOS} SELECT id, is_missing OR {_OUTCOME} = 'processed' AS is_missing FROM photos")
def after_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.after_move(views.photos(spark, sf_dir), _outcomes(spark, sf_dir)).select("id", "is_missing")


@query(f"WITH {PHOTOS} SELECT project_id, id FROM photos WHERE NOT is_missing AND rating >= 4 AND project_id = 'click'")
def writable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.writable(export.of_ratings(views.photos(spark, sf_dir), "click", [4, 5]).withColumn("name", F.upper("relative_path"))).select("project_id", "id")
