"""Learning a threshold from a few answers about pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.scalars import clamped_threshold
from framesift.schema import DEFAULT_THRESHOLD, MAX_THRESHOLD

#: Answers after which to stop, before which not to stop, and the width of the range that is narrow enough.
MOST_ANSWERS, FEWEST_ANSWERS, NARROW = 8, 5, 2
PAIR_ORDER = ("distance", "id")


def infer(answers: DataFrame, *by: str, fallback: int = DEFAULT_THRESHOLD, upper: int = MAX_THRESHOLD) -> DataFrame:
    """``threshold`` for each group of ``answers`` (distance, grouped).

    All together gives the upper end, all apart 0; else the middle of the thresholds with the fewest answers
    against them (grouped above, or separate at or below). Answers are counted by distance first, so the
    thresholds are compared with 65 rows a group at most.
    """
    errors = _counted(answers, *by).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(upper))))
    wrong = F.sum(F.when(F.col("distance") > F.col("t"), F.col("g")).otherwise(F.col("s")))
    matrix = errors.groupBy(*by, "t").agg(wrong.alias("errors"), F.sum("g").alias("all_g"), F.sum("s").alias("all_s"))
    least = F.min("errors").over(Window.partitionBy(*by))
    best = matrix.withColumn("least", least).where(F.col("errors") == F.col("least"))
    flat = best.groupBy(*by).agg(F.sort_array(F.collect_list("t")).alias("ts"), F.max("all_g").alias("g"), F.max("all_s").alias("s"))
    middle = F.element_at("ts", (F.floor(F.size("ts") / 2) + 1).cast("int"))
    value = F.when(F.col("g") + F.col("s") == 0, F.lit(fallback)).when(F.col("s") == 0, F.lit(upper)).when(F.col("g") == 0, F.lit(0)).otherwise(middle)
    return flat.select(*by, value.cast("int").alias("threshold"))


def _counted(answers: DataFrame, *by: str) -> DataFrame:
    """Answers by distance: ``g`` as grouped, ``s`` as separate; 65 rows a group at most."""
    return answers.groupBy(*by, F.col("distance").cast("int").alias("distance")).agg(F.count_if("grouped").alias("g"), F.count_if(~F.col("grouped")).alias("s"))


def error_matrix(answers: DataFrame, upper: int = MAX_THRESHOLD) -> DataFrame:
    """Answers against each threshold from 0 to ``upper``, counted by distance before thresholds are looked at."""
    rows = _counted(answers).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(upper))))
    return rows.groupBy("t").agg(F.sum(F.when(F.col("distance") > F.col("t"), F.col("g")).otherwise(F.col("s"))).alias("errors"))


def evidence(answers: DataFrame, *by: str) -> DataFrame:
    """The largest distance answered as grouped (-1 if none) and the smallest as separate (65 if none)."""
    return answers.groupBy(*by).agg(
        F.coalesce(F.max(F.when(F.col("grouped"), F.col("distance"))), F.lit(-1)).alias("grouped_up_to"),
        F.coalesce(F.min(F.when(~F.col("grouped"), F.col("distance"))), F.lit(65)).alias("separate_from"),
    )


def effective(explicit: Column, saved: Column) -> Column:
    """The threshold in use: the one asked for, else the saved one within range, else the default."""
    return F.coalesce(explicit.cast("int"), clamped_threshold(saved), F.lit(DEFAULT_THRESHOLD))


def save(projects: DataFrame, learned: DataFrame) -> DataFrame:
    """``projects`` with the thresholds of ``learned`` (id, threshold, at); a null threshold clears one."""
    new = learned.select("id", clamped_threshold(F.col("threshold")).alias("_t"), F.col("at").alias("_at"), F.lit(True).alias("_said"))
    rows = projects.join(new, "id", "left")
    pick = lambda new, old: F.when(F.col("_said"), F.col(new)).otherwise(F.col(old))
    at = F.when(F.col("_said"), F.when(F.col("_t").isNotNull(), F.col("_at"))).otherwise(F.col("burst_threshold_learned_at"))
    return rows.withColumn("burst_threshold_learned_at", at).withColumn("burst_threshold", pick("_t", "burst_threshold")).drop("_t", "_at", "_said")


def ranked_pairs(pairs: DataFrame, *by: str) -> DataFrame:
    """Pairs with ``i``, their place from 0 by distance and id."""
    from framesift.operators.curation import placed

    rows = placed(pairs, [(F.asc, c) for c in PAIR_ORDER], *by)
    return rows.withColumn("i", F.col("place") - 1).drop("place")


def used(asked: Column, skipped: Column) -> Column:
    """Pairs not to ask about again, in order."""
    return F.array_union(asked, skipped)


def next_question(ranked: DataFrame, asked: DataFrame, low: Column, high: Column) -> DataFrame:
    """The pair to ask about: the middle of the open range, or the nearest to it not asked yet, below before above."""
    middle = F.floor((low + high) / 2)
    open_ = ranked.join(asked.select("id"), "id", "left_anti").where(F.col("i").between(low, high))
    return open_.orderBy(F.abs(F.col("i") - middle), "i").limit(1)


def next_questions(ranked: DataFrame, asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pair to ask about in each project: project_id, id, distance, i. ``ranges`` has project_id, low and high; a project without a pair left has none."""
    rows = ranked.join(asked.select("project_id", "id"), ["project_id", "id"], "left_anti").join(ranges, "project_id").where(F.col("i").between(F.col("low"), F.col("high")))
    far = F.abs(F.col("i") - F.floor((F.col("low") + F.col("high")) / 2))
    return rows.groupBy("project_id").agg(F.min(F.struct(far.alias("far"), "i", "id", "distance")).alias("q")).select("project_id", "q.id", "q.distance", "q.i")


def answered(answers: Column, low: Column, high: Column) -> Column:
    """struct<low,high>: the open range after an ordered array of answers struct<i,grouped>; a null i only counts."""
    start = F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    def step(s: Column, a: Column) -> Column:
        known = a["i"].isNotNull()
        raised = F.when(known & a["grouped"], F.greatest(s["low"], a["i"] + 1)).otherwise(s["low"])
        lowered = F.when(known & ~a["grouped"], F.least(s["high"], a["i"] - 1)).otherwise(s["high"])
        return F.struct(raised.cast("bigint").alias("low"), lowered.cast("bigint").alias("high"))

    return F.aggregate(answers, start, step)


def should_stop(n_answers: Column, n_left: Column, grouped_up_to: Column, separate_from: Column) -> Column:
    """Eight answers, or no pair left; else not before five, and then once both sides are known within two."""
    narrow = (grouped_up_to >= 0) & (separate_from <= MAX_THRESHOLD) & (separate_from - grouped_up_to <= NARROW)
    return (n_answers >= MOST_ANSWERS) | (n_left <= 0) | ((n_answers >= FEWEST_ANSWERS) & narrow)


def question_progress(n_answers: Column) -> Column:
    """struct<asked,most>."""
    return F.struct(n_answers.cast("int").alias("asked"), F.lit(MOST_ANSWERS).alias("most"))
