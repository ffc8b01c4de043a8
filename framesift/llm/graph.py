"""Connected components of a graph that is held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import join_facts, saved


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``links`` that has a partner.

    Alternates large-star and small-star steps until the edges are stars around the least nodes. Each step is an
    aggregate and a join by node; a hub is summed before the shuffle, and its edges stay where they are in the join.
    Every step is written, so a lost executor costs one step. Loops and repeated links are harmless, links
    with a null end are ignored, and an empty table gives an empty result.
    """
    ends = links.where((F.col(a) != F.col(b)))
    edges = saved(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))).select("u", F.least("u", "m").alias("m"), "n")
        large = saved(join_facts(both, least, "u", 2 * state[0]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        root = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        others = join_facts(large, root, "u", large.count()).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(others.union(root.select("u", "m")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
