"""Connected components by alternating large-star and small-star steps, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lonja.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, class) for every node of ``edges`` (u, v); class is the smallest node of its component.

    Every round is a minimum per node with map-side combining and a join of one row per node, so no
    node's neighbours are gathered. The edges are written each round. More than ``rounds`` rounds (each
    about halves the depth) raise an error.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = _mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = written(small.filter("u > v").distinct(), "edges")
        if (now := _mark(e)) == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return stars.unionByName(stars.select(F.col("class").alias("node"), "class").distinct())
