"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hailbook.llm.common import join_groups, staged


def _tag(column: str):
    return F.xxhash64(column)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = join_groups(both, least, "u", _tag("u"))
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = join_groups(down, least, "u", _tag("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), component being the least node; nodes are integers.

    Loops and repeated edges are allowed. Every round is written to the shared
    folder, so a lost executor costs one round.
    """
    now = staged(edges.filter("u != v").distinct(), "edges")
    state = None
    while True:
        check = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == state:
            break
        state = check
        now = staged(_small_star(_large_star(now)).filter("u != v").distinct(), "edges")
    found = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return found.union(found.select("component", "component")).distinct()
