"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a handful of grouped minima and equi-joins on the edge table alone; nothing is collected
but a row count and a checksum. The edges are written to the shared scratch folder after every round,
which cuts the lineage and lets a lost executor re-read them. Rounds grow with the logarithm of the
longest path; a hub's edges are summed map-side and its joins are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.scratch import drop_path, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``(u, v)`` edges; component is its smallest node."""
    spark = edges.sparkSession
    current, path = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        after, new_path = materialize(_small_star(_large_star(current)), "edges")
        drop_path(spark, path)
        current, path = after, new_path
        now = _signature(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
