"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) joined back to
the edges, so a hub's edges are never gathered in one place: Spark may split
the hub's partition of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); component: smallest node.

    Self-links, repeated links and nulls are ignored; no links: no rows.
    """
    now = ws.write(edges.select("u", "v").where("u != v").distinct(), "edges")
    seen = None
    while True:
        step = ws.write(_small(_large(now)), "star")
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(now)
        now = step
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
