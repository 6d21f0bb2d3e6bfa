"""Connected components of an edge list by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import checkpointed

#: Edges that a task has at least, if there are as many.
EDGES = 20_000


def _lowest(edges: DataFrame, both: bool) -> tuple[DataFrame, DataFrame]:
    """(u, v) as neighbours (both ways, or towards smaller ones), and for each u the least of itself and its neighbours."""
    one = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else one
    return near, near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large(edges: DataFrame, parts: int) -> DataFrame:
    near, low = _lowest(edges, True)
    return near.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(parts).distinct().coalesce(parts)


def _small(edges: DataFrame, parts: int) -> DataFrame:
    near, low = _lowest(edges, False)
    moved = near.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
    return moved.unionByName(low.select("u", F.col("m").alias("v")).coalesce(parts)).filter("u <> v").distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (u, v); a component is named by its least node.

    Each round is written to the checkpoint folder and compared with the last by its count and a sum of hashes; the
    number of rounds grows with the logarithm of the longest chain. Tasks have about ``EDGES`` edges each, so that a round of
    few edges does not write files for every shuffle partition.
    """
    edges = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = max(1, -(-edges.count() // EDGES))
    edges, before = edges.coalesce(parts), None
    while True:
        edges = checkpointed(_small(_large(edges, parts), parts))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
