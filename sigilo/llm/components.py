"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, merged, scratch

MAX_ROUNDS = 60
#: Edges of a task. Rounds of few edges are done by few tasks, whatever the number of shuffle partitions.
EDGES = 500_000


def star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Every node's greater (large) or smaller (small) neighbours tied to its smallest neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # u is the greater end
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    if large:
        moved = near.join(merged(low), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        moved = near.join(merged(low), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(u, v)``, checkpointed; a root is its component's smallest node.

    Each round is written to the shared folder, so that a lost executor costs
    one round, and is deleted when the next is there. Only a count and a sum
    reach the driver.
    """
    with scratch(edges.sparkSession, "components") as keep:
        now = keep(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "0")
        seen, tasks = None, 1
        for n in range(1, MAX_ROUNDS + 1):
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                break
            seen, tasks = state, 1 + state[0] // EDGES
            now = keep(star(star(now.coalesce(tasks), True, tasks), False, tasks), str(n))
            keep.drop(str(n - 1))
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        roots = now.groupBy("u").agg(F.min("v").alias("root")).coalesce(tasks)
        return checkpointed(roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).coalesce(tasks))
