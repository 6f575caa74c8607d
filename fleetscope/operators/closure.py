"""Transitive closure of a relation, semi-naive: each round extends only the
pairs found in the round before, and keeps those not known yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace


def shortest_paths(edges: DataFrame, run: Workspace, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, depth, path) of all pairs of different nodes joined by
    a path: its fewest edges, and of the shortest paths the smallest node list
    in array order. Pairs of equal nodes are never entered, so cycles end by
    themselves. Rounds are as many as the longest shortest path; each is a
    table in the run folder, so a lost executor recomputes one round at most.
    A node with many edges is a hot join key of one round; adaptive execution
    splits it, and the minimum per pair is partial before its shuffle."""
    pair = [*keys, start, end]
    edges = run.table(edges.select(*pair).where(F.col(start) != F.col(end)).distinct(), "edges")
    back = edges.select(*keys, F.col(start).alias("_new"), F.col(end).alias(start))
    level = run.table(edges.select(*pair, F.lit(1).alias("depth"), F.array(start, end).alias("path")), "paths1")
    out, depth = level, 1
    while True:
        depth += 1
        longer = (level.join(back, on=[*keys, start], how="inner").where(F.col("_new") != F.col(end))
                  .select(*keys, F.col("_new").alias(start), end, F.concat(F.array("_new"), "path").alias("path"))
                  .groupBy(*pair).agg(F.min("path").alias("path"))
                  .join(out.select(*pair), on=pair, how="left_anti"))
        level = run.table(longer.select(*pair, F.lit(depth).alias("depth"), "path"), f"paths{depth}")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
