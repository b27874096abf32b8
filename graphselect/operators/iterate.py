"""The loops: reachability, distances, least cost.

Each round joins the frontier only (semi-naive) and is written to the shared
folder: plans stay short, a lost executor costs one round, and Spark broadcasts
a frontier when its file is small enough.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written

INFINITY = 2147483647


#: Steps of a loop that are kept as tables of their own; then they become one, so that plans stay short.
STEPS = 8


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def kept_short(parts: list[DataFrame]) -> list[DataFrame]:
    return parts if len(parts) <= STEPS else [written(union_all(parts), "steps")]


def reversed_edges(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if hasattr(edges, "written_to"):
        turned.written_to = edges.written_to
    return turned


def fixed(edges: DataFrame) -> DataFrame:
    """edges as a written table: a loop would compute a plan again in each round."""
    return edges if hasattr(edges, "written_to") else written(edges.select("src", "dst"), "edges")


def distances(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, depth): nodes that edges(src, dst) reach from seeds(name), and the fewest steps; seeds have 0."""
    edges = fixed(edges)
    frontier = written(seeds.select("name").distinct().withColumn("depth", F.lit(0)), "frontier")
    found, depth = [frontier], 0
    while not frontier.isEmpty():
        depth += 1
        ahead = frontier.select(F.col("name").alias("src")).join(edges, "src").select(F.col("dst").alias("name")).distinct()
        frontier = written(ahead.join(union_all(found).select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        found = kept_short([*found, frontier])
    return union_all(found)


def reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(name): seeds and all that edges reach from them."""
    return distances(seeds, edges).select("name")


def longest_levels(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, level): nodes of an acyclic graph that edges reach, and the most steps."""
    edges = fixed(edges)
    _check_acyclic(seeds, edges)
    frontier = written(seeds.select("name").distinct(), "frontier")
    found, level = [], 0
    while not frontier.isEmpty():
        found.append(frontier.withColumn("level", F.lit(level)))
        level += 1
        frontier = written(frontier.select(F.col("name").alias("src")).join(edges, "src").select(F.col("dst").alias("name")).distinct(), "frontier")
    if not found:
        return frontier.withColumn("level", F.lit(0))
    return union_all(found).groupBy("name").agg(F.max("level").alias("level"))


def _check_acyclic(seeds: DataFrame, edges: DataFrame) -> None:
    """Take nodes without callers away, again and again; what stays and is reached has a cycle among it."""
    left = edges.join(reach(seeds, edges).withColumnRenamed("name", "src"), "src", "left_semi").select("src", "dst")
    left = written(left, "left")
    size = left.count()
    while size:
        left = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "left")
        before, size = size, left.count()
        if size == before:
            raise RecursionError("the graph has a cycle")


def least_cost(seed: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, cost): least sum of weights(name, weight) of the nodes on a path of edges from seed(name), the last node's own not counted.

    A node's weight is paid when a path goes on from it; seed costs 0.
    """
    priced = edges.join(weights.select(F.col("name").alias("src"), "weight"), "src").select("src", "dst", "weight")
    priced = written(priced, "priced")
    best = written(seed.select("name").distinct().select("name", F.lit(0).cast("long").alias("cost"), F.lit(True).alias("fresh")), "cost")
    while not (changed := best.where("fresh")).isEmpty():
        offers = changed.select(F.col("name").alias("src"), "cost").join(priced, "src").groupBy(F.col("dst").alias("name")).agg(F.min(F.col("cost") + F.col("weight")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer") < F.col("cost")))
        best = written(best.join(offers, "name", "full").select("name", F.least("cost", "offer").alias("cost"), better.alias("fresh")), "cost")
    return best.select("name", "cost")
