"""Post-dominators on an acyclic graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .iterate import longest_levels, reversed_edges


def post_dominators(exit_name: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, dom): for each ancestor of the exit, itself and what lies on all its paths to the exit.

    Ancestors are settled level by level, by their longest distance from the
    exit: a node's dominators are those that all its callees among the
    ancestors have, found by counting, so nothing is collected.
    """
    levels = written(longest_levels(exit_name, reversed_edges(edges)), "levels")
    top = levels.agg(F.max("level")).first()[0] or 0
    inner = edges.join(levels.select(F.col("name").alias("src"), "level"), "src").join(levels.select(F.col("name").alias("dst")), "dst", "left_semi")
    inner = written(inner.join(inner.groupBy("src").agg(F.count("*").alias("callees")), "src"), "inner")
    found = [written(exit_name.select("name", F.col("name").alias("dom")), "doms")]
    for level in range(1, top + 1):
        done = reduce(DataFrame.union, found).withColumnRenamed("name", "dst")
        own = inner.where(F.col("level") == level)
        shared = own.join(done, "dst").groupBy("src", "dom", "callees").agg(F.count("*").alias("n")).where("n = callees").select(F.col("src").alias("name"), "dom")
        selves = levels.where(F.col("level") == level).select("name", F.col("name").alias("dom"))
        found.append(written(shared.union(selves), "doms"))
    return reduce(DataFrame.union, found)
