"""Connected components by repeated contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame) -> DataFrame:
    """links(u long, v long) -> (node, root): one row for each node of a link; nodes of a component share their root.

    In each round every node joins the neighbour (or itself) that is first in
    an order drawn anew, and links are renamed to the nodes joined; a link
    within one node goes.  The number of nodes falls by a constant factor in
    expectation, whatever the shape.  Each round is written to the shared
    folder, so lineage stays short and lost executors cost one round.  Hubs are
    met by partial aggregation (choice) and by joins that Spark may split
    (renaming).  Null ends and self links are ignored.
    """
    at = common.written(links.select("u", "v").where("u <> v").distinct(), "links")
    levels: list[DataFrame] = []
    rounds = 0
    while not at.isEmpty():
        rounds += 1
        both = at.union(at.select("v", "u"))
        turn = F.xxhash64("v", F.lit(rounds))
        first = both.groupBy("u").agg(F.min(F.struct(turn.alias("turn"), F.col("v"))).alias("best"))
        own = F.struct(F.xxhash64("u", F.lit(rounds)).alias("turn"), F.col("u").alias("v"))
        joined = common.written(first.select(F.col("u").alias("node"), F.least("best", own)["v"].alias("into")), "joined")
        levels.append(joined)
        left = joined.select(F.col("node").alias("u"), F.col("into").alias("iu"))
        right = joined.select(F.col("node").alias("v"), F.col("into").alias("iv"))
        at = common.written(at.join(left, "u").join(right, "v").where("iu <> iv").select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v")).distinct(), "links")
    if not levels:
        return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels.pop().select("node", F.col("into").alias("root"))
    while levels:
        later = found.select(F.col("node").alias("into"), "root")
        found = common.written(levels.pop().join(later, "into", "left").select("node", F.coalesce("root", "into").alias("root")), "roots")
    return found
