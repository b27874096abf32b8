"""Call paths, roots, depth and coarsening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compare
from .iterate import INFINITY, distances, reach, reversed_edges


def on_call_path_to(graph, names: DataFrame) -> DataFrame:
    """names and all their transitive callers."""
    return reach(names, reversed_edges(graph.all_edges))


def on_call_path_from(graph, names: DataFrame) -> DataFrame:
    """names and all their transitive callees."""
    return reach(names, graph.all_edges)


def roots(graph) -> DataFrame:
    """Functions without a direct caller."""
    return graph.names.join(graph.calls.select(F.col("dst").alias("name")), "name", "left_anti")


def caller_count(graph) -> DataFrame:
    """(name, callers): direct calls that end in a function, counted with repetition."""
    return graph.calls.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("callers"))


def min_call_depths(graph, names: DataFrame) -> DataFrame:
    """(name, depth): distance from the set's local roots over edges within the set; INFINITY if only cycles lead there."""
    inside = names.select("name").distinct()
    edges = graph.all_edges.join(inside.withColumnRenamed("name", "src"), "src", "left_semi").join(inside.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")
    starts = inside.join(edges.select(F.col("dst").alias("name")), "name", "left_anti")
    return inside.join(distances(starts, edges), "name", "left").select("name", F.coalesce("depth", F.lit(INFINITY)).alias("depth"))


def min_call_depth(graph, names: DataFrame, op: str, n: int) -> DataFrame:
    return min_call_depths(graph, names).where(compare(F.col("depth"), op, n)).select("name")


def coarse(graph, names: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """names without those whose one call comes from a function that has one call itself, or is in names.

    Functions in critical stay; functions that no root reaches go.  Calls are
    direct ones, counted with repetition.
    """
    inside = names.select("name").distinct()
    reached = reach(roots(graph), graph.direct_edges)
    single = graph.calls.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("caller")).where("n = 1").select(F.col("dst").alias("name"), "caller")
    if critical is not None:
        single = single.join(critical.select("name"), "name", "left_anti")
    one_call = graph.calls.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select(F.col("dst").alias("caller"))
    weak = one_call.union(inside.select(F.col("name").alias("caller"))).distinct()
    removed = single.join(weak, "caller", "left_semi").select("name")
    return inside.join(reached, "name", "left_semi").join(removed, "name", "left_anti")
