"""Override closure and the virtual-widened edge relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def override_closure(overrides: DataFrame) -> DataFrame:
    """Transitive (src, dst) of overrides; cycles end. The closure doubles its paths in each round."""
    closure = written(overrides.select("src", "dst").distinct(), "overrides")
    size = closure.count()
    while size:
        longer = closure.select("src", F.col("dst").alias("via")).join(closure.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        closure = written(closure.union(longer).distinct(), "overrides")
        before, size = size, closure.count()
        if size == before:
            break
    return closure


def overriders(overrides: DataFrame, names: DataFrame) -> DataFrame:
    """(name, by): every function that overrides a name, at any distance."""
    return override_closure(overrides).withColumnRenamed("dst", "name").join(names, "name", "left_semi").select("name", F.col("src").alias("by"))


def widened_edges(graph) -> DataFrame:
    """Distinct (src, dst): calls, and for each virtual call the functions that override its callee.

    Virtual calls of destructors are not widened unless the graph says so.
    """
    direct = graph.calls.select("src", "dst")
    if graph.overrides.isEmpty():
        return direct.distinct()
    virtual = graph.calls.where("is_virtual").select("src", F.col("dst").alias("callee"))
    if not graph.traverse_virtual_dtors:
        from ..functions import is_destructor

        virtual = virtual.where(~is_destructor(F.col("callee")))
    closure = override_closure(graph.overrides).select(F.col("dst").alias("callee"), F.col("src").alias("dst"))
    return direct.union(virtual.distinct().join(closure, "callee").select("src", "dst")).distinct()
