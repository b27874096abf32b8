"""DOT drawings of a selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import accepted, dot_attributes


def dot_lines(graph, selection: DataFrame | None = None, colours: DataFrame | None = None) -> DataFrame:
    """(line): selected functions and the edges among them, virtual calls widened; all of them without a selection or with an empty one.

    colours(name, colour) fills nodes.
    """
    spark = graph.functions.sparkSession
    names, edges = graph.names, graph.all_edges
    if selection is not None and not selection.isEmpty():
        chosen = selection.where(accepted(F.col("flags"))).select("name")
        names = names.join(chosen, "name", "left_semi")
        edges = edges.join(chosen.withColumnRenamed("name", "src"), "src", "left_semi").join(chosen.withColumnRenamed("name", "dst"), "dst", "left_semi")

    def quoted(c: str):
        return F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))

    nodes = names.withColumn("colour", F.lit(None).cast("string")) if colours is None else names.join(colours.select("name", "colour"), "name", "left")
    label = F.when(F.col("colour").isNull(), dot_attributes({"label": F.col("name")})).otherwise(dot_attributes({"label": F.col("name"), "color": F.col("colour")}))
    rows = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quoted("name"), F.lit(" "), label).alias("line"))
    rows = rows.union(edges.select(F.lit(2), F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"))))
    ends = spark.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string")
    return ends.union(rows).orderBy("part", "line").select("line")
