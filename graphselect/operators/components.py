"""Strongly connected components, their condensation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .iterate import reversed_edges, union_all


#: Steps that a round takes before it is written: rounds cost more than steps.
HOPS = 4


def least_labels(edges: DataFrame) -> DataFrame:
    """(name, label): for each end of edges the least name among those that reach it, itself included.

    A round passes labels on for some steps; then each name takes over what its
    label had for a label before the round, which reaches it too.  So a label
    need not walk a long path: the part of a path that a label stands for grows
    by a factor each round.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    best = written(ends.select("name", F.col("name").alias("label"), F.lit(True).alias("fresh")), "labels")
    while not best.where("fresh").isEmpty():
        wave, offers = best.where("fresh").select("name", "label"), []
        for _ in range(HOPS):
            wave = wave.select(F.col("name").alias("src"), "label").join(edges, "src").groupBy(F.col("dst").alias("name")).agg(F.min("label").alias("label"))
            wave = wave.join(best.select("name", F.col("label").alias("was")), "name").where("label < was").select("name", "label")
            offers.append(wave)
        least = union_all(offers).groupBy("name").agg(F.min("label").alias("offer"))
        at = best.join(least, "name", "left").select("name", F.least("label", "offer").alias("label"), F.col("label").alias("was"))
        # Names that have a lower label than their own: what they label takes it over.
        lower = best.where("label < name").select(F.col("name").alias("label"), F.col("label").alias("further"))
        jumped = at.join(lower, "label", "left").select("name", F.least("label", "further").alias("label"), "was")
        best = written(jumped.select("name", "label", (F.col("label") < F.col("was")).alias("fresh")), "labels")
    return best.select("name", "label")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that start where none ends or end where none starts, again and again while it pays."""
    size = edges.count()
    while size:
        ends = edges.select(F.col("dst").alias("src")).distinct()
        starts = edges.select(F.col("src").alias("dst")).distinct()
        edges = written(edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst"), "trimmed")
        before, size = size, edges.count()
        if size > 0.8 * before:
            break
    return edges


def strongly_connected(names: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, scc): the least name of the strongly connected component.

    Most of a call graph is in no cycle, and goes by trimming.  What is left is
    labelled with the least name that reaches it, and then, against the edges
    that stay within a label, with the least name that it reaches there.  Names
    of which both labels are the same are that name's component; of the rest,
    edges stay whose ends agree in both.  All labels are settled at once, in
    each round.
    """
    rest = _trimmed(written(edges.where("src <> dst").select("src", "dst").distinct(), "rest"))
    found: list[DataFrame] = []
    while not rest.isEmpty():
        down = least_labels(rest)
        within = written(_agreeing(rest, down), "within")
        up = least_labels(reversed_edges(within))
        # A name without an edge within its label is a component if it labels itself.
        both = written(down.join(up.withColumnRenamed("label", "back"), "name", "left").withColumn("back", F.coalesce("back", "name")), "both")
        found.append(both.where("label = back").select("name", "label"))
        open_ = both.where("label <> back").select("name", F.col("back").alias("label"))
        rest = _trimmed(written(_agreeing(within, open_), "rest"))
    names = names.select("name").distinct()
    if not found:
        return names.withColumn("scc", F.col("name"))
    every = union_all(found)
    return names.join(every, "name", "left").select("name", F.coalesce("label", F.col("name")).alias("scc"))


def _agreeing(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges whose ends both have a label(name, label), and the same."""
    source = labels.select(F.col("name").alias("src"), F.col("label").alias("at"))
    target = labels.select(F.col("name").alias("dst"), F.col("label").alias("to"))
    return edges.join(source, "src").join(target, "dst").where(F.col("at") == F.col("to")).select("src", "dst")


def condensed(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Distinct (src, dst) between components."""
    a = scc.select(F.col("name").alias("src"), F.col("scc").alias("from_scc"))
    b = scc.select(F.col("name").alias("dst"), F.col("scc").alias("to_scc"))
    return edges.join(a, "src").join(b, "dst").where("from_scc <> to_scc").select(F.col("from_scc").alias("src"), F.col("to_scc").alias("dst")).distinct()


def scc_sizes(scc: DataFrame) -> DataFrame:
    return scc.groupBy("scc").agg(F.count("*").alias("size"))


def scc_stats(scc: DataFrame) -> DataFrame:
    """One row: components, the largest one's size, and how many have more than one and more than two members."""
    return scc_sizes(scc).agg(
        F.count("*").alias("n_scc"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"),
        F.count_if(F.col("size") > 1).alias("larger_than_1"),
        F.count_if(F.col("size") > 2).alias("larger_than_2"),
    )
