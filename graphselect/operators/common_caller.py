"""Common callers of two functions, on the condensed call graph."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .iterate import INFINITY, least_cost, reach, reversed_edges
from .postdom import post_dominators

log = logging.getLogger(__name__)
MODES = ("all", "partial", "distinct")


@dataclass
class Analysis:
    """What the search knows before the distance limit applies; a and b are names, the tables speak of components."""

    a: str
    b: str
    scc_a: str
    scc_b: str
    ancestors: DataFrame  # name, of_a, of_b
    candidates: DataFrame  # name, cdist, partial, distinct


def _one(names: DataFrame, which: str) -> str | None:
    found = [r["name"] for r in names.select("name").distinct().orderBy("name").limit(2).collect()]
    if len(found) > 1:
        log.warning("common caller: %s has more than one function; %s is used", which, found[0])
    return found[0] if found else None


def analyse(graph, first: DataFrame, second: DataFrame) -> Analysis | None:
    """Common ancestors of one function of each set (the least name); None, with an error logged, if there is no such pair."""
    spark = graph.functions.sparkSession
    a, b = _one(first, "the first set"), _one(second, "the second set")
    if a is None or b is None:
        log.error("common caller: both sets need a function")
        return None
    places = {r["name"]: r["scc"] for r in graph.scc.where(F.col("name").isin(a, b)).collect()}
    scc_a, scc_b = places[a], places[b]
    if scc_a == scc_b:
        log.error("common caller: %s and %s are in one cycle", a, b)
        return None
    up = reversed_edges(graph.scc_edges)
    seed_a, seed_b = (spark.createDataFrame([(x,)], "name string") for x in (scc_a, scc_b))
    of_a, of_b = (reach(s, up).withColumn(c, F.lit(True)) for s, c in ((seed_a, "of_a"), (seed_b, "of_b")))
    ancestors = written(of_a.join(of_b, "name", "full").select("name", F.coalesce("of_a", F.lit(False)).alias("of_a"), F.coalesce("of_b", F.lit(False)).alias("of_b")), "ancestors")
    common = ancestors.where("of_a and of_b").select("name")
    # Edges among ancestors, with what their lower end reaches.
    lower = ancestors.select(F.col("name").alias("dst"), F.col("of_a").alias("dst_a"), F.col("of_b").alias("dst_b"))
    down = written(graph.scc_edges.join(ancestors.select(F.col("name").alias("src")), "src", "left_semi").join(lower, "dst"), "down")
    below = down.join(common.withColumnRenamed("name", "src"), "src", "left_semi").groupBy(F.col("src").alias("name")).agg(
        F.max(F.col("dst_a") & F.col("dst_b")).alias("above_common"),
        F.max(F.col("dst_a") & ~F.col("dst_b")).alias("only_a"),
        F.max(F.col("dst_b") & ~F.col("dst_a")).alias("only_b"),
    )
    no = F.lit(False)
    nodes = common.join(below, "name", "left").select("name", (~F.coalesce("above_common", no)).alias("lowest"), F.coalesce("only_a", no).alias("only_a"), F.coalesce("only_b", no).alias("only_b"))
    doms_a, doms_b = (post_dominators(s, down.where(c).select("src", "dst")).where("name <> dom") for s, c in ((seed_a, "dst_a"), (seed_b, "dst_b")))
    bound = doms_a.join(doms_b, ["name", "dom"]).select("name").distinct().withColumn("bound", F.lit(True))
    candidates = written(
        nodes.join(bound, "name", "left")
        .where(F.col("lowest") | F.col("bound").isNull())
        .select("name", (F.col("lowest") | F.col("only_a") | F.col("only_b")).alias("partial"), (F.col("lowest") | (F.col("only_a") & F.col("only_b"))).alias("distinct")),
        "candidates",
    )
    weights = ancestors.join(candidates.select("name", F.lit(1).alias("w")), "name", "left").select("name", F.coalesce("w", F.lit(0)).cast("long").alias("weight"))
    costs = [least_cost(s, reversed_edges(down.where(c)), weights).withColumnRenamed("cost", n) for s, c, n in ((seed_a, "dst_a", "cost_a"), (seed_b, "dst_b", "cost_b"))]
    measured = candidates.join(costs[0], "name").join(costs[1], "name").select("name", F.greatest("cost_a", "cost_b").alias("cdist"), "partial", "distinct")
    return Analysis(a, b, scc_a, scc_b, ancestors, written(measured, "measured"))


def common_caller(graph, first: DataFrame, second: DataFrame, limit: int = INFINITY, mode: str = "all") -> tuple[DataFrame, DataFrame]:
    """(selected names, trigger names): the two functions, the callers kept, and what lies between."""
    spark = graph.functions.sparkSession
    none = spark.createDataFrame([], "name string")
    found = analyse(graph, first, second)
    if found is None:
        return none, none
    kept = found.candidates.where(F.col("cdist") <= limit)
    if mode != "all":
        kept = kept.where(mode)
    kept = written(kept.select("name"), "kept")
    proper = found.ancestors.where((F.col("of_a") & (F.col("name") != found.scc_a)) | (F.col("of_b") & (F.col("name") != found.scc_b))).select("name")
    between = reach(kept, graph.scc_edges.join(proper.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst"))
    members = graph.scc.join(between.withColumnRenamed("name", "scc"), "scc", "left_semi").select("name")
    pair = spark.createDataFrame([(found.a,), (found.b,)], "name string")
    triggers = graph.scc.join(kept.withColumnRenamed("name", "scc"), "scc", "left_semi").select("name")
    return members.union(pair).distinct(), triggers


def lca_histogram(found: Analysis, buckets: int = 11) -> DataFrame:
    """(cdist, n_all, n_partial, n_distinct and their running sums): candidates by distance, the last bucket open."""
    spark = found.candidates.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("cdist"))
    counts = found.candidates.groupBy(F.least("cdist", F.lit(buckets - 1).cast("long")).alias("cdist")).agg(F.count("*").alias("n_all"), F.count_if("partial").alias("n_partial"), F.count_if("distinct").alias("n_distinct"))
    filled = every.join(counts, "cdist", "left").na.fill(0)
    from pyspark.sql import Window

    # A window over `buckets` rows.
    running = Window.orderBy("cdist").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("cdist", "n_all", "n_partial", "n_distinct", *(F.sum(c).over(running).alias(f"up_to_{c[2:]}") for c in ("n_all", "n_partial", "n_distinct")))


def reachable_subgraph(found: Analysis) -> DataFrame:
    """(name, colour) of the ancestors of both functions: red above the first only, blue above the second only, green above both."""
    return found.ancestors.select("name", F.when(F.col("of_a") & F.col("of_b"), "green").when(F.col("of_a"), "red").otherwise("blue").alias("colour"))
