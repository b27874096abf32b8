"""Call graphs and traces derived from the test tables: inputs of the registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import CallGraph


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def layered(spark: SparkSession, sf_dir: str) -> CallGraph:
    """Graph L: region > nation > customer and supplier; customer > order > part; supplier > part (virtual). Parts override parts."""
    region, nation, customer, supplier, part, orders, lineitem = (_t(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))

    def declared(df, kind, key, shown, path, params=None, inlined=None, system=None, pointer=None, meta=None):
        no = F.lit(False)
        return df.select(
            _node(kind, key).alias("name"), shown.alias("demangled_name"), (params if params is not None else F.array().cast("array<string>")).alias("parameters"),
            path.alias("file_name"), (inlined if inlined is not None else no).alias("is_inlined"), (system if system is not None else no).alias("in_system_header"),
            (pointer if pointer is not None else no).alias("contains_pointer_call"), (meta if meta is not None else F.lit(None).cast("string")).alias("meta"),
        )

    slash = lambda a, b: F.concat(a, F.lit("/"), b)
    meta = F.to_json(F.struct(F.struct(F.col("p_size").alias("numberOfFloatOps"), (F.col("p_partkey") % 100).alias("numberOfMemoryAccesses")).alias("numOperations"), (F.col("p_size") % 4).alias("loopDepth")))
    functions = [
        declared(region, "region", "r_regionkey", F.col("r_name"), slash(F.lit("region"), F.col("r_name"))),
        declared(nation, "nation", "n_nationkey", F.col("n_name"), slash(F.lit("nation"), F.col("n_name"))),
        declared(customer, "cust", "c_custkey", F.col("c_name"), slash(F.lit("customer"), F.col("c_mktsegment"))),
        declared(supplier, "supp", "s_suppkey", F.col("s_name"), slash(F.lit("supplier"), F.col("s_nationkey").cast("string"))),
        declared(orders, "order", "o_orderkey", _node("order", "o_orderkey"), slash(F.lit("order"), F.col("o_orderpriority")), pointer=F.col("o_orderstatus") == "P"),
        declared(part, "part", "p_partkey", F.col("p_name"), slash(F.col("p_brand"), F.col("p_type")), F.array("p_brand", "p_type"), F.col("p_size") < 10, F.col("p_type") == "SMALL", meta=meta),
    ]
    edge = lambda df, a, b, virtual=False: df.select(a.alias("src"), b.alias("dst"), F.lit(virtual).alias("is_virtual")).distinct()
    calls = [
        edge(nation, _node("region", "n_regionkey"), _node("nation", "n_nationkey")),
        edge(customer, _node("nation", "c_nationkey"), _node("cust", "c_custkey")),
        edge(supplier, _node("nation", "s_nationkey"), _node("supp", "s_suppkey")),
        edge(orders, _node("cust", "o_custkey"), _node("order", "o_orderkey")),
        edge(lineitem, _node("order", "l_orderkey"), _node("part", "l_partkey")),
        edge(lineitem, _node("supp", "l_suppkey"), _node("part", "l_partkey"), True),
    ]
    k = F.col("p_partkey")
    target = F.when(k % 10 <= 4, k - k % 10).otherwise(k - 4)
    overrides = part.where(k % 10 != 0).select(_node("part", "p_partkey").alias("src"), F.concat(F.lit("part_"), target.cast("string")).alias("dst"))
    return CallGraph.build(reduce(DataFrame.unionByName, functions), reduce(DataFrame.union, calls), overrides, unique=True)


def cyclic(spark: SparkSession, sf_dir: str) -> CallGraph:
    """Graph C: parts that follow one another in urgent orders, returned lines only."""
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(_t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = lines.select("l_partkey", F.lead("l_partkey").over(order).alias("next")).where("next is not null").distinct()
    calls = pairs.select(_node("part", "l_partkey").alias("src"), _node("part", "next").alias("dst"), F.lit(False).alias("is_virtual"))
    nodes = calls.select(F.explode(F.array("src", "dst")).alias("name")).distinct().withColumn("demangled_name", F.col("name"))
    return CallGraph.build(nodes, calls, calls.select("src", "dst").limit(0), unique=True)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace E: (thread, seq, id, type, kind) of events; clicks and views enter, purchases exit."""
    events = _t(spark, sf_dir, "events")
    kind = F.col("event_type")
    type_ = F.when(kind.isin("click", "view", "signup"), "ENTRY").otherwise("EXIT")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("thread"), F.row_number().over(order).cast("long").alias("seq"), F.pmod("event_id", F.lit(50)).cast("int").alias("id"), type_.alias("type"), kind.alias("kind"))
