"""Call graphs from JSON documents and from Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CallGraph
from ..tables import written
from .demangle import with_demangled

#: Keys of the document format.
_DOCUMENT = "struct<_CG:map<string,struct<callees:array<string>,isVirtual:boolean,overrides:array<string>,meta:string>>>"
_META = "struct<containsPointerCall:boolean,isInlined:boolean,virtualCalls:array<string>,fileProperties:struct<origin:string,systemInclude:boolean>>"


class GraphError(ValueError):
    pass


def _entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(name, f) for each function of the documents at path; a document without a graph is an error.

    lines: each line that is not blank is a document, so that files split into tasks.
    """
    texts = spark.read.text(path, wholetext=not lines)
    documents = (texts.where("trim(value) <> ''") if lines else texts).select(F.from_json("value", _DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"))
    if documents.isEmpty() or not documents.where("d is null or d._CG is null").isEmpty():
        raise GraphError(f"no call graph in {path}")
    return documents.select(F.explode("d._CG").alias("name", "f"))


def read_call_graph(spark: SparkSession, path: str, demangled: DataFrame | None = None, traverse_virtual_dtors: bool = False, lines: bool = False) -> CallGraph:
    """The graph of JSON documents, or of lines that each hold one (lines).

    A document is one row of one task, so a large graph should come as lines
    of a few functions each, or as Parquet tables; parsed functions are written
    once, and a function that several documents declare is merged.

    demangled(name, full): demangled signatures; without it a demangler on the
    workers is asked.  Only callees, overrides and virtual calls make edges.
    Where metadata lacks virtual calls all calls are virtual; without metadata
    none is.
    """
    rows = written(_entries(spark, path, lines).select("name", "f.*"), "documents").withColumn("m", F.from_json("meta", _META))
    if demangled is not None:
        rows = rows.join(demangled.select("name", "full"), "name", "left")
    no, text = F.lit(False), F.col("full") if demangled is not None else None
    declared = with_demangled(rows, F.coalesce(text, F.col("name")) if text is not None else None).select(
        "name", "demangled_name", "parameters",
        F.coalesce("isVirtual", no).alias("is_virtual"),
        F.coalesce("m.containsPointerCall", no).alias("contains_pointer_call"),
        F.coalesce("m.fileProperties.origin", F.lit("")).alias("file_name"),
        F.coalesce("m.fileProperties.systemInclude", no).alias("in_system_header"),
        F.coalesce("m.isInlined", no).alias("is_inlined"),
        "meta",
    )
    virtual = F.when(F.col("meta").isNull(), no).when(F.col("m.virtualCalls").isNull(), F.lit(True)).otherwise(F.array_contains("m.virtualCalls", F.col("dst")))
    calls = rows.select(F.col("name").alias("src"), F.explode("callees").alias("dst"), "meta", "m").select("src", "dst", virtual.alias("is_virtual"))
    overrides = rows.select(F.col("name").alias("src"), F.explode("overrides").alias("dst"))
    return CallGraph.build(declared, calls, overrides, traverse_virtual_dtors)


def read_tables(spark: SparkSession, functions: str, calls: str, overrides: str, traverse_virtual_dtors: bool = False) -> CallGraph:
    """The graph of three Parquet tables."""
    return CallGraph.build(*(spark.read.parquet(p) for p in (functions, calls, overrides)), traverse_virtual_dtors)


def instrumented_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): functions whose metadata ask for instrumentation."""
    return _entries(spark, path).where(F.get_json_object("f.meta", "$.instrument") == "true").select("name")
