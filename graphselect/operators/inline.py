"""Inline compensation: functions without a symbol are replaced by their nearest callers that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import reach


def with_symbol(names: DataFrame, symbols: DataFrame) -> DataFrame:
    return names.join(symbols.select("name"), "name", "left_semi")


def without_symbol(names: DataFrame, symbols: DataFrame) -> DataFrame:
    return names.join(symbols.select("name"), "name", "left_anti")


def replace_inlined(graph, names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name): of names those with a symbol, and for the others the first callers upward that have one."""
    symbols = symbols.select("name").distinct()
    names = names.select("name").distinct()
    up = graph.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    hidden = up.join(symbols.withColumnRenamed("name", "dst"), "dst", "left_anti").select("src", "dst")
    closure = reach(without_symbol(names, symbols), hidden)
    callers = closure.withColumnRenamed("name", "src").join(up, "src").select(F.col("dst").alias("name"))
    return with_symbol(names, symbols).union(with_symbol(callers, symbols)).distinct()
