"""Set algebra over DataFrames of one column, name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").union(b.select("name")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").intersect(b.select("name"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").distinct().join(b.select("name"), "name", "left_anti")


def merge_flags(*selections: DataFrame) -> DataFrame:
    """(name, flags): flags of all selections, combined bit by bit."""
    every = selections[0].select("name", "flags")
    for s in selections[1:]:
        every = every.union(s.select("name", "flags"))
    return every.groupBy("name").agg(F.expr("bit_or(flags)").cast("int").alias("flags"))


def remove_names(selection: DataFrame, names: DataFrame) -> DataFrame:
    return selection.join(names.select("name"), "name", "left_anti")


def flags_of(names: DataFrame, selection: DataFrame) -> DataFrame:
    """(name, flags) for each of names; 0 if it is not selected."""
    return names.join(merge_flags(selection), "name", "left").select("name", F.coalesce("flags", F.lit(0)).alias("flags"))
