"""Filter files: function names with flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import merge_flags

#: The tokens around the names of a region filter.
HEADER = ["SCOREP_REGION_NAMES_BEGIN", "EXCLUDE", "*", "INCLUDE", "MANGLED"]
FOOTER = "SCOREP_REGION_NAMES_END"


class FilterError(ValueError):
    pass


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, flags): each line is a name with flag 1."""
    return merge_flags(spark.read.text(path).where("value <> ''").select(F.col("value").alias("name"), F.lit(1).alias("flags")))


def read_region_filter(spark: SparkSession, path: str) -> DataFrame:
    """(name, flags): the names between header and footer, with flag 1; a file without either is an error."""
    tokens = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))
    bad = tokens.where((F.slice("t", 1, len(HEADER)) != F.array(*map(F.lit, HEADER))) | (F.array_position("t", FOOTER) == 0))
    if tokens.isEmpty() or not bad.isEmpty():
        raise FilterError(f"not a region filter: {path}")
    names = tokens.select(F.explode(F.expr(f"slice(t, {len(HEADER) + 1}, cast(array_position(t, '{FOOTER}') as int) - {len(HEADER) + 1})")).alias("name"))
    return merge_flags(names.withColumn("flags", F.lit(1)))


def read_json_filter(spark: SparkSession, path: str) -> DataFrame:
    """(name, flags) of a JSON filter; flags of a name that occurs more than once are combined."""
    documents = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<selection:map<string,struct<flags:int>>>").alias("d"))
    if documents.isEmpty() or not documents.where("d is null or d.selection is null").isEmpty():
        raise FilterError(f"not a JSON filter: {path}")
    return merge_flags(documents.select(F.explode("d.selection").alias("name", "s")).select("name", F.coalesce("s.flags", F.lit(0)).alias("flags")))
