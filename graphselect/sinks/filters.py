"""Filter files; a selection is (name, flags)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ALWAYS, has_flag
from ..sources.filters import FOOTER


def default_path(graph_path: str) -> str:
    return os.path.splitext(graph_path)[0] + ".filt"


def name_list(selection: DataFrame) -> DataFrame:
    """(line): names that are always instrumented, in order."""
    return selection.where(has_flag(F.col("flags"), ALWAYS)).select(F.col("name").alias("line")).orderBy("line")


def region_filter(selection: DataFrame) -> DataFrame:
    """(line): the same names between a header and a footer."""
    spark = selection.sparkSession
    ends = spark.createDataFrame([(0, 0, "SCOREP_REGION_NAMES_BEGIN"), (0, 1, "EXCLUDE *"), (0, 2, "INCLUDE MANGLED"), (2, 0, FOOTER)], "part int, k int, line string")
    names = name_list(selection).select(F.lit(1).alias("part"), F.lit(0).alias("k"), "line")
    return ends.union(names).orderBy("part", "k", "line").select("line")


def json_filter(selection: DataFrame) -> DataFrame:
    """(line): all names with their flags, one entry on a line, so that no row holds them all."""
    spark = selection.sparkSession
    entry = F.to_json(F.map_from_arrays(F.array("name"), F.array(F.struct("flags"))))
    entries = selection.withColumn("e", entry).select("name", F.expr("substring(e, 2, length(e) - 2)").alias("line"))
    first = entries.agg(F.min("name").alias("first"))
    rows = entries.join(F.broadcast(first), F.col("name") == F.col("first"), "left").select(F.lit(1).alias("part"), "name", F.concat(F.when(F.col("first").isNull(), ",").otherwise(""), "line").alias("line"))
    ends = spark.createDataFrame([(0, "", '{"selection":{'), (2, "", "}}")], "part int, name string, line string")
    return ends.union(rows).orderBy("part", "name").select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """One local file, line by line through the driver, for tools that read one file; use lines.write.text for a folder."""
    with open(path, "w") as f:
        for row in lines.toLocalIterator():
            f.write(row["line"] + "\n")
