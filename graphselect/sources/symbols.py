"""Symbols, dependencies and memory maps from captured tool output.

Texts are DataFrames of one column, value, such as spark.read.text gives.
"""

from __future__ import annotations

import logging
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hex_to_long

log = logging.getLogger(__name__)


def parse_symbols(lines: DataFrame, binary: str) -> DataFrame:
    """(binary, addr, name) from a listing of defined symbols; of names with one address the greatest is kept."""
    parts = lines.select(F.regexp_extract("value", r"^(0[0-9a-fA-F]*)\s+\S+\s+(\S+)", 1).alias("addr"), F.regexp_extract("value", r"^(0[0-9a-fA-F]*)\s+\S+\s+(\S+)", 2).alias("name")).where("addr <> ''")
    return parts.groupBy(hex_to_long(F.col("addr")).alias("addr")).agg(F.max("name").alias("name")).select(F.lit(binary).alias("binary"), "addr", "name")


def parse_dependencies(lines: DataFrame) -> DataFrame:
    """(path): shared objects in lines `name => path`."""
    return lines.select(F.regexp_extract("value", r"^\s*\S+\s+=>\s+(\S+)", 1).alias("path")).where("path <> ''")


def symbol_sets(tables: dict[str, DataFrame], executable: str) -> DataFrame | None:
    """(binary, name) of an executable and its shared objects; None if the executable has no symbols."""
    own = tables.get(executable)
    if own is None or own.isEmpty():
        return None
    found = own.select("binary", "name")
    for name, t in tables.items():
        if name != executable:
            found = found.unionByName(t.select("binary", "name"))
    return found.distinct()


def _listing(spark: SparkSession, *command: str) -> DataFrame:
    """(value): lines that a tool prints on the driver; none if it can't be run. The environment's LD_PRELOAD is left out."""
    env = {k: v for k, v in os.environ.items() if k != "LD_PRELOAD"}
    try:
        text = subprocess.run(command, capture_output=True, env=env, check=False).stdout.decode(errors="replace")
    except OSError as e:
        log.error("%s can't be run: %s", command[0], e)
        text = ""
    return spark.createDataFrame([(line,) for line in text.splitlines()], "value string")


def binary_symbols(spark: SparkSession, executable: str) -> DataFrame | None:
    """(name): symbols of an executable and its shared objects, as nm and ldd of the driver list them; None if the executable has none."""

    def table(binary: str) -> DataFrame:
        dynamic = ["-D"] if ".so" in os.path.basename(binary) else []
        return parse_symbols(_listing(spark, "nm", "--defined-only", *dynamic, binary), binary)

    # A program has tens of libraries: their paths are few.
    libraries = [r["path"] for r in parse_dependencies(_listing(spark, "ldd", executable)).collect()]
    found = symbol_sets({executable: table(executable), **{p: table(p) for p in libraries if p != executable}}, executable)
    return None if found is None else found.select("name").distinct()


def parse_memory_map(lines: DataFrame) -> DataFrame:
    """(path, addr_begin, offset) of executable mappings of files."""
    pattern = r"^([0-9a-f]+)-[0-9a-f]+\s+r-xp\s+([0-9a-f]+)\s+\S+\s+\S+\s+(\S+)"
    parts = lines.select(*(F.regexp_extract("value", pattern, k).alias(c) for k, c in ((1, "begin"), (2, "off"), (3, "path"))))
    return parts.where("path <> '' and path not like '[%'").select("path", hex_to_long(F.col("begin")).alias("addr_begin"), hex_to_long(F.col("off")).alias("offset"))


def mapped_symbols(mappings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, addr_begin, offset, addr, name): the symbols of each mapped binary."""
    return mappings.join(symbols.withColumnRenamed("binary", "path"), "path")


def id_map(rows: DataFrame) -> DataFrame:
    """One row for each function id of an object: (obj_id, fid, ...); the least by all columns where there are more."""
    rest = [c for c in rows.columns if c not in ("obj_id", "fid")]
    return rows.groupBy("obj_id", "fid").agg(F.min(F.struct(*rest)).alias("r")).select("obj_id", "fid", *(F.col(f"r.{c}").alias(c) for c in rest))
