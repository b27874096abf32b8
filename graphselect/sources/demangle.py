"""Demangled names: from a demangler on the workers if there is one, and their normal form in SQL functions."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import without_return_type, without_templates

TOOLS = ("llvm-cxxfilt", "c++filt")


def demangler(tools: tuple[str, ...] = TOOLS):
    """A pandas UDF name -> demangled text; names stay as they are where no tool is found."""

    @F.pandas_udf("string")
    def demangled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = next((t for t in tools if shutil.which(t)), None)
        for names in batches:
            if tool is None or not names.str.startswith("_Z").any():
                yield names
                continue
            out = subprocess.run([tool], input="\n".join(names) + "\n", capture_output=True, text=True, check=True).stdout.split("\n")
            yield pd.Series(out[: len(names)], index=names.index)

    return demangled


def base_name(full: Column) -> Column:
    """The qualified name in a demangled signature: no parameters, no template arguments, no return type."""
    return without_return_type(without_templates(F.substring_index(full, "(", 1)))


def parameter_list(full: Column) -> Column:
    """Parameter types of a signature, split at outer commas.

    Nothing follows for a name without parentheses or with an empty list; a
    list that is empty but not the end of the text, as in `f() const`, is one
    empty parameter.
    """
    rest = F.regexp_extract(full, r"(?s)\A[^(]*\((.*)\z", 1)
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("over"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s, c):
        opens, closes = c.isin("<", "("), c.isin(">", ")")
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        ends = ~s["over"] & closes & (depth < 0)
        comma = ~s["over"] & (c == ",") & (s["depth"] == 0)
        closed = ends | comma
        return F.struct(
            F.when(s["over"], s["depth"]).otherwise(depth).alias("depth"),
            (s["over"] | ends).alias("over"),
            F.when(closed, F.lit("")).when(s["over"], s["part"]).otherwise(F.concat(s["part"], c)).alias("part"),
            F.when(closed, F.concat(s["parts"], F.array(F.regexp_replace(s["part"], r"\A ", "")))).otherwise(s["parts"]).alias("parts"),
        )

    return F.when(F.length(rest) > 1, F.aggregate(F.split(rest, ""), state, step, lambda s: s["parts"])).otherwise(F.array().cast("array<string>"))


def with_demangled(functions: DataFrame, full: Column | None = None) -> DataFrame:
    """functions(name, ...) with demangled_name and parameters; full: demangled signatures, else they come from a demangler."""
    text = full if full is not None else demangler()(F.col("name"))
    return functions.withColumn("_full", text).withColumns({"demangled_name": base_name(F.col("_full")), "parameters": parameter_list(F.col("_full"))}).drop("_full")
