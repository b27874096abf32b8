"""Dumps for people: the functions of a selector, and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dsl import bind, parse, preprocess
from ..dsl.ast import dump


def set_dump(selection, selector: str) -> DataFrame:
    """(line): the functions of one selector of a query's results, in order."""
    return selection.sets[selector].names.select(F.col("name").alias("line")).orderBy("line")


def query_dump(query: str, registry: dict) -> str:
    """The syntax tree and the selector graph of a query."""
    spec, hints = preprocess(parse(query))
    return dump(spec) + "\n\n" + bind(spec, hints, registry).dump()
