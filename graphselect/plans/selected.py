"""A set of functions that is not computed yet: a predicate over a base.

Filters and set operations over the same base stay predicates, so a query of
them is one scan of the functions table; only different bases need a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sets


class Selected:
    def __init__(self, graph, base: DataFrame | None = None, predicate: Column | None = None):
        """base: names, or None for every function; predicate: a Column of the functions table that is never null."""
        self.graph, self.base, self.predicate = graph, base, predicate

    def where(self, predicate: Column) -> Selected:
        return Selected(self.graph, self.base, predicate if self.predicate is None else self.predicate & predicate)

    @property
    def names(self) -> DataFrame:
        if self.base is not None and self.predicate is None:
            return self.base
        rows = self.graph.functions if self.base is None else self.graph.functions.join(self.base, "name", "left_semi")
        return (rows if self.predicate is None else rows.where(self.predicate)).select("name")

    def _combine(self, other: Selected, on_predicates, on_sets) -> Selected:
        if self.base is other.base:
            a, b = (F.lit(True) if x.predicate is None else x.predicate for x in (self, other))
            return Selected(self.graph, self.base, on_predicates(a, b))
        return Selected(self.graph, on_sets(self.names, other.names))

    def union(self, other: Selected) -> Selected:
        return self._combine(other, lambda a, b: a | b, sets.union)

    def intersect(self, other: Selected) -> Selected:
        return self._combine(other, lambda a, b: a & b, sets.intersect)

    def subtract(self, other: Selected) -> Selected:
        return self._combine(other, lambda a, b: a & ~b, sets.subtract)
