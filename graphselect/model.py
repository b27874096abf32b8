"""The call graph as three tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import is_destructor
from .tables import written

FUNCTIONS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("known", T.BooleanType()),
        T.StructField("demangled_name", T.StringType()),
        T.StructField("parameters", T.ArrayType(T.StringType())),
        T.StructField("is_virtual", T.BooleanType()),
        T.StructField("contains_pointer_call", T.BooleanType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("in_system_header", T.BooleanType()),
        T.StructField("is_inlined", T.BooleanType()),
        T.StructField("is_destructor", T.BooleanType()),
        T.StructField("meta", T.StringType()),
    ]
)


def _defaults() -> dict[str, Column]:
    """Columns of a function that only occurs as the end of a call or an override."""
    no, text = F.lit(False), F.lit("")
    return {"demangled_name": text, "parameters": F.array().cast("array<string>"), "is_virtual": no, "contains_pointer_call": no, "file_name": text, "in_system_header": no, "is_inlined": no, "meta": F.lit(None).cast("string")}


class CallGraph:
    """functions(FUNCTIONS), calls(src, dst, is_virtual), overrides(src, dst); src overrides dst.

    Calls keep their multiplicity.  Derived tables are computed once, on demand.
    """

    def __init__(self, functions: DataFrame, calls: DataFrame, overrides: DataFrame, traverse_virtual_dtors: bool = False):
        self.functions, self.calls, self.overrides = functions, calls, overrides
        self.traverse_virtual_dtors = traverse_virtual_dtors

    @classmethod
    def build(cls, declared: DataFrame, calls: DataFrame, overrides: DataFrame, traverse_virtual_dtors: bool = False, unique: bool = False) -> CallGraph:
        """Tables from declared functions (any subset of FUNCTIONS' columns, with name); ends that are not declared get default rows.

        A function that is declared more than once, as in documents of several
        files, is one: a flag is set if any declaration sets it, and of other
        values the greatest is kept. unique: names don't repeat, so nothing is merged.
        """
        calls = calls.select("src", "dst", F.coalesce("is_virtual", F.lit(False)).alias("is_virtual"))
        ends = calls.select(F.explode(F.array("src", "dst")).alias("name")).union(overrides.select(F.explode(F.array("src", "dst")).alias("name"))).distinct()
        defaults, types = _defaults(), {f.name: f.dataType for f in FUNCTIONS}
        columns = [(F.coalesce(F.col(c).cast(types[c]), d) if c in declared.columns else d).alias(c) for c, d in defaults.items()]
        known = declared.select("name", F.lit(True).alias("known"), *columns)
        if not unique:
            known = known.groupBy("name").agg(*(F.max(c).alias(c) for c in known.columns if c != "name"))
        unknown = ends.join(known.select("name"), "name", "left_anti").select("name", F.lit(False).alias("known"), *(d.alias(c) for c, d in defaults.items()))
        every = known.unionByName(unknown).withColumn("is_destructor", is_destructor(F.col("name"))).select(*FUNCTIONS.names)
        return cls(every, calls, overrides.select("src", "dst"), traverse_virtual_dtors)

    @cached_property
    def names(self) -> DataFrame:
        return written(self.functions.select("name"), "names")

    @cached_property
    def direct_edges(self) -> DataFrame:
        """(src, dst): direct calls, without repetition."""
        return written(self.calls.select("src", "dst").distinct(), "direct")

    @cached_property
    def all_edges(self) -> DataFrame:
        """(src, dst): direct calls, and virtual calls widened to every function that overrides the callee."""
        from .operators.virtual import widened_edges

        return written(widened_edges(self), "edges")

    @cached_property
    def scc(self) -> DataFrame:
        """(name, scc): strongly connected components of all_edges; scc is the least name of the component."""
        from .operators.components import strongly_connected

        return written(strongly_connected(self.names, self.all_edges), "scc")

    @cached_property
    def scc_edges(self) -> DataFrame:
        """(src, dst) between components, without repetition and self edges."""
        from .operators.components import condensed

        return written(condensed(self.all_edges, self.scc), "scc-edges")

    def without_calls(self, gone: DataFrame) -> CallGraph:
        """The graph without the calls in gone(src, dst)."""
        return CallGraph(self.functions, self.calls.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), self.overrides, self.traverse_virtual_dtors)

    def without_overrides(self, gone: DataFrame) -> CallGraph:
        """The graph without the override relations in gone(src, dst)."""
        return CallGraph(self.functions, self.calls, self.overrides.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), self.traverse_virtual_dtors)
