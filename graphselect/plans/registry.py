"""Registry of selectors; user code adds its own with the same decorators."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import COMPARISONS, compare, full_match, java_pattern, metric
from ..operators import common_caller as callers
from ..operators import paths
from ..operators.iterate import INFINITY
from .selected import Selected

log = logging.getLogger(__name__)


@dataclass
class Context:
    """What a selector may use and leave: the graph, and functions that become scope triggers."""

    graph: object
    triggers: list[DataFrame] = field(default_factory=list)

    def empty(self) -> Selected:
        return Selected(self.graph, self.graph.names.limit(0))


#: type -> factory(literals) -> (context, inputs) -> Selected. The last registration of a name wins.
REGISTRY: dict[str, Callable] = {}


def selector(name: str, inputs: int | tuple[int, ...]):
    """Register factory(literals), which checks them (ValueError) and returns run(context, *inputs) -> Selected.

    With another number of inputs the selector logs an error and selects nothing.
    """
    allowed = (inputs,) if isinstance(inputs, int) else inputs

    def register(factory: Callable) -> Callable:
        def build(literals: list) -> Callable:
            run = factory(literals)

            def checked(context: Context, given: list[Selected]) -> Selected:
                if len(given) not in allowed:
                    log.error("%s takes %s inputs, not %d", name, " or ".join(map(str, allowed)), len(given))
                    return context.empty()
                return run(context, *given)

            return checked

        REGISTRY[name] = build
        return factory

    return register


def filter_selector(name: str):
    """Register factory(literals) that returns a Column over the functions table; such selectors fuse into one predicate."""

    def register(factory: Callable[[list], Column]) -> Callable:
        def build(literals: list):
            predicate = F.coalesce(factory(literals), F.lit(False))
            return lambda context, given: given.where(predicate)

        selector(name, 1)(build)
        return factory

    return register


def _no_params(literals: list) -> None:
    if literals:
        raise ValueError("no parameters are expected")


@filter_selector("by_name")
def by_name(literals: list) -> Column:
    """Full match of the demangled name, or with @ of the name; more patterns match the parameters one by one, "()" none."""
    if not literals or not all(isinstance(x, str) for x in literals):
        raise ValueError("patterns are expected")
    pattern, *params = literals
    for p in params:
        if p != "()":
            java_pattern(p)
    if pattern.startswith("@"):
        if params:
            raise ValueError("a name with @ takes no parameter patterns")
        return full_match(F.col("name"), pattern[1:])
    matched = full_match(F.col("demangled_name"), pattern)
    if "()" in params:
        return matched & (F.size("parameters") == 0)
    if params:
        matched = matched & (F.size("parameters") == len(params))
        for k, p in enumerate(params):
            matched = matched & full_match(F.get("parameters", F.lit(k)), p)
    return matched


@filter_selector("by_path")
def by_path(literals: list) -> Column:
    if len(literals) != 1 or not isinstance(literals[0], str):
        raise ValueError("one pattern is expected")
    return full_match(F.col("file_name"), literals[0])


def _flag(name: str, column: str) -> None:
    @filter_selector(name)
    def factory(literals: list) -> Column:
        _no_params(literals)
        return F.col(column)


for _name, _column in (("inline_specified", "is_inlined"), ("in_system_header", "in_system_header"), ("contains_unresolved_calls", "contains_pointer_call")):
    _flag(_name, _column)

#: Where the metrics stand in a function's metadata.
METRICS = {"flops": "numOperations.numberOfFloatOps", "memops": "numOperations.numberOfMemoryAccesses", "loop_depth": "loopDepth"}


def _comparison(literals: list) -> tuple[str, int]:
    if len(literals) != 2 or not isinstance(literals[0], str) or not isinstance(literals[1], int) or isinstance(literals[1], bool):
        raise ValueError("an operator and an integer are expected")
    if literals[0] not in COMPARISONS:
        raise ValueError(f"unknown comparison {literals[0]!r}")
    return literals[0], literals[1]


def _metric(name: str, path: str) -> None:
    @filter_selector(name)
    def factory(literals: list) -> Column:
        return compare(metric(F.col("meta"), path), *_comparison(literals))


for _name, _path in METRICS.items():
    _metric(_name, _path)


def _set_operation(name: str, method: str) -> None:
    @selector(name, 2)
    def factory(literals: list):
        _no_params(literals)
        return lambda context, a, b: getattr(a, method)(b)


for _name, _method in (("join", "union"), ("intersect", "intersect"), ("subtract", "subtract")):
    _set_operation(_name, _method)


def _path(name: str, operator: Callable) -> None:
    @selector(name, 1)
    def factory(literals: list):
        _no_params(literals)
        return lambda context, a: Selected(context.graph, operator(context.graph, a.names))


for _name, _operator in (("on_call_path_to", paths.on_call_path_to), ("on_call_path_from", paths.on_call_path_from)):
    _path(_name, _operator)


@selector("coarse", (1, 2))
def coarse(literals: list):
    _no_params(literals)
    return lambda context, a, critical=None: Selected(context.graph, paths.coarse(context.graph, a.names, critical.names if critical else None))


@selector("min_call_depth", 1)
def min_call_depth(literals: list):
    op, n = _comparison(literals)
    return lambda context, a: Selected(context.graph, paths.min_call_depth(context.graph, a.names, op, n))


def _common_caller(name: str, mode: str) -> None:
    @selector(name, 2)
    def factory(literals: list):
        if len(literals) > 1 or literals and (not isinstance(literals[0], int) or isinstance(literals[0], bool)):
            raise ValueError("at most one integer is expected")
        limit = literals[0] if literals else INFINITY

        def run(context: Context, a: Selected, b: Selected) -> Selected:
            found, triggers = callers.common_caller(context.graph, a.names, b.names, limit, mode)
            context.triggers.append(triggers)
            return Selected(context.graph, found)

        return run


for _name, _mode in (("common_caller", "all"), ("common_caller_partial", "partial"), ("common_caller_distinct", "distinct")):
    _common_caller(_name, _mode)


def include_list(names: list[str]) -> Column:
    """Functions of a list."""
    return F.col("name").isin(names)


def exclude_list(names: list[str]) -> Column:
    """Functions that are not in a list."""
    return ~F.col("name").isin(names)
