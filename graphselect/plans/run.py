"""The run of a query: text, tree, selector graph, DataFrames, flags."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dsl import bind, parse, preprocess
from ..dsl.preprocess import Hint
from ..functions import ALWAYS, SCOPE_TRIGGER
from ..operators import sets
from ..operators.inline import replace_inlined
from .registry import REGISTRY, Context
from .selected import Selected

log = logging.getLogger(__name__)


@dataclass
class Selection:
    """A query's results: sets by selector name, hints, and functions that became scope triggers."""

    graph: object
    sets: dict[str, Selected]
    entries: list[str]
    hints: list[Hint]
    triggers: list[DataFrame] = field(default_factory=list)

    @property
    def names(self) -> DataFrame:
        """The last entry's functions."""
        return self.sets[self.entries[-1]].names if self.entries and self.entries[-1] in self.sets else self.graph.names.limit(0)

    def counts(self) -> DataFrame:
        """(selector, selected) for each selector that ran."""
        rows = [s.names.agg(F.lit(n).alias("selector"), F.count("*").alias("selected")) for n, s in self.sets.items() if n != "%"]
        return reduce(DataFrame.union, rows)

    def flags(self, symbols: DataFrame | None = None) -> DataFrame:
        """(name, flags): ALWAYS for the entry or what hints say, and SCOPE_TRIGGER for selected triggers.

        symbols(name): replace functions without a symbol by callers that have one; triggers are carried along. Ignored if it is empty.
        """
        none = self.graph.names.limit(0).withColumn("flags", F.lit(0))
        hints = self.hints or [Hint(ALWAYS, e) for e in self.entries]
        replace = symbols is not None and not symbols.isEmpty()
        trigger = reduce(DataFrame.union, self.triggers).select("name").distinct() if self.triggers else None
        parts = [none]
        for h in hints:
            if h.selector not in self.sets:
                log.error("no result for selector %s", h.selector)
                continue
            names = own = self.sets[h.selector].names
            if h.flag == ALWAYS and replace:
                names = replace_inlined(self.graph, own, symbols)
            parts.append(names.select("name", F.lit(h.flag).alias("flags")))
            if h.flag == ALWAYS and trigger is not None:
                marked = sets.intersect(own, trigger)
                marked = replace_inlined(self.graph, marked, symbols) if replace else marked
                parts.append(marked.select("name", F.lit(SCOPE_TRIGGER).alias("flags")))
        return sets.merge_flags(*parts)


def select(graph, query: str) -> Selection:
    """Run a query. Selectors that no entry needs are not run; a reference to nothing leaves all results empty."""
    spec, hints = preprocess(parse(query))
    bound = bind(spec, hints, REGISTRY)
    order = bound.order()
    if order is None:
        log.error("invalid selector pipeline: a reference to a selector that is not there")
        return Selection(graph, {}, bound.entries, hints)
    context, found = Context(graph), {}
    for name in order:
        node = bound.nodes[name]
        found[name] = Selected(graph) if name == "%" else node.selector(context, [found[i] for i in node.inputs])
    return Selection(graph, found, bound.entries, hints, context.triggers)


def select_flags(graph, query: str, symbols: DataFrame | None = None) -> DataFrame:
    return select(graph, query).flags(symbols)
