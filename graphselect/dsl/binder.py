"""From the tree to a graph of selectors: names, parameters and inputs are settled here."""

from __future__ import annotations

from dataclasses import dataclass, field

from .ast import Decl, Def, Literal, Ref, Spec
from .preprocess import Hint


class BindError(ValueError):
    """An unknown selector, wrong parameters, a name given twice, or a cycle."""


@dataclass
class SelectorNode:
    name: str
    selector: object  # what the registry's factory made of the literals
    type: str
    inputs: list[str] = field(default_factory=list)


@dataclass
class SelectorGraph:
    nodes: dict[str, SelectorNode]
    entries: list[str]

    def order(self) -> list[str] | None:
        """Nodes that the entries need, inputs first; None if one refers to a name that is not there."""
        done, state = [], {}
        stack = [(e, False) for e in reversed(self.entries)]
        while stack:
            name, leaving = stack.pop()
            if leaving:
                state[name] = 2
                done.append(name)
                continue
            if state.get(name) == 2:
                continue
            if name not in self.nodes:
                return None
            if state.get(name) == 1:
                raise BindError(f"selector {name} refers to itself")
            state[name] = 1
            stack.append((name, True))
            for i in reversed(self.nodes[name].inputs):
                if state.get(i) == 1:
                    raise BindError(f"selector {i} refers to itself")
                if state.get(i) != 2:
                    stack.append((i, False))
        return done

    def dump(self) -> str:
        return "\n".join(f"{n.name}: {n.type}({', '.join(n.inputs)})" + (" [entry]" if n.name in self.entries else "") for n in self.nodes.values())


def bind(spec: Spec, hints: list[Hint], registry: dict) -> SelectorGraph:
    """registry: selector type -> factory(params) that raises ValueError on wrong parameters.

    Entries are the selectors of hints, or the last statement without hints.
    """
    nodes = {"%": SelectorNode("%", None, "%%")}
    count = 0

    def add(definition: Def, name: str | None) -> str:
        nonlocal count
        if definition.type not in registry:
            raise BindError(f"unknown selector type {definition.type}")
        if name is None:
            name = f"anon_{count}"
            count += 1
        if name in nodes:
            raise BindError(f"selector {name} is declared twice")
        node = nodes[name] = SelectorNode(name, None, definition.type)
        literals = []
        for p in definition.params:
            if isinstance(p, Literal):
                literals.append(p.value)
            elif isinstance(p, Ref):
                node.inputs.append(p.name)
            else:
                node.inputs.append(add(p, None))
        try:
            node.selector = registry[definition.type](literals)
        except ValueError as e:
            raise BindError(f"{definition.type}: {e}") from e
        return name

    last = None
    for s in spec.statements:
        if isinstance(s, Decl):
            last = add(s.definition, s.name)
    entries = list(dict.fromkeys(h.selector for h in hints)) if hints else [last] if last else []
    return SelectorGraph(nodes, entries)
