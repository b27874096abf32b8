"""Syntax tree of the selection language."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    def accept(self, visitor: Visitor):
        return getattr(visitor, f"visit_{type(self).__name__.lower()}", visitor.visit)(self)

    def children(self) -> list[Node]:
        return []


@dataclass
class Literal(Node):
    value: bool | int | float | str

    @property
    def kind(self) -> str:
        return type(self.value).__name__

    def __str__(self) -> str:
        if isinstance(self.value, str):
            return '"' + self.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass
class Ref(Node):
    """%name, or %% for every function."""

    name: str

    @property
    def everything(self) -> bool:
        return self.name == "%"

    def __str__(self) -> str:
        return f"%{self.name}"


@dataclass
class Def(Node):
    """A selector with its parameters in order."""

    type: str
    params: list[Node] = field(default_factory=list)

    def children(self) -> list[Node]:
        return self.params

    def __str__(self) -> str:
        return f"{self.type}({', '.join(map(str, self.params))})"


@dataclass
class Decl(Node):
    """A statement: a selector, with a name or without."""

    name: str | None
    definition: Def

    def children(self) -> list[Node]:
        return [self.definition]

    def __str__(self) -> str:
        return f"{self.name} = {self.definition}" if self.name else str(self.definition)


@dataclass
class Directive(Node):
    name: str
    params: list[Node] = field(default_factory=list)

    def children(self) -> list[Node]:
        return self.params

    def __str__(self) -> str:
        return f"!{self.name}({', '.join(map(str, self.params))})" if self.params else f"!{self.name}"


@dataclass
class Spec(Node):
    statements: list[Node] = field(default_factory=list)

    def children(self) -> list[Node]:
        return self.statements

    def __str__(self) -> str:
        return "\n".join(map(str, self.statements))


class Visitor:
    """Walks the tree; a subclass defines visit_<class name> for the nodes that it cares about."""

    def visit(self, node: Node):
        for child in node.children():
            child.accept(self)


def dump(node: Node, depth: int = 0) -> str:
    """The tree, one node on a line."""
    label = {Literal: lambda n: f"{n.kind} {n}", Ref: str, Def: lambda n: n.type, Decl: lambda n: f"declare {n.name or '(unnamed)'}", Directive: lambda n: f"!{n.name}", Spec: lambda n: "spec"}[type(node)](node)
    return "\n".join(["  " * depth + label, *(dump(c, depth + 1) for c in node.children())])
