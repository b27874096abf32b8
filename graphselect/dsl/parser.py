"""Lexer and recursive-descent parser."""

from __future__ import annotations

import re

from .ast import Decl, Def, Directive, Literal, Node, Ref, Spec

_TOKENS = re.compile(r"""(?P<space>\s+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<number>[-.0-9]+)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<sign>[()%=,!])""", re.S)


class ParseError(ValueError):
    def __init__(self, message: str, text: str, at: int):
        super().__init__(f"{message} at {at}: ...{text[max(0, at - 20) : at]}>>>{text[at : at + 20]}")


def strip_comments(text: str) -> str:
    """From # to the end of a line is a comment, even within a string; what is left of the lines is joined without a separator."""
    return "".join(line.split("#", 1)[0] for line in text.splitlines())


def join_lines(text: str) -> str:
    return "".join(text.splitlines())


def _string(raw: str, text: str, at: int) -> str:
    def escape(m: re.Match) -> str:
        if m[1] not in '\\"':
            raise ParseError(f"unknown escape \\{m[1]}", text, at)
        return m[1]

    return re.sub(r"\\(.)", escape, raw[1:-1], flags=re.S)


def _number(raw: str, text: str, at: int) -> int | float:
    if re.fullmatch(r"-?[0-9]+", raw):
        return int(raw)
    if re.fullmatch(r"-?[0-9]*\.[0-9]+", raw):
        return float(raw)
    raise ParseError(f"malformed number {raw}", text, at)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ParseError("unexpected character", text, at)
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.k = 0

    def peek(self, ahead: int = 0) -> tuple[str, str, int]:
        k = self.k + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "", len(self.text))

    def take(self, kind: str, value: str | None = None) -> str:
        found, text, at = self.peek()
        if found != kind or value is not None and text != value:
            raise ParseError(f"expected {value or kind}, found {text or 'the end'}", self.text, at)
        self.k += 1
        return text

    def spec(self) -> Spec:
        statements = []
        while self.peek()[0] != "end":
            statements.append(self.directive() if self.peek()[1] == "!" and self.peek()[0] == "sign" else self.declaration())
        return Spec(statements)

    def directive(self) -> Directive:
        self.take("sign", "!")
        name = self.take("name")
        return Directive(name, self.params() if self.peek()[:2] == ("sign", "(") else [])

    def declaration(self) -> Decl:
        name = None
        if self.peek(1)[:2] == ("sign", "="):
            name = self.take("name")
            self.take("sign", "=")
        return Decl(name, self.definition())

    def definition(self) -> Def:
        return Def(self.take("name"), self.params())

    def params(self) -> list[Node]:
        self.take("sign", "(")
        found: list[Node] = []
        while self.peek()[:2] != ("sign", ")"):
            if found:
                self.take("sign", ",")
            found.append(self.param())
        self.take("sign", ")")
        return found

    def param(self) -> Node:
        kind, text, at = self.peek()
        if kind == "string":
            self.k += 1
            return Literal(_string(text, self.text, at))
        if kind == "number":
            self.k += 1
            return Literal(_number(text, self.text, at))
        if (kind, text) == ("sign", "%"):
            self.k += 1
            if self.peek()[:2] == ("sign", "%"):
                self.k += 1
                return Ref("%")
            return Ref(self.take("name"))
        if kind == "name" and text in ("true", "false") and self.peek(1)[:2] != ("sign", "("):
            self.k += 1
            return Literal(text == "true")
        return self.definition()


def parse(text: str, comments: bool = True) -> Spec:
    """The tree of a query; comments: strip them first (modules are only joined)."""
    return _Parser(strip_comments(text) if comments else join_lines(text)).spec()
