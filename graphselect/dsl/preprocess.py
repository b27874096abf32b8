"""Directives: imports are spliced in, hints are taken out."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import ALWAYS, BEGIN_TRIGGER, END_TRIGGER
from .ast import Decl, Directive, Literal, Ref, Spec
from .parser import ParseError, parse

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Hint:
    """Functions of a selector get a flag."""

    flag: int
    selector: str


def _module(params) -> Spec | None:
    if len(params) != 1 or not isinstance(params[0], Literal) or params[0].kind != "str":
        log.error("import needs one file name")
        return None
    try:
        with open(params[0].value) as f:
            return parse(f.read(), comments=False)
    except (OSError, ParseError) as e:
        log.error("module %s can't be imported: %s", params[0].value, e)
        return None


def _hint(flag: int) -> Callable:
    def handle(params, found: list[Hint]) -> None:
        if len(params) != 1 or not isinstance(params[0], Ref):
            log.error("a hint needs one reference to a selector")
            return
        found.append(Hint(flag, params[0].name))

    return handle


#: Directives by name, other than import: (params, hints) -> None.
HANDLERS: dict[str, Callable] = {"instrument": _hint(ALWAYS), "begin_at": _hint(BEGIN_TRIGGER), "end_at": _hint(END_TRIGGER)}


def preprocess(spec: Spec) -> tuple[Spec, list[Hint]]:
    """The tree without directives, and the hints. Modules are spliced in once; directives in them are ignored, as unknown ones are."""
    statements, hints = [], []
    for s in spec.statements:
        if not isinstance(s, Directive):
            statements.append(s)
        elif s.name == "import":
            module = _module(s.params)
            for inner in module.statements if module else ():
                if isinstance(inner, Decl):
                    statements.append(inner)
                else:
                    log.error("directive !%s in a module is ignored", inner.name)
        elif s.name in HANDLERS:
            HANDLERS[s.name](s.params, hints)
        else:
            log.error("unknown directive !%s is ignored", s.name)
    return Spec(statements), hints
