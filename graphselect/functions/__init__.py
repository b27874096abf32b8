"""Column functions: name, regex, metadata, flag and text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a selection's flags.
NONE, ALWAYS, SCOPE_TRIGGER, BEGIN_TRIGGER, END_TRIGGER = 0, 1, 2, 4, 8
#: Comparison operators of metric selectors.
COMPARISONS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}


class RegexError(ValueError):
    pass


def java_pattern(pattern: str) -> str:
    """An ECMAScript pattern as a Java one that matches whole strings; raises if it is in neither dialect."""
    if re.search(r"\(\?<[^=!]", pattern) or re.search(r"\\[cu]", pattern):
        raise RegexError(f"not supported in a pattern: {pattern!r}")
    # A bracket inside a character class is a plain character here, and an operator in Java.
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        if not inside and c == "[":
            inside = True
            out.append(c)
            if pattern[k + 1 : k + 2] == "^":
                out.append("^")
                k += 1
        elif inside and c == "]":
            inside = False
            out.append(c)
        elif inside and (c == "[" or c == "&"):
            out.append("\\" + c)
        else:
            out.append(c)
        k += 1
    if inside or pattern.count("(") - pattern.count("\\(") < 0:
        raise RegexError(f"broken pattern: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RegexError(f"broken pattern: {pattern!r}: {e}") from e
    return f"^(?:{''.join(out)})\\z"


def full_match(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(java_pattern(pattern)), F.lit(False))


def is_destructor(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?s)^_Z.*D[012]Ev\z"), F.lit(False))


def compare(value: Column, op: str, n: int) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}")
    return F.coalesce(getattr(value, COMPARISONS[op])(F.lit(n)), F.lit(False))


def metric(meta: Column, path: str) -> Column:
    """An integer in a JSON document; null if the document or the path is missing or null."""
    return F.get_json_object(meta, f"$.{path}").cast("double").cast("int")


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def accepted(flags: Column) -> Column:
    return has_flag(flags, ALWAYS | SCOPE_TRIGGER | BEGIN_TRIGGER | END_TRIGGER)


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores case."""
    return F.lower(a) == F.lower(b)


def hex_to_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("decimal(20,0)").cast("long")


def indented(depth: Column, text: Column, unit: str = "  ") -> Column:
    return F.concat(F.repeat(F.lit(unit), depth), text)


def shortened(text: Column, limit: int = 2048) -> Column:
    """At most limit - 1 characters, as a fixed buffer holds them."""
    return F.substring(text, 1, limit - 1)


def without_templates(text: Column) -> Column:
    """Text outside <...>, nested as it may be; operators such as operator< are not told apart.

    Characters are folded once with the nesting depth as state.
    """
    chars = F.split(text, "")
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(s, c):
        inside = s["depth"] > 0
        depth = F.when(c == "<", s["depth"] + 1).when((c == ">") & inside, s["depth"] - 1).otherwise(s["depth"])
        keep = ~inside & (c != "<")
        return F.struct(depth.alias("depth"), F.when(keep, F.concat(s["kept"], c)).otherwise(s["kept"]).alias("kept"))

    return F.when(text.contains("<"), F.aggregate(chars, state, step, lambda s: s["kept"])).otherwise(text)


def without_return_type(text: Column) -> Column:
    """Text after the last white space."""
    return F.regexp_extract(text, r"(\S*)\z", 1)


def dot_attributes(pairs: dict[str, Column | str]) -> Column:
    """[a="x", b="y"], with quotes in values escaped."""
    parts = [F.concat(F.lit(f'{k}="'), F.regexp_replace(v if isinstance(v, Column) else F.lit(v), '"', '\\\\"'), F.lit('"')) for k, v in pairs.items()]
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
