"""The selection language: text to a bound graph of selectors."""

from .binder import BindError, SelectorGraph, bind
from .parser import ParseError, parse, strip_comments
from .preprocess import Hint, preprocess

__all__ = ["BindError", "Hint", "ParseError", "SelectorGraph", "bind", "parse", "preprocess", "strip_comments"]
