"""Selectors, their lowering to DataFrame plans, and the run of a query."""

from .registry import REGISTRY, Context, filter_selector, selector
from .run import Selection, select, select_flags
from .selected import Selected

__all__ = ["REGISTRY", "Context", "Selected", "Selection", "filter_selector", "select", "select_flags", "selector"]
