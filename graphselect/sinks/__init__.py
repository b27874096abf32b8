"""Sinks: filter files, graph drawings, dumps, call logs and trace events."""

from .dot import dot_lines
from .dumps import set_dump
from .filters import json_filter, name_list, region_filter, write_lines
from .logs import call_log, call_tree_log, event_dictionary, gnu_callbacks, region_registrations, write_call_log

__all__ = [
    "call_log", "call_tree_log", "dot_lines", "event_dictionary", "gnu_callbacks", "json_filter", "name_list", "region_filter", "region_registrations", "set_dump", "write_call_log", "write_lines",
]
