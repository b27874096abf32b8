"""Traces of function events: windows for tables, state for streams."""

from .processor import TraceMachine, call_log_stream, planned_stream, region_stream, trace_stream
from .windows import begin_end_gate, call_depth, enclosing, recorded_trace, region_events, scope_gate, windowed_calls, within

__all__ = [
    "TraceMachine", "begin_end_gate", "call_depth", "call_log_stream", "enclosing", "planned_stream", "recorded_trace", "region_events", "region_stream", "scope_gate", "trace_stream", "windowed_calls", "within",
]
