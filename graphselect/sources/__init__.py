"""Sources: call graphs, filters, symbols, memory maps."""

from .filters import read_json_filter, read_name_list, read_region_filter
from .graphs import instrumented_names, read_call_graph, read_tables
from .symbols import binary_symbols, id_map, mapped_symbols, parse_dependencies, parse_memory_map, parse_symbols, symbol_sets

__all__ = [
    "binary_symbols", "id_map", "instrumented_names", "mapped_symbols", "parse_dependencies", "parse_memory_map", "parse_symbols", "read_call_graph", "read_json_filter", "read_name_list", "read_region_filter", "read_tables", "symbol_sets",
]
