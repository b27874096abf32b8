"""One call, or one command, from a call graph and a query to a filter file."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from .dsl import BindError, ParseError
from .operators.components import scc_stats
from .plans import REGISTRY, Selection, select
from .sinks import dot_lines, json_filter, name_list, region_filter, write_lines
from .sinks.dumps import query_dump, set_dump
from .sinks.filters import default_path
from .sources import binary_symbols, read_call_graph, read_tables
from .sources.graphs import GraphError

log = logging.getLogger(__name__)

#: Output formats by name: (name, flags) -> (line).
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"simple": name_list, "scorep": region_filter, "json": json_filter}
LEVELS = [logging.CRITICAL, logging.ERROR, logging.INFO, logging.DEBUG]


@dataclass
class Run:
    """What a run made: the selection, its flags, the filter file, and statistics of components if they were asked for."""

    selection: Selection
    flags: DataFrame
    output: str
    scc: Row | None = None


def load_graph(spark: SparkSession, path: str, traverse_virtual_dtors: bool = False):
    """A JSON document, JSON Lines of documents (.jsonl), or a folder with the Parquet tables functions, calls and overrides."""
    if os.path.isdir(os.path.join(path, "functions")):
        return read_tables(spark, *(os.path.join(path, t) for t in ("functions", "calls", "overrides")), traverse_virtual_dtors=traverse_virtual_dtors)
    return read_call_graph(spark, path, traverse_virtual_dtors=traverse_virtual_dtors, lines=path.endswith(".jsonl"))


def run(spark: SparkSession, graph, query: str | None = None, query_file: str | None = None, output: str | None = None, output_format: str = "scorep", symbols: DataFrame | None = None, dot: str | None = None, print_scc_stats: bool = False, traverse_virtual_dtors: bool = False, dump_sets: str | None = None) -> Run:
    """Run a query (a text, or a file of one) on a graph (a path, or a CallGraph) and write the filter file.

    output: the graph's path with the ending .filt where it is not given.
    symbols(name): compensate inlined functions with them. dot: a file for the
    drawing of what was selected. dump_sets: a folder for one text file for
    each selector, <selector>.txt. The files are local and go through the
    driver line by line; for results of any size write the DataFrames of
    Run.flags with Spark.
    """
    if (query is None) == (query_file is None):
        raise ValueError("give either a query or a file of one")
    if output_format not in FORMATS:
        raise ValueError(f"output format must be one of {', '.join(FORMATS)}")
    if query_file is not None:
        with open(query_file) as f:
            query = f.read()
    if output is None:
        if not isinstance(graph, str):
            raise ValueError("a graph that has no path needs an output")
        output = default_path(graph.rstrip("/"))
    log.debug("%s", query_dump(query, REGISTRY))
    if isinstance(graph, str):
        graph = load_graph(spark, graph, traverse_virtual_dtors)
    stats = scc_stats(graph.scc).first() if print_scc_stats else None
    found = select(graph, query)
    flags = found.flags(symbols)
    write_lines(FORMATS[output_format](flags), output)
    if dot is not None:
        write_lines(dot_lines(graph, flags), dot)
    if dump_sets is not None:
        os.makedirs(dump_sets, exist_ok=True)
        for name in found.sets:
            if name != "%":
                write_lines(set_dump(found, name), os.path.join(dump_sets, f"{name}.txt"))
    return Run(found, flags, output, stats)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m graphselect", description="Select functions of a call graph and write a filter file.", allow_abbrev=False)
    p.add_argument("graph", help="JSON document, JSON Lines of documents (.jsonl), or a folder of Parquet tables")
    p.add_argument("-i", dest="query", type=lambda s: ("query", s), metavar="QUERY", help="text of the query")
    p.add_argument("-f", dest="query", type=lambda s: ("query_file", s), metavar="FILE", help="file of the query; of -i and -f the last one counts")
    p.add_argument("-o", dest="output", metavar="FILE", help="filter file; the graph's name with .filt where it is not given")
    p.add_argument("-v", dest="verbosity", type=int, nargs="?", const=2, default=2, choices=range(4), help="0 (none) to 3")
    p.add_argument("--write-dot", dest="dot", metavar="FILE", help="draw what was selected")
    p.add_argument("--replace-inlined", dest="executable", metavar="EXE", help="replace functions without a symbol in this program or its libraries by their callers")
    p.add_argument("--output-format", choices=list(FORMATS), default="scorep")
    p.add_argument("--debug", dest="dump_sets", metavar="FOLDER", help="write the functions of each selector to a file of this folder")
    p.add_argument("--print-scc-stats", action="store_true")
    p.add_argument("--traverse-virtual-dtors", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where the graph or the query can't be read; what an undefined reference selects is empty."""
    parser = _parser()
    a = parser.parse_args(argv)
    if a.query is None:
        parser.error("-i or -f is needed")
    logging.basicConfig(format="%(message)s")
    logging.getLogger("graphselect").setLevel(LEVELS[a.verbosity])
    spark = spark or SparkSession.builder.appName("graphselect").getOrCreate()
    try:
        symbols = None
        if a.executable:
            symbols = binary_symbols(spark, a.executable)
            if symbols is None:
                log.warning("no symbols in %s: inlined functions are not compensated", a.executable)
        done = run(spark, a.graph, **{a.query[0]: a.query[1]}, output=a.output, output_format=a.output_format, symbols=symbols, dot=a.dot, print_scc_stats=a.print_scc_stats, traverse_virtual_dtors=a.traverse_virtual_dtors, dump_sets=a.dump_sets)
    except (AnalysisException, GraphError, ParseError, BindError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if done.scc is not None:
        for key, value in done.scc.asDict().items():
            print(f"{key}: {value}")
    return 0
