import json

import pytest
from graphs import names
from pyspark.sql import functions as F

from graphselect import sinks, sources
from graphselect.model import CallGraph
from graphselect.plans import select
from graphselect.sinks.filters import default_path, write_lines
from graphselect.sources.demangle import with_demangled
from graphselect.sources.filters import FilterError
from graphselect.sources.graphs import GraphError

DOCUMENT = {
    "_CG": {
        "main": {"callees": ["_Z1av", "puts"], "meta": {"virtualCalls": [], "loopDepth": 2, "fileProperties": {"origin": "m.cpp", "systemInclude": False}, "instrument": True}},
        "_Z1av": {"callees": ["_ZN1A3fooEv"], "isVirtual": True, "meta": {"containsPointerCall": True}},
        "_ZN1B3fooEv": {"overrides": ["_ZN1A3fooEv"], "meta": None},
    }
}


def lines(df):
    return [r[0] for r in df.collect()]


def test_call_graph_document(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(DOCUMENT))
    full = spark.createDataFrame([("_Z1av", "a()"), ("_ZN1B3fooEv", "B::foo()")], "name string, full string")
    graph = sources.read_call_graph(spark, str(tmp_path / "g.json"), full)
    rows = {r["name"]: r for r in graph.functions.collect()}
    assert set(rows) == {"main", "_Z1av", "_ZN1B3fooEv", "puts", "_ZN1A3fooEv"}
    assert not rows["puts"]["known"] and rows["puts"]["demangled_name"] == ""
    assert rows["_Z1av"]["demangled_name"] == "a" and rows["_Z1av"]["contains_pointer_call"] and rows["main"]["file_name"] == "m.cpp"
    assert {tuple(r) for r in graph.calls.collect()} == {("main", "_Z1av", False), ("main", "puts", False), ("_Z1av", "_ZN1A3fooEv", True)}
    assert names(select(graph, 'on_call_path_from(by_name("main", %%))').names) == set(rows)
    assert names(sources.instrumented_names(spark, str(tmp_path / "g.json"))) == {"main"}


@pytest.mark.parametrize("text", ["", "{", '{"_CG": null}', "{}"])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(GraphError):
        sources.read_call_graph(spark, str(tmp_path / "g.json"))


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(DOCUMENT))
    graph = sources.read_call_graph(spark, str(tmp_path / "g.json"), spark.createDataFrame([], "name string, full string"))
    for t in ("functions", "calls", "overrides"):
        getattr(graph, t).write.parquet(str(tmp_path / t))
    again = sources.read_tables(spark, *(str(tmp_path / t) for t in ("functions", "calls", "overrides")))
    assert isinstance(again, CallGraph) and names(again.names) == names(graph.names)


@pytest.mark.parametrize(
    "full, name, parameters",
    [
        ("d()", "d", []),
        ("A::foo() const", "A::foo", [""]),
        ("(anonymous namespace)::foo(int)", "", ["anonymous namespace"]),
        ("A::operator()(int)", "A::operator", [""]),
        ("puts", "puts", []),
        ("void f<int>(std::map<int, int>, char (*)(int), long)", "f", ["std::map<int, int>", "char (*)(int)", "long"]),
    ],
)
def test_signatures(spark, full, name, parameters):
    row = with_demangled(spark.createDataFrame([("x", full)], "name string, full string"), F.col("full")).first()
    assert row["demangled_name"] == name
    if full.startswith("(anon"):
        return
    assert row["parameters"] == parameters


def test_filters_round_trip(spark, tmp_path):
    selection = spark.createDataFrame([("a", 1), ("b", 6), ("c", 3)], "name string, flags int")
    for k, (make, read, want) in enumerate([(sinks.name_list, sources.read_name_list, {("a", 1), ("c", 1)}), (sinks.region_filter, sources.read_region_filter, {("a", 1), ("c", 1)}), (sinks.json_filter, sources.read_json_filter, {("a", 1), ("b", 6), ("c", 3)})]):
        path = str(tmp_path / f"f{k}")
        write_lines(make(selection), path)
        assert {tuple(r) for r in read(spark, path).collect()} == want
    assert default_path("/x/g.json") == "/x/g.filt"
    (tmp_path / "bad").write_text("SCOREP_REGION_NAMES_BEGIN EXCLUDE * INCLUDE MANGLED a b")
    with pytest.raises(FilterError):
        sources.read_region_filter(spark, str(tmp_path / "bad"))


def test_symbols_and_maps(spark):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    table = sources.parse_symbols(text("0000000000001139 T main", "                 U puts", "0000000000001150 t helper"), "exe")
    assert {tuple(r) for r in table.collect()} == {("exe", 0x1139, "main"), ("exe", 0x1150, "helper")}
    assert lines(sources.parse_dependencies(text("\tlibc.so.6 => /lib/libc.so.6 (0x00007f)", "\tlinux-vdso.so.1 (0x0)"))) == ["/lib/libc.so.6"]
    maps = sources.parse_memory_map(text("55d0-66d0 r-xp 00001000 08:01 123   exe", "7f00-7f10 rw-p 0 08:01 1 exe", "7fff-8000 r-xp 0 00:00 0 [vdso]"))
    assert {tuple(r) for r in maps.collect()} == {("exe", 0x55D0, 0x1000)}
    assert sources.symbol_sets({"exe": table.limit(0)}, "exe") is None
    assert sources.mapped_symbols(maps, table).count() == 2
