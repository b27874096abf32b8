import json

import pytest
from graphs import build, names
from pyspark.sql import functions as F

from graphselect.cli import main, run
from graphselect.sources import binary_symbols, read_call_graph
from graphselect.sources.graphs import GraphError

FUNCTIONS = {
    "main": {"callees": ["a", "b"]},
    "a": {"callees": ["c"], "meta": {"isInlined": True, "virtualCalls": []}},
    "b": {"callees": ["c", "b2"]},
    "b2": {"callees": ["b"]},
    "c": {"callees": []},
}
QUERY = """# callers of c
up = on_call_path_to(by_name("c", %%))
inlined = inline_specified(%%)
subtract(%up, %inlined)
"""


@pytest.fixture
def graph(tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"_CG": FUNCTIONS}))
    (tmp_path / "q.txt").write_text(QUERY)
    return tmp_path


def test_command(spark, graph, capsys):
    code = main([str(graph / "g.json"), "-i", "by_name(", "-f", str(graph / "q.txt"), "--write-dot", str(graph / "g.dot"), "--print-scc-stats", "--debug", str(graph / "sets")], spark)
    assert code == 0
    assert (graph / "g.filt").read_text().split() == "SCOREP_REGION_NAMES_BEGIN EXCLUDE * INCLUDE MANGLED b b2 c main SCOREP_REGION_NAMES_END".split()
    dot = (graph / "g.dot").read_text()
    assert '"main" -> "b"' in dot and '"a"' not in dot
    assert (graph / "sets" / "up.txt").read_text().split() == ["a", "b", "b2", "c", "main"]
    assert "n_scc: 4" in capsys.readouterr().out


@pytest.mark.parametrize("form, want", [("simple", "c\nmain\n"), ("json", {"c": {"flags": 1}, "main": {"flags": 1}})])
def test_formats_and_symbols(spark, graph, form, want):
    symbols = spark.createDataFrame([("c",), ("main",)], "name string")
    done = run(spark, str(graph / "g.json"), 'by_name("a|c", %%)', output=str(graph / "o"), output_format=form, symbols=symbols)
    text = (graph / "o").read_text()
    assert (json.loads(text)["selection"] if form == "json" else text) == want
    assert names(done.flags) == {"c", "main"}


def test_errors(spark, graph):
    path = str(graph / "g.json")
    assert main([path, "-i", "by_name("], spark) == 1
    assert main([path, "-i", "no_such(%%)"], spark) == 1
    assert main([str(graph / "none.json"), "-i", "inline_specified(%%)"], spark) == 1
    assert main([path, "-f", str(graph / "none.txt")], spark) == 1
    assert main([path, "-i", "join(%nothing, %%)", "--output-format", "simple"], spark) == 0
    assert (graph / "g.filt").read_text() == ""
    with pytest.raises(SystemExit):
        main([path], spark)
    with pytest.raises(ValueError):
        run(spark, path, "x()", query_file="y")
    with pytest.raises(ValueError):
        run(spark, build(spark, "a>b"), "inline_specified(%%)")


def test_lines_and_tables(spark, graph):
    (graph / "g.jsonl").write_text("\n".join(json.dumps({"_CG": {n: f}}) for n, f in FUNCTIONS.items()) + "\n\n" + json.dumps({"_CG": {"c": {"callees": ["d"]}}}))
    one = read_call_graph(spark, str(graph / "g.jsonl"), lines=True)
    assert names(one.names) == {*FUNCTIONS, "d"} and one.functions.count() == 6
    for t in ("functions", "calls", "overrides"):
        getattr(one, t).write.parquet(str(graph / "t" / t))
    for path in ("g.jsonl", "t"):
        run(spark, str(graph / path), 'on_call_path_to(by_name("c", %%))', output_format="simple")
        assert (graph / path).with_suffix(".filt").read_text().split() == ["a", "b", "b2", "c", "main"]
    (graph / "bad.jsonl").write_text(json.dumps({"_CG": FUNCTIONS}) + "\n{}\n")
    with pytest.raises(GraphError):
        read_call_graph(spark, str(graph / "bad.jsonl"), lines=True)


def test_binary_symbols(spark, graph, monkeypatch):
    tools = {"nm": "0000000000001139 T main\n                 U puts\n", "ldd": "\tlibx.so => /lib/libx.so (0x7f)\n\tvdso (0x7f)\n"}
    calls = []

    def fake(spark, *command):
        calls.append(command)
        text = "0000000000000010 T x\n" if command[-1] == "/lib/libx.so" else tools[command[0]]
        return spark.createDataFrame([(v,) for v in text.splitlines()], "value string")

    monkeypatch.setattr("graphselect.sources.symbols._listing", fake)
    assert names(binary_symbols(spark, "app")) == {"main", "x"}
    assert ("nm", "--defined-only", "-D", "/lib/libx.so") in calls
    tools["nm"] = ""
    assert binary_symbols(spark, "app") is None


def test_missing_binary(spark, graph):
    assert binary_symbols(spark, str(graph / "no-such-program")) is None
    assert main([str(graph / "g.json"), "-i", "inline_specified(%%)", "--output-format", "simple", "--replace-inlined", str(graph / "no-such-program")], spark) == 0
    assert (graph / "g.filt").read_text() == "a\n"
