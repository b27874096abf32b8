import pytest
from graphs import build, meta, names

from graphselect.dsl import BindError, ParseError
from graphselect.operators.components import scc_stats
from graphselect.plans import REGISTRY, filter_selector, select

BASIC = {"a": {"parameters": ["int"], "meta": meta(loop=1)}, "b": {"parameters": ["int"], "meta": meta(loop=2)}, "c": {"parameters": ["int", "int"], "meta": meta(flops=3)}, "d": {"parameters": []}, "main": {"parameters": []}}


@pytest.fixture(scope="module")
def basic(spark):
    return build(spark, "main>a main>c a>b b>c", functions=BASIC)


@pytest.mark.parametrize(
    "query, expected",
    [
        ('by_name("(main)|(a)", %%)', "a main"),
        ('by_name("(a)|(c)", "int", %%)', "a"),
        ('by_name("(d)|(a)", "()", %%)', "d"),
        ('by_name("@^(?!m).*", %%)', "a b c d"),
        ('loop_depth(">=", 1, %%)', "a b"),
        ('loop_depth("==", 2, %%)', "b"),
        ('flops(">=", 1, %%)', "c"),
        ('on_call_path_to(loop_depth("==", 2, %%))', "a b main"),
        ('on_call_path_from(loop_depth("==", 2, %%))', "b c"),
        ('min_call_depth(">=", 2, %%)', "b"),
        ('min_call_depth(%%, "<=", 1)', "a c d main"),
        ('x = by_name("a", %%) # a comment\njoin(%x, by_name("b", %%))', "a b"),
        ('intersect(by_name("[ab]", %%), by_name("[bc]", %%))', "b"),
        ('subtract(%%, on_call_path_to(by_name("c", %%)))', "d"),
        ("join(%%)", ""),
        ("intersect(%nothing, %%)", ""),
    ],
)
def test_queries(basic, query, expected):
    assert names(select(basic, query).names) == set(expected.split())


def test_components_of_an_acyclic_graph(basic):
    assert tuple(scc_stats(basic.scc).first()) == (5, 1, 0, 0)


def test_hints_and_unknown_directives(basic):
    found = select(basic, 'sel = by_name("(main)|(a)", %%) !instrument(%sel) !nonsense(%sel)').flags()
    assert {tuple(r) for r in found.collect()} == {("a", 1), ("main", 1)}


@pytest.mark.parametrize("query", ['nothing("x", %%)', "flops(1, 2, %%)", 'loop_depth("=", 2, %%)', 'a = coarse(%%) a = coarse(%%)', "a = coarse(%b) b = coarse(%a)", 'by_name("@x", "y", %%)', 'by_name("(", %%)'])
def test_queries_that_do_not_bind(basic, query):
    with pytest.raises(BindError):
        select(basic, query)


@pytest.mark.parametrize("query", ["!import \"x\"", "a = ", 'by_name("x)', "flops(\">\", 1.2.3, %%)", 'by_name("\\.", %%)'])
def test_queries_that_do_not_parse(basic, query):
    with pytest.raises(ParseError):
        select(basic, query)


def test_import(basic, tmp_path):
    (tmp_path / "m.q").write_text('base = by_name("[ab]", %%)\n!instrument(%base)')
    assert names(select(basic, f'!import("{tmp_path}/m.q") intersect(%base, by_name("[bc]", %%))').names) == {"b"}
    assert names(select(basic, '!import("/nowhere") by_name("b", %%)').names) == {"b"}


def test_own_selector(basic):
    @filter_selector("short_name")
    def short_name(literals):
        from pyspark.sql import functions as F

        return F.length("name") == 1

    assert names(select(basic, "short_name(%%)").names) == set("abcd")
    del REGISTRY["short_name"]


def test_filters_fuse_into_one_scan(basic):
    plan = select(basic, 'join(flops(">", 1, loop_depth(">=", 0, %%)), inline_specified(%%))').names._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.replace("LeftAnti", "") or plan.count("Join") <= 1


COMMON = {
    "03": ("main>a main>f a>b a>d b>c d>e c>M1 e>M2", 'common_caller(by_name("c",%%),by_name("e",%%))', "a b c d e"),
    "04": ("main>a1 main>b1 a1>a2 a1>a3 a2>c1 a3>c2 b1>b2 b1>b3 b2>b4 b3>b5 b4>c1 b5>c2 c1>M1 c2>M2", 'common_caller(by_name("c1",%%),by_name("c2",%%))', "a1 a2 a3 b1 b2 b3 b4 b5 c1 c2 main"),
    "04d": ("main>a1 main>b1 a1>a2 a1>a3 a2>c1 a3>c2 b1>b2 b1>b3 b2>b4 b3>b5 b4>c1 b5>c2 c1>M1 c2>M2", 'common_caller_distinct(by_name("c1",%%),by_name("c2",%%))', "a1 a2 a3 b1 b2 b3 b4 b5 c1 c2"),
    "05": ("main>a1 main>b1 a1>a2 a1>a3 a2>c1 a3>c2 b1>b2 b1>b3 b2>b4 b3>b5 b4>c1 b5>c2 c1>M1 c2>M2 a3>a1 b4>b2", 'common_caller(by_name("c1",%%),by_name("c2",%%))', "a1 a2 a3 b1 b2 b3 b4 b5 c1 c2 main"),
    "06": ("main>a main>e main>c a>b c>d e>b e>d b>M1 d>M2", 'common_caller(1,by_name("b",%%),by_name("d",%%))', "a b c d e main"),
    "12-0": ("main>a a>t1 a>b b>t1 b>c c>d d>t1 d>t2 t1>M1 t2>M2", 'common_caller(0,by_name("t1",%%),by_name("t2",%%))', "d t1 t2"),
    "12-1": ("main>a a>t1 a>b b>t1 b>c c>d d>t1 d>t2 t1>M1 t2>M2", 'common_caller(1,by_name("t1",%%),by_name("t2",%%))', "b c d t1 t2"),
    "12-2": ("main>a a>t1 a>b b>t1 b>c c>d d>t1 d>t2 t1>M1 t2>M2", 'common_caller(2,by_name("t1",%%),by_name("t2",%%))', "a b c d t1 t2"),
    "15-0": ("b>x b>y c>x c>y d>b d>y a>b a>d f>a e>x e>f", 'common_caller(0,by_name("x",%%),by_name("y",%%))', "b c x y"),
    "15-1": ("b>x b>y c>x c>y d>b d>y a>b a>d f>a e>x e>f", 'common_caller(1,by_name("x",%%),by_name("y",%%))', "a b c d x y"),
    "15-2": ("b>x b>y c>x c>y d>b d>y a>b a>d f>a e>x e>f", 'common_caller(2,by_name("x",%%),by_name("y",%%))', "a b c d e f x y"),
}


@pytest.mark.parametrize("case", COMMON)
def test_common_caller(spark, case):
    calls, query, expected = COMMON[case]
    assert names(select(build(spark, calls), query).names) == set(expected.split())


def test_common_caller_marks_triggers(spark):
    found = {r["name"]: r["flags"] for r in select(build(spark, COMMON["03"][0]), COMMON["03"][1]).flags().collect()}
    assert found == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1}


def test_virtual_calls(spark):
    graph = build(spark, "main>A", [("main", "A")], [("B", "A"), ("C", "B")])
    assert names(select(graph, 'on_call_path_from(by_name("main",%%))').names) == {"A", "B", "C", "main"}
    assert names(select(graph, 'on_call_path_to(by_name("C",%%))').names) == {"C", "main"}
    common = build(spark, "main>a main>f a>b b>c c>M1 a>D D2>e e>M2", [("a", "D")], [("D2", "D")])
    assert names(select(common, 'common_caller(by_name("c",%%),by_name("e",%%))').names) == {"a", "b", "c", "D2", "e"}


def test_virtual_destructors(spark):
    args = "foo>_ZN1AD0Ev", [("foo", "_ZN1AD0Ev")], [("_ZN1BD0Ev", "_ZN1AD0Ev"), ("_ZN1CD0Ev", "_ZN1BD0Ev")]
    query = 'on_call_path_to(by_name("@_ZN1C.*",%%))'
    assert names(select(build(spark, *args), query).names) == {"_ZN1CD0Ev"}
    assert names(select(build(spark, *args, dtors=True), query).names) == {"_ZN1CD0Ev", "foo"}


def test_override_cycle_ends(spark):
    graph = build(spark, "m>A", [("m", "A")], [("A", "B"), ("B", "A")])
    assert {tuple(r) for r in graph.all_edges.collect()} == {("m", "A"), ("m", "B")}


def test_recursion(spark):
    graph = build(spark, "a>b a>d a>f b>c b>f c>b d>e e>a")
    assert names(select(graph, 'on_call_path_to(by_name("a",%%))').names) == {"a", "d", "e"}
    assert names(select(graph, 'on_call_path_to(by_name("f",%%))').names) == set("abcdef")
    assert names(select(graph, 'on_call_path_from(by_name("f",%%))').names) == {"f"}
    assert tuple(scc_stats(graph.scc).first()) == (3, 3, 2, 1)
    assert {r["name"]: r["depth"] for r in __import__("graphselect.operators.paths", fromlist=["x"]).min_call_depths(graph, graph.names).collect()}["a"] == 2147483647
