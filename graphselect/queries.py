"""Registered queries over derived graphs and traces, and DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derived
from .functions import ALWAYS, BEGIN_TRIGGER, END_TRIGGER, accepted, full_match, has_flag, is_destructor
from .operators import common_caller as callers
from .operators import inline, paths, resolve, sets
from .operators.components import scc_stats
from .operators.iterate import reversed_edges
from .operators.postdom import post_dominators
from .operators.virtual import override_closure
from .plans import select
from .plans.registry import exclude_list, include_list
from .sinks import call_log, call_tree_log, dot_lines, event_dictionary, gnu_callbacks, json_filter, name_list, region_filter, region_registrations, set_dump
from .model import CallGraph
from .sources import id_map, mapped_symbols, parse_dependencies, parse_memory_map, parse_symbols, symbol_sets
from .sources.demangle import base_name, parameter_list
from .streaming import begin_end_gate, call_depth, recorded_trace, region_events, scope_gate, windowed_calls, within

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Graph L in SQL.
L = """
functions AS (
  SELECT 'region_' || r_regionkey AS name, r_name AS demangled_name, 'region/' || r_name AS file_name, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2, false AS is_inlined, false AS in_system_header, false AS ptr, CAST(NULL AS INTEGER) AS flo, CAST(NULL AS INTEGER) AS mem, CAST(NULL AS INTEGER) AS ld FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'nation/' || n_name, NULL, NULL, false, false, false, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'cust_' || c_custkey, c_name, 'customer/' || c_mktsegment, NULL, NULL, false, false, false, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'supp_' || s_suppkey, s_name, 'supplier/' || s_nationkey, NULL, NULL, false, false, false, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'order_' || o_orderkey, 'order_' || o_orderkey, 'order/' || o_orderpriority, NULL, NULL, false, false, o_orderstatus = 'P', NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'part_' || p_partkey, p_name, p_brand || '/' || p_type, p_brand, p_type, p_size < 10, p_type = 'SMALL', false, p_size, p_partkey % 100, p_size % 4 FROM part),
calls AS (
  SELECT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst, false AS is_virtual FROM nation
  UNION SELECT 'nation_' || c_nationkey, 'cust_' || c_custkey, false FROM customer
  UNION SELECT 'nation_' || s_nationkey, 'supp_' || s_suppkey, false FROM supplier
  UNION SELECT 'cust_' || o_custkey, 'order_' || o_orderkey, false FROM orders
  UNION SELECT 'order_' || l_orderkey, 'part_' || l_partkey, false FROM lineitem
  UNION SELECT 'supp_' || l_suppkey, 'part_' || l_partkey, true FROM lineitem),
names AS (SELECT name FROM functions UNION SELECT src FROM calls UNION SELECT dst FROM calls),
overrides AS (SELECT 'part_' || p_partkey AS src, 'part_' || (CASE WHEN p_partkey % 10 <= 4 THEN p_partkey - p_partkey % 10 ELSE p_partkey - 4 END) AS dst FROM part WHERE p_partkey % 10 <> 0),
ov AS (SELECT src, dst FROM overrides UNION SELECT o.src, v.dst FROM overrides o JOIN ov v ON o.dst = v.src),
all_edges AS (SELECT src, dst FROM calls UNION SELECT c.src, v.src FROM calls c JOIN ov v ON v.dst = c.dst WHERE c.is_virtual)"""
#: Graph C in SQL.
C = """
lines AS (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT'),
edges AS (SELECT DISTINCT 'part_' || l_partkey AS src, 'part_' || nxt AS dst FROM lines WHERE nxt IS NOT NULL),
nodes AS (SELECT src AS name FROM edges UNION SELECT dst FROM edges),
r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON r.b = e.src),
scc AS (SELECT n.name, least(n.name, coalesce(min(r1.b), n.name)) AS scc FROM nodes n LEFT JOIN (SELECT r1.a, r1.b FROM r r1 JOIN r r2 ON r1.a = r2.b AND r1.b = r2.a) r1 ON r1.a = n.name GROUP BY n.name)"""
#: Trace E in SQL.
E = """
trace AS (SELECT user_id AS thread, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(event_id % 50 AS INTEGER) AS id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'ENTRY' ELSE 'EXIT' END AS type, event_type AS kind FROM events),
walk AS (SELECT *, sum(CASE WHEN type = 'ENTRY' THEN 1 ELSE -1 END) OVER (PARTITION BY thread ORDER BY seq) AS s FROM trace),
low AS (SELECT *, least(0, min(s) OVER (PARTITION BY thread ORDER BY seq)) AS m, least(0, coalesce(min(s) OVER (PARTITION BY thread ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS mb FROM walk),
depths AS (SELECT thread, seq, id, type, kind, CAST(s - m AS INTEGER) AS depth, (type = 'ENTRY' OR s >= mb) AS matched, CAST(CASE WHEN type = 'ENTRY' THEN s - m ELSE s - m + 1 END AS INTEGER) AS level FROM low)"""


def query(name: str, sql: str | None = None, *parts: str):
    """Register a query; parts are the tables that its SQL starts from."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + sql
        return f

    return register


def _selected(name: str, text: str, sql: str, graph=derived.layered, tables: str = L):
    """A query of the selection language whose result is one set."""

    @query(name, sql, tables)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(graph(spark, sf_dir), text).names

    run.__doc__ = text
    return run


def _where(predicate: str) -> str:
    return f"SELECT name FROM functions WHERE {predicate}"


def _up(seed: str, edges: str = "all_edges") -> str:
    return f"up AS ({seed} UNION SELECT e.src FROM up JOIN {edges} e ON e.dst = up.name)"


_selected("everything", "all = intersect(%%, %%)", "SELECT name FROM names")
_selected("by_name", 'by_name("(red|blue) .*", %%)', _where("regexp_full_match(demangled_name, '(red|blue) .*')"))
_selected("by_name_params", 'by_name(".*", "Brand.1.*", "(SMALL|LARGE)", %%)', _where("regexp_full_match(p1, 'Brand.1.*') AND p2 IN ('SMALL', 'LARGE')"))
_selected("by_name_no_params", 'by_name("Customer.*", "()", %%)', _where("demangled_name LIKE 'Customer%'"))
_selected("by_name_mangled", 'by_name("@(?!order).*7", %%)', "SELECT name FROM names WHERE name NOT LIKE 'order%' AND name LIKE '%7'")
_selected("by_path", 'by_path("(customer|order)/[^/]*U.*", %%)', _where("regexp_full_match(file_name, '(customer|order)/[^/]*U.*')"))
_selected("inline_specified", "inline_specified(%%)", _where("is_inlined"))
_selected("in_system_header", "in_system_header(%%)", _where("in_system_header"))
_selected("contains_unresolved_calls", "contains_unresolved_calls(%%)", _where("ptr"))
_selected("flops", 'flops(">=", 30, %%)', _where("flo >= 30"))
_selected("memops", 'memops("<", 10, %%)', _where("mem < 10"))
_selected("loop_depth", 'loop_depth("!=", 2, %%)', _where("ld <> 2"))
_selected("nested_filters", 'flops(">", 5, loop_depth("<=", 2, inline_specified(%%)))', _where("flo > 5 AND ld <= 2 AND is_inlined"))
_selected("set_union", 'join(flops(">=", 45, %%), inline_specified(%%))', _where("coalesce(flo >= 45, false) OR is_inlined"))
_selected("set_intersect", 'intersect(flops("<=", 20, %%), in_system_header(%%))', _where("flo <= 20 AND in_system_header"))
_selected("set_subtract", 'subtract(by_name(".* (widget|bolt)", %%), inline_specified(%%))', _where("regexp_full_match(demangled_name, '.* (widget|bolt)') AND NOT is_inlined"))
_selected("compute_call_paths", 'compute = flops(">=", 10, loop_depth(">=", 1, %%)) callpaths = on_call_path_to(%compute)', "SELECT name FROM up", tables=L + ", " + _up("SELECT name FROM functions WHERE flo >= 10 AND ld >= 1"))
_selected("on_call_path_to", 'on_call_path_to(by_name("@part_7", %%))', "SELECT name FROM up", tables=L + ", " + _up("SELECT 'part_7' AS name"))
_selected("on_call_path_from", 'on_call_path_from(by_name("@nation_3", %%))', "SELECT name FROM down", tables=L + ", down AS (SELECT 'nation_3' AS name UNION SELECT e.dst FROM down JOIN all_edges e ON e.src = down.name)")
_selected("on_call_path_from_cyclic", 'on_call_path_from(by_name("@part_1.", %%))', "SELECT name FROM nodes WHERE regexp_full_match(name, 'part_1.') UNION SELECT b FROM r WHERE regexp_full_match(a, 'part_1.')", derived.cyclic, C)

_COARSE = """, n_calls AS (SELECT dst, count(*) AS n, min(src) AS p FROM calls GROUP BY dst),
reached AS (SELECT name FROM names WHERE name NOT IN (SELECT dst FROM calls) UNION SELECT c.dst FROM reached JOIN calls c ON c.src = reached.name)"""
_CUT = "x.name IN (SELECT name FROM reached) AND NOT EXISTS (SELECT 1 FROM n_calls k WHERE k.dst = x.name AND k.n = 1 {} AND (k.p IN (SELECT dst FROM n_calls WHERE n = 1) OR k.p IN (SELECT name FROM x)))"
_selected("coarse", "coarse(%%)", "SELECT name FROM x WHERE " + _CUT.format(""), tables=L + _COARSE + ", x AS (SELECT name FROM names)")
_selected(
    "coarse_critical", 'coarse(by_name("@(cust|order|part)_.*", %%), by_name("@order_.*5", %%))', "SELECT name FROM x WHERE " + _CUT.format("AND NOT (k.dst LIKE 'order_%' AND k.dst LIKE '%5')"),
    tables=L + _COARSE + ", x AS (SELECT name FROM names WHERE regexp_full_match(name, '(cust|order|part)_.*'))",
)
_DEPTH = "d AS (SELECT name, 0 AS depth FROM {0} WHERE name NOT IN (SELECT dst FROM {1}) UNION SELECT e.dst, d.depth + 1 FROM d JOIN {1} e ON e.src = d.name WHERE d.depth < 200)"
_selected("min_call_depth", 'min_call_depth(">=", 3, %%)', "SELECT name FROM d GROUP BY name HAVING min(depth) >= 3", tables=L + ", " + _DEPTH.format("names", "all_edges"))


@query("min_call_depths_cyclic", "SELECT n.name, CAST(coalesce(min(depth), 2147483647) AS INTEGER) AS depth FROM nodes n LEFT JOIN d USING (name) GROUP BY n.name", C + ", " + _DEPTH.format("nodes", "edges"))
def min_call_depths_cyclic(spark, sf_dir):
    graph = derived.cyclic(spark, sf_dir)
    return paths.min_call_depths(graph, graph.names)


@query("include_list", "SELECT name FROM names WHERE name IN ('part_7', 'supp_3', 'nowhere')", L)
def _include(spark, sf_dir):
    return derived.layered(spark, sf_dir).functions.where(include_list(["part_7", "supp_3", "nowhere"])).select("name")


@query("exclude_list", "SELECT name FROM names WHERE name NOT IN ('part_7', 'supp_3', 'nowhere')", L)
def _exclude(spark, sf_dir):
    return derived.layered(spark, sf_dir).functions.where(exclude_list(["part_7", "supp_3", "nowhere"])).select("name")


@query("is_destructor", "SELECT name, name LIKE '%D1Ev' AS destructor FROM (SELECT '_ZN' || length(p_brand) || p_brand || (CASE WHEN p_partkey % 3 = 0 THEN 'D1Ev' ELSE '3fooEv' END) AS name FROM part)")
def _destructor(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("_ZN"), F.length("p_brand").cast("string"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "D1Ev").otherwise("3fooEv"))
    return part.select(name.alias("name")).withColumn("destructor", is_destructor(F.col("name")))


@query("demangled_parts", "SELECT p_partkey, 'ns::' || p_brand || '::run' AS base, [p_type || '<int, float>', 'int'] AS params FROM part")
def _demangled(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    full = F.concat(F.lit("void ns::"), "p_brand", F.lit("<"), "p_type", F.lit("<int> >::run("), "p_type", F.lit("<int, float>, int)"))
    return part.select("p_partkey", base_name(full).alias("base"), parameter_list(full).alias("params"))


_FLAGS = "flags AS (SELECT 'part_' || p_partkey AS name, CAST(p_size % 16 AS INTEGER) AS flags FROM part)"


def _flags(spark, sf_dir, modulus: int = 16) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") % modulus).cast("int").alias("flags"))


@query("flag_predicates", "SELECT name, (flags & 1) <> 0 AS always, (flags & 4) <> 0 AS begins, (flags & 8) <> 0 AS ends, (flags & 15) <> 0 AS accepted FROM flags", _FLAGS)
def _predicates(spark, sf_dir):
    f = F.col("flags")
    return _flags(spark, sf_dir).select("name", has_flag(f, ALWAYS).alias("always"), has_flag(f, BEGIN_TRIGGER).alias("begins"), has_flag(f, END_TRIGGER).alias("ends"), accepted(f).alias("accepted"))


@query("flag_merge", "SELECT name, CAST(bit_or(flags) AS INTEGER) AS flags FROM (SELECT * FROM flags UNION ALL SELECT 'part_' || p_partkey, CAST(p_size % 5 AS INTEGER) FROM part UNION ALL SELECT 'supp_' || s_suppkey, 1 FROM supplier) GROUP BY name", _FLAGS)
def _merge(spark, sf_dir):
    supp = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("supp_"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(1).alias("flags"))
    return sets.merge_flags(_flags(spark, sf_dir), _flags(spark, sf_dir, 5), supp)


_HINTED = 'hot = flops(">=", 40, %%) cold = memops("<", 20, %%) !instrument(%hot) !begin_at(%cold) !end_at(%hot)'


@query("hinted_flags", "SELECT name, CAST(bit_or(f) AS INTEGER) AS flags FROM (SELECT name, 9 AS f FROM functions WHERE flo >= 40 UNION ALL SELECT name, 4 FROM functions WHERE mem < 20) GROUP BY name", L)
def _hinted(spark, sf_dir):
    return select(derived.layered(spark, sf_dir), _HINTED).flags()


@query("selection_counts", "SELECT 'hot' AS selector, count(*) AS selected FROM functions WHERE flo >= 40 UNION ALL SELECT 'cold', count(*) FROM functions WHERE mem < 20", L)
def _counts(spark, sf_dir):
    return select(derived.layered(spark, sf_dir), _HINTED).counts()


@query("override_closure", "SELECT src, dst FROM ov", L)
def _closure(spark, sf_dir):
    return override_closure(derived.layered(spark, sf_dir).overrides)


@query("virtual_edges", "SELECT src, dst FROM all_edges", L)
def _virtual(spark, sf_dir):
    return derived.layered(spark, sf_dir).all_edges


@query("removed_calls", "SELECT src, dst, is_virtual FROM calls WHERE NOT (src = 'nation_3' OR dst = 'part_7')", L)
def _removed(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    return graph.without_calls(graph.calls.where("src = 'nation_3' or dst = 'part_7'")).calls


@query("roots", "SELECT name FROM names WHERE name NOT IN (SELECT dst FROM calls)", L)
def _roots(spark, sf_dir):
    return paths.roots(derived.layered(spark, sf_dir))


@query("caller_count", "SELECT dst AS name, count(*) AS callers FROM calls GROUP BY dst", L)
def _callers(spark, sf_dir):
    return paths.caller_count(derived.layered(spark, sf_dir))


@query("scc_membership", "SELECT name, scc FROM scc", C)
def _scc(spark, sf_dir):
    return derived.cyclic(spark, sf_dir).scc


@query("scc_stats", "SELECT count(*) AS n_scc, max(size) AS largest, count(*) FILTER (size > 1) AS larger_than_1, count(*) FILTER (size > 2) AS larger_than_2 FROM (SELECT scc, count(*) AS size FROM scc GROUP BY scc)", C)
def _stats(spark, sf_dir):
    return scc_stats(derived.cyclic(spark, sf_dir).scc)


@query("scc_condensation", "SELECT DISTINCT a.scc AS src, b.scc AS dst FROM edges JOIN scc a ON a.name = src JOIN scc b ON b.name = dst WHERE a.scc <> b.scc", C)
def _condensed(spark, sf_dir):
    return derived.cyclic(spark, sf_dir).scc_edges


def _avoid(x: str, target: str) -> str:
    """Nodes n that reach the target without passing m."""
    return f"""up_{x} AS (SELECT '{target}' AS name UNION SELECT e.src FROM up_{x} u JOIN all_edges e ON e.dst = u.name),
avoid_{x} AS (SELECT m.name AS m, '{target}' AS n FROM up_{x} m WHERE m.name <> '{target}' UNION SELECT v.m, e.src FROM avoid_{x} v JOIN all_edges e ON e.dst = v.n WHERE e.src <> v.m)"""


@query("postdom", "SELECT n.name, m.name AS dom FROM up_a n, up_a m WHERE NOT EXISTS (SELECT 1 FROM avoid_a v WHERE v.m = m.name AND v.n = n.name)", L, _avoid("a", "part_7"))
def _postdom(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    return post_dominators(spark.createDataFrame([("part_7",)], "name string"), graph.all_edges)


_A, _B = "part_7", "part_12"
_CALLERS = f"""{_avoid("a", _A)}, {_avoid("b", _B)},
ca AS (SELECT name FROM up_a INTERSECT SELECT name FROM up_b),
lca AS (SELECT name FROM ca WHERE name NOT IN (SELECT e.src FROM all_edges e JOIN ca ON ca.name = e.dst)),
only_a AS (SELECT DISTINCT e.src AS name FROM all_edges e JOIN ca ON ca.name = e.src WHERE e.dst IN (SELECT name FROM up_a) AND e.dst NOT IN (SELECT name FROM up_b)),
only_b AS (SELECT DISTINCT e.src AS name FROM all_edges e JOIN ca ON ca.name = e.src WHERE e.dst IN (SELECT name FROM up_b) AND e.dst NOT IN (SELECT name FROM up_a)),
cand AS (SELECT name FROM lca UNION SELECT n.name FROM ca n WHERE NOT EXISTS (SELECT 1 FROM ca m WHERE m.name <> n.name
  AND NOT EXISTS (SELECT 1 FROM avoid_a v WHERE v.m = m.name AND v.n = n.name) AND NOT EXISTS (SELECT 1 FROM avoid_b v WHERE v.m = m.name AND v.n = n.name))),
cost_a AS (SELECT '{_A}' AS name, 0 AS c UNION SELECT e.src, k.c + CASE WHEN k.name IN (SELECT name FROM cand) THEN 1 ELSE 0 END FROM cost_a k JOIN all_edges e ON e.dst = k.name),
cost_b AS (SELECT '{_B}' AS name, 0 AS c UNION SELECT e.src, k.c + CASE WHEN k.name IN (SELECT name FROM cand) THEN 1 ELSE 0 END FROM cost_b k JOIN all_edges e ON e.dst = k.name),
measured AS (SELECT n.name, greatest((SELECT min(c) FROM cost_a k WHERE k.name = n.name), (SELECT min(c) FROM cost_b k WHERE k.name = n.name)) AS cdist,
  (n.name IN (SELECT name FROM lca) OR n.name IN (SELECT name FROM only_a) OR n.name IN (SELECT name FROM only_b)) AS p,
  (n.name IN (SELECT name FROM lca) OR (n.name IN (SELECT name FROM only_a) AND n.name IN (SELECT name FROM only_b))) AS d FROM cand n)"""
_BETWEEN = """, proper AS (SELECT name FROM up_a WHERE name <> '%s' UNION SELECT name FROM up_b WHERE name <> '%s'),
found AS (SELECT name FROM measured WHERE {} UNION SELECT e.dst FROM found f JOIN all_edges e ON e.src = f.name WHERE e.dst IN (SELECT name FROM proper))""" % (_A, _B)


def _common(name: str, call: str, condition: str) -> None:
    text = f'{call}by_name("@{_A}", %%), by_name("@{_B}", %%))'
    _selected(name, text, f"SELECT name FROM found UNION SELECT '{_A}' UNION SELECT '{_B}'", tables=L + ", " + _CALLERS + _BETWEEN.format(condition))


_common("common_caller", "common_caller(", "true")
_common("common_caller_near", "common_caller(0, ", "cdist <= 0")
_common("common_caller_partial", "common_caller_partial(1, ", "cdist <= 1 AND p")
_common("common_caller_distinct", "common_caller_distinct(", "d")


@query(
    "lca_histogram",
    """SELECT k AS cdist, n_all, n_partial, n_distinct, CAST(sum(n_all) OVER (ORDER BY k) AS BIGINT) AS up_to_all, CAST(sum(n_partial) OVER (ORDER BY k) AS BIGINT) AS up_to_partial, CAST(sum(n_distinct) OVER (ORDER BY k) AS BIGINT) AS up_to_distinct
FROM (SELECT k, count(m.name) AS n_all, count(*) FILTER (m.p) AS n_partial, count(*) FILTER (m.d) AS n_distinct FROM range(11) t(k) LEFT JOIN measured m ON least(m.cdist, 10) = k GROUP BY k)""",
    L, _CALLERS,
)
def _histogram(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    pick = lambda n: graph.names.where(F.col("name") == n)
    return callers.lca_histogram(callers.analyse(graph, pick(_A), pick(_B)))


@query("reachable_subgraph", "SELECT name, CASE WHEN name IN (SELECT name FROM ca) THEN 'green' WHEN name IN (SELECT name FROM up_a) THEN 'red' ELSE 'blue' END AS colour FROM (SELECT name FROM up_a UNION SELECT name FROM up_b)", L, _CALLERS)
def _subgraph(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    pick = lambda n: graph.names.where(F.col("name") == n)
    return callers.reachable_subgraph(callers.analyse(graph, pick(_A), pick(_B)))


_SYMBOLS = "symbols AS (SELECT name FROM functions WHERE NOT is_inlined AND NOT ptr AND name NOT LIKE 'order%3')"


def _symbols(graph) -> DataFrame:
    return graph.functions.where("not is_inlined and not contains_pointer_call and name not like 'order%3'").select("name")


@query(
    "inline_compensation",
    "SELECT name FROM functions WHERE is_inlined AND name IN (SELECT name FROM symbols) UNION SELECT c.src FROM hidden h JOIN calls c ON c.dst = h.name WHERE c.src IN (SELECT name FROM symbols)",
    L, _SYMBOLS, "hidden AS (SELECT name FROM functions WHERE is_inlined AND name NOT IN (SELECT name FROM symbols) UNION SELECT c.src FROM hidden h JOIN calls c ON c.dst = h.name WHERE c.src NOT IN (SELECT name FROM symbols))",
)
def _inline(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    return inline.replace_inlined(graph, select(graph, "inline_specified(%%)").names, _symbols(graph))


@query("symbol_semi_anti", "SELECT name, name IN (SELECT name FROM symbols) AS has_symbol FROM names", L, _SYMBOLS)
def _semi_anti(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    names, symbols = graph.functions.select("name"), _symbols(graph)
    return inline.with_symbol(names, symbols).withColumn("has_symbol", F.lit(True)).union(inline.without_symbol(names, symbols).withColumn("has_symbol", F.lit(False)))


@query("call_depth", "SELECT thread, seq, id, depth FROM depths WHERE matched", E)
def _depth(spark, sf_dir):
    return call_depth(derived.trace(spark, sf_dir)).where("matched").select("thread", "seq", "id", "depth")


_GATE = """gate AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'signup' AND type = 'ENTRY' THEN true WHEN kind = 'error' AND type = 'EXIT' THEN false END IGNORE NULLS)
  OVER (PARTITION BY thread ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR kind = 'signup' AS active FROM trace)"""


@query("begin_end_gate", "SELECT thread, seq, id, active FROM gate", E, _GATE)
def _gate(spark, sf_dir):
    return begin_end_gate(derived.trace(spark, sf_dir), F.col("kind") == "signup", F.col("kind") == "error").select("thread", "seq", "id", "active")


_SCOPE = """framed AS (SELECT *, CASE WHEN type = 'ENTRY' THEN CASE WHEN id < 5 THEN 1 ELSE 0 END ELSE -lag(CASE WHEN id < 5 AND type = 'ENTRY' THEN 1 ELSE 0 END) OVER (PARTITION BY thread, level ORDER BY seq) END AS step FROM depths WHERE matched),
held AS (SELECT *, sum(step) OVER (PARTITION BY thread ORDER BY seq) AS h FROM framed)"""


@query("scope_gate", "SELECT thread, seq, id, (h > 0 OR step < 0) AS active FROM held", E, _SCOPE)
def _scope(spark, sf_dir):
    return scope_gate(derived.trace(spark, sf_dir), F.col("id") < 5).select("thread", "seq", "id", "active")


@query(
    "trace_values",
    """SELECT d.thread, d.seq, d.id, d.level - 1 AS depth, CASE WHEN d.type = 'ENTRY' OR d.level = 1 THEN CASE WHEN d.type = 'ENTRY' THEN d.id ELSE 0 END
  ELSE (SELECT arg_max(o.id, o.seq) FROM depths o WHERE o.thread = d.thread AND o.seq < d.seq AND o.type = 'ENTRY' AND o.level = d.level - 1) END AS value FROM depths d WHERE d.matched""",
    E,
)
def _values(spark, sf_dir):
    return recorded_trace(derived.trace(spark, sf_dir)).select("thread", "seq", "id", "depth", "value")


@query("call_log", "SELECT thread, seq, repeat('  ', level - 1) || CASE WHEN type = 'ENTRY' THEN 'ENTER' ELSE 'EXIT' END || ' fn_' || id AS line FROM depths WHERE matched", E)
def _log(spark, sf_dir):
    names = spark.range(50).select(F.col("id").cast("int").alias("fid"), F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("name"))
    return call_log(recorded_trace(derived.trace(spark, sf_dir)), names)


@query(
    "region_events",
    """SELECT thread, seq, id, 'fn_' || id AS name, unnest(CASE WHEN row_number() OVER (PARTITION BY id ORDER BY seq, thread) = 1 THEN ['register', a] ELSE [a] END) AS action
FROM (SELECT *, CASE WHEN type = 'ENTRY' THEN 'start' ELSE 'stop' END AS a FROM trace)""",
    E,
)
def _regions(spark, sf_dir):
    names = spark.range(50).select(F.col("id").cast("int").alias("fid"), F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("name"))
    return region_events(derived.trace(spark, sf_dir), names)


@query("address_asof", "SELECT p.event_id, p.addr, m.addr_begin, m.path FROM (SELECT event_id, event_id * 11 AS addr FROM events) p ASOF LEFT JOIN (SELECT s_suppkey * 1000 + 13 AS addr_begin, s_name AS path FROM supplier) m ON p.addr >= m.addr_begin")
def _asof(spark, sf_dir):
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") * 11).alias("addr"))
    marks = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 1000 + 13).alias("addr_begin"), F.col("s_name").alias("path"))
    return resolve.last_before(probes, marks)


_PATCHED = "patched AS (SELECT CAST(p_partkey AS INTEGER) AS fid, 'part_' || p_partkey AS name FROM part WHERE p_size > 3)"


def _patched(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 3").select(F.col("p_partkey").cast("int").alias("fid"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("demangled"))


@query("patch_plan", "SELECT fid, name, flags, (flags & 2) <> 0 AS is_scope, (flags & 4) <> 0 AS is_begin, (flags & 8) <> 0 AS is_end FROM patched JOIN flags USING (name) WHERE (flags & 15) <> 0", _FLAGS, _PATCHED)
def _plan(spark, sf_dir):
    return resolve.patch_plan(_patched(spark, sf_dir), _flags(spark, sf_dir))


@query("patch_counts", "SELECT (SELECT count(*) FROM patched) AS found, (SELECT count(*) FROM patched JOIN flags USING (name) WHERE (flags & 15) <> 0) AS patched, (SELECT count(*) FROM flags WHERE (flags & 15) <> 0 AND name NOT IN (SELECT name FROM patched)) AS failed", _FLAGS, _PATCHED)
def _patch_counts(spark, sf_dir):
    return resolve.patch_counts(_patched(spark, sf_dir), _flags(spark, sf_dir))


@query("event_dictionary", "SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS description FROM part WHERE p_size > 3")
def _dictionary(spark, sf_dir):
    return event_dictionary(_patched(spark, sf_dir))


@query("name_list_lines", "SELECT name AS line FROM flags WHERE (flags & 1) <> 0", _FLAGS)
def _name_list(spark, sf_dir):
    return name_list(_flags(spark, sf_dir))


@query("region_filter_lines", "SELECT name AS line FROM flags WHERE (flags & 1) <> 0 UNION ALL SELECT * FROM (VALUES ('SCOREP_REGION_NAMES_BEGIN'), ('EXCLUDE *'), ('INCLUDE MANGLED'), ('SCOREP_REGION_NAMES_END')) t(line)", _FLAGS)
def _region_filter(spark, sf_dir):
    return region_filter(_flags(spark, sf_dir))


@query("json_filter_lines", """SELECT (CASE WHEN name = (SELECT min(name) FROM flags) THEN '' ELSE ',' END) || '"' || name || '":{"flags":' || flags || '}' AS line FROM flags UNION ALL SELECT * FROM (VALUES ('{"selection":{'), ('}}')) t(line)""", _FLAGS)
def _json_filter(spark, sf_dir):
    return json_filter(_flags(spark, sf_dir))


_DOT = """SELECT '  "' || name || '" [label="' || name || '"]' AS line FROM kept UNION ALL SELECT '  "' || src || '" -> "' || dst || '"' FROM all_edges WHERE src IN (SELECT name FROM kept) AND dst IN (SELECT name FROM kept) UNION ALL SELECT 'digraph {' UNION ALL SELECT '}'"""


@query("dot_lines", _DOT, L, "kept AS (SELECT name FROM names)")
def _dot(spark, sf_dir):
    return dot_lines(derived.layered(spark, sf_dir))


@query("dot_selection", _DOT, L, _FLAGS, "kept AS (SELECT name FROM names LEFT JOIN flags USING (name) WHERE coalesce(flags, 1) & 15 <> 0)")
def _dot_selection(spark, sf_dir):
    graph = derived.layered(spark, sf_dir)
    flags = graph.names.join(_flags(spark, sf_dir), "name", "left").select("name", F.coalesce("flags", F.lit(1)).alias("flags"))
    return dot_lines(graph, flags)


@query("merged_functions", "SELECT 'part_' || l_partkey AS name, max(l_linestatus) AS file_name, bool_or(l_returnflag = 'R') AS is_inlined FROM lineitem GROUP BY l_partkey")
def _merged(spark, sf_dir):
    declared = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_linestatus").alias("file_name"), (F.col("l_returnflag") == "R").alias("is_inlined"))
    none = spark.createDataFrame([], "src string, dst string, is_virtual boolean")
    return CallGraph.build(declared, none, none).functions.select("name", "file_name", "is_inlined")


@query("parsed_symbols", "SELECT 'app' AS binary, s_nationkey + 16 AS addr, max('sym_' || s_suppkey) AS name FROM supplier GROUP BY s_nationkey")
def _parsed_symbols(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = supplier.select(F.concat(F.lit("0000"), F.lower(F.hex(F.col("s_nationkey") + 16)), F.lit(" T sym_"), F.col("s_suppkey").cast("string")).alias("value"))
    return parse_symbols(lines, "app")


@query("parsed_dependencies", "SELECT '/lib/' || s_name AS path FROM supplier WHERE s_suppkey % 3 <> 0")
def _parsed_dependencies(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    lines = supplier.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\t"), "s_name", F.lit(" (0x7f)"))).otherwise(F.concat(F.lit("\tlib.so => /lib/"), "s_name", F.lit(" (0x7f)"))).alias("value"))
    return parse_dependencies(lines)


@query("parsed_memory_map", "SELECT '/lib/' || s_name AS path, s_suppkey * 4096 AS addr_begin, CAST(s_nationkey AS BIGINT) AS offset FROM supplier WHERE s_suppkey % 2 = 0")
def _parsed_map(spark, sf_dir):
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    hexed = lambda c: F.lower(F.hex(c))
    begin, rights = F.col("s_suppkey") * 4096, F.when(F.col("s_suppkey") % 2 == 0, " r-xp ").otherwise(" rw-p ")
    lines = supplier.select(F.concat(hexed(begin), F.lit("-"), hexed(begin + 4096), rights, hexed(F.col("s_nationkey")), F.lit(" 08:01 77   /lib/"), "s_name").alias("value"))
    return parse_memory_map(lines)


@query("unique_ids", "SELECT l_orderkey % 7 AS obj_id, l_partkey AS fid, min(l_linestatus) AS name FROM lineitem GROUP BY ALL")
def _unique_ids(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 7).alias("obj_id"), F.col("l_partkey").alias("fid"), F.col("l_linestatus").alias("name"))
    return id_map(rows)


_OPEN = "open AS (SELECT thread, min(seq) FILTER (WHERE kind = 'view') AS lo, max(seq) FILTER (WHERE kind = 'click') AS hi FROM trace GROUP BY thread)"


@query("recorded_within", "SELECT t.thread, t.seq, t.id, t.type FROM trace t JOIN open o ON o.thread = t.thread WHERE t.seq >= o.lo AND (o.hi IS NULL OR t.seq < o.hi)", E, _OPEN)
def _within(spark, sf_dir):
    trace = derived.trace(spark, sf_dir)
    intervals = trace.groupBy("thread").agg(F.min(F.when(F.col("kind") == "view", F.col("seq"))).alias("begin"), F.max(F.when(F.col("kind") == "click", F.col("seq"))).alias("end"))
    return within(trace, intervals, "seq", "thread").select("thread", "seq", "id", "type")


@query("windowed_calls", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(event_id % 50 AS INTEGER) AS id, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'ENTRY' ELSE 'EXIT' END AS type, count(*) AS calls FROM events GROUP BY ALL")
def _windowed(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    type_ = F.when(F.col("event_type").isin("click", "view", "signup"), "ENTRY").otherwise("EXIT")
    calls = windowed_calls(events.select(F.col("ts").cast("timestamp"), F.pmod("event_id", F.lit(50)).cast("int").alias("id"), type_.alias("type")), late="10 minutes")
    return calls.select(F.date_format("begin", "yyyy-MM-dd HH").alias("hour"), "id", "type", "calls")


_RESOLVED = "resolved AS (SELECT CAST(n AS BIGINT) AS addr, 'fn_' || n AS symbol FROM range(50) t(n) WHERE n % 7 <> 0)"


@query(
    "call_tree_log",
    """SELECT d.thread, d.seq, repeat('  ', d.level - 1) || CASE WHEN d.type = 'ENTRY' THEN '[ENTER]' ELSE '[EXIT]' END || ' 0x' || printf('%x', d.id) || ' ' || coalesce(a.symbol, 'UNKNOWN') || ' (callsite: ' || coalesce(b.symbol, 'UNKNOWN') || ')' AS line
FROM depths d LEFT JOIN resolved a ON a.addr = d.id LEFT JOIN resolved b ON b.addr = (d.id + 1) % 50 WHERE d.matched""",
    E,
    _RESOLVED,
)
def _tree_log(spark, sf_dir):
    trace = recorded_trace(derived.trace(spark, sf_dir)).withColumn("addr", F.col("id").cast("long")).withColumn("callsite", (F.col("addr") + 1) % 50)
    resolved = spark.range(50).where("id % 7 <> 0").select(F.col("id").alias("addr"), F.concat(F.lit("fn_"), F.col("id").cast("string")).alias("symbol"))
    return call_tree_log(trace, resolved)


@query("gnu_callbacks", "SELECT thread, seq, CASE WHEN type = 'ENTRY' THEN 'enter' ELSE 'exit' END AS callback, id * 16 AS addr FROM trace WHERE id % 3 <> 0", E)
def _callbacks(spark, sf_dir):
    patched = spark.range(50).where("id % 3 <> 0").select(F.col("id").cast("int").alias("fid"), (F.col("id") * 16).alias("addr"))
    return gnu_callbacks(derived.trace(spark, sf_dir), patched)


@query("region_registrations", "SELECT p_partkey * 16 AS addr, 'part_' || p_partkey AS name, p_name AS demangled FROM part WHERE p_size > 3")
def _registrations(spark, sf_dir):
    return region_registrations(_patched(spark, sf_dir).withColumn("addr", F.col("fid").cast("long") * 16))


@query("set_dump", "SELECT name AS line FROM functions WHERE is_inlined", L)
def _set_dump(spark, sf_dir):
    return set_dump(select(derived.layered(spark, sf_dir), "hot = inline_specified(%%)  join(%hot, %hot)"), "hot")


_BINARIES = "binaries AS (SELECT 'lib' || s_suppkey % 5 AS binary, s_suppkey AS addr, 'sym_' || s_suppkey % 100 AS name FROM supplier)"


def _binaries(spark, sf_dir) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return supplier.select(F.concat(F.lit("lib"), (F.col("s_suppkey") % 5).cast("string")).alias("binary"), F.col("s_suppkey").alias("addr"), F.concat(F.lit("sym_"), (F.col("s_suppkey") % 100).cast("string")).alias("name"))


@query("symbol_sets", "SELECT DISTINCT b.binary AS binary, name FROM binaries b WHERE b.binary IN ('lib1', 'lib2', 'lib3')", _BINARIES)
def _symbol_sets(spark, sf_dir):
    every = _binaries(spark, sf_dir)
    return symbol_sets({b: every.where(F.col("binary") == b) for b in ("lib1", "lib2", "lib3")}, "lib1")


@query("mapped_symbols", "SELECT b.binary AS path, CAST(n_nationkey AS BIGINT) * 4096 AS addr_begin, CAST(n_regionkey AS BIGINT) AS \"offset\", addr, b.name FROM binaries b JOIN nation ON b.binary = 'lib' || n_nationkey", _BINARIES)
def _mapped(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    maps = nation.select(F.concat(F.lit("lib"), F.col("n_nationkey").cast("string")).alias("path"), (F.col("n_nationkey").cast("long") * 4096).alias("addr_begin"), F.col("n_regionkey").cast("long").alias("offset"))
    return mapped_symbols(maps, _binaries(spark, sf_dir))


@query("resolved_symbols", """SELECT e.event_id, e.event_id * 3 AS addr, m.path, b.name AS symbol FROM events e
ASOF LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) * 97 AS addr_begin, 'lib' || n_nationkey AS path FROM nation) m ON e.event_id * 3 >= m.addr_begin LEFT JOIN binaries b ON b.binary = m.path AND b.addr = e.event_id * 3 - m.addr_begin""", _BINARIES)
def _resolved(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    maps = nation.select(F.concat(F.lit("lib"), F.col("n_nationkey").cast("string")).alias("path"), (F.col("n_nationkey").cast("long") * 97).alias("addr_begin"), F.lit(0).cast("long").alias("offset"))
    probes = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") * 3).alias("addr"))
    return resolve.resolve_addresses(probes, maps, _binaries(spark, sf_dir)).select("event_id", "addr", "path", "symbol")


@query("direct_ancestors", "SELECT name FROM up", L, _up("SELECT 'part_7' AS name", "calls"))
def _direct(spark, sf_dir):
    from .operators.iterate import reach

    graph = derived.layered(spark, sf_dir)
    return reach(spark.createDataFrame([("part_7",)], "name string"), reversed_edges(graph.direct_edges))
