"""Operators against plain Python on random graphs."""

import random

import pytest
from graphs import build, names

from graphselect.operators import inline, paths
from graphselect.operators.components import strongly_connected
from graphselect.operators.postdom import post_dominators


def closure(edges, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_random_graph(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(12)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(18)]
    graph = build(spark, " ".join(f"{a}>{b}" for a, b in pairs))
    used = {x for p in pairs for x in p}
    # components
    reach = {n: closure(pairs, [n]) for n in used}
    want = {n: min(m for m in used if m in reach[n] and n in reach[m]) for n in used}
    assert {r["name"]: r["scc"] for r in strongly_connected(graph.names, graph.all_edges).collect()} == want
    # coarse
    roots = used - {b for _, b in pairs}
    inside = {n for n in used if rng.random() < 0.7}
    critical = {n for n in used if rng.random() < 0.2}
    calls = {n: [a for a, b in pairs if b == n] for n in used}
    kept = {n for n in inside & closure(pairs, roots) if not (len(calls[n]) == 1 and n not in critical and (len(calls[calls[n][0]]) == 1 or calls[n][0] in inside))}
    frame = lambda s: spark.createDataFrame([(x,) for x in sorted(s)], "name string")
    assert names(paths.coarse(graph, frame(inside), frame(critical))) == kept
    # inline compensation
    symbols = {n for n in used if rng.random() < 0.5}
    want, seen, todo = inside & symbols, set(), list(inside - symbols)
    while todo:
        x = todo.pop()
        if x in seen:
            continue
        seen.add(x)
        for a in calls[x]:
            (want.add if a in symbols else todo.append)(a)
    assert names(inline.replace_inlined(graph, frame(inside), frame(symbols))) == want


@pytest.mark.parametrize("seed", range(2))
def test_post_dominators(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{a:02}", f"n{b:02}") for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(20)) if a < b}
    target = "n08"
    above = {n for n in {a for a, _ in edges} if target in closure(edges, [n])} | {target}
    want = {(n, m) for n in above for m in above if n == m or target not in closure({e for e in edges if m not in e}, [n]) or (m == target)}
    frame = spark.createDataFrame([(target,)], "name string")
    assert {tuple(r) for r in post_dominators(frame, spark.createDataFrame(sorted(edges), "src string, dst string")).collect()} == want


def test_long_cycle(spark):
    order = random.Random(5).sample(range(40), 40)
    ring = [(f"n{a:02}", f"n{b:02}") for a, b in zip(order, order[1:] + order[:1])]
    tail = [("n07", "t0"), ("t0", "t1"), ("t1", "t2")]
    found = strongly_connected(spark.createDataFrame([(n,) for n in {x for e in ring + tail for x in e}], "name string"), spark.createDataFrame(ring + tail, "src string, dst string"))
    assert {r["name"]: r["scc"] for r in found.collect()} == {**{a: "n00" for a, _ in ring}, "t0": "t0", "t1": "t1", "t2": "t2"}
