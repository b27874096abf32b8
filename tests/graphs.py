"""Small call graphs written as edge lists."""

import json

from graphselect.model import CallGraph


def build(spark, calls, virtual=(), overrides=(), functions=None, dtors=False):
    """calls: "a>b c>d"; virtual: pairs that are virtual; functions: name -> columns."""
    pairs = [tuple(x.split(">")) for x in calls.split()]
    rows = [(a, b, (a, b) in set(virtual)) for a, b in pairs]
    names = sorted({x for p in pairs for x in p} | {x for p in overrides for x in p} | set(functions or ()))
    declared = [(n, n, *((functions or {}).get(n, {}).get(k) for k in ("parameters", "meta"))) for n in names]
    return CallGraph.build(
        spark.createDataFrame(declared, "name string, demangled_name string, parameters array<string>, meta string"),
        spark.createDataFrame(rows, "src string, dst string, is_virtual boolean"),
        spark.createDataFrame(list(overrides), "src string, dst string"),
        dtors,
    )


def meta(**metrics):
    return json.dumps({"loopDepth": metrics.get("loop", 0), "numOperations": {"numberOfFloatOps": metrics.get("flops", 0), "numberOfMemoryAccesses": metrics.get("mem", 0)}})


def names(df):
    return {r["name"] for r in df.collect()}
