import random

import pytest
from pyspark.sql import functions as F

from graphselect.operators.resolve import last_before, resolve_addresses
from graphselect.streaming import TraceMachine, call_log_stream, planned_stream, recorded_trace, region_events, region_stream, trace_stream, windowed_calls, within


def random_events(seed, threads=3, n=60):
    rng = random.Random(seed)
    return [(t, k, rng.randrange(6), rng.choice(["ENTRY", "ENTRY", "EXIT", "TAIL"])) for t in range(threads) for k in range(n)]


@pytest.mark.parametrize("begin, end, scope", [((), (), ()), ((1,), (2,), ()), ((), (), (3,)), ((1,), (), (3, 4))])
def test_windows_agree_with_the_machine(spark, begin, end, scope):
    events = random_events(len(begin) + 2 * len(end) + 4 * len(scope))
    machines, want = {}, set()
    for t, k, i, kind in events:
        found = machines.setdefault(t, TraceMachine(frozenset(begin), frozenset(end), frozenset(scope))).event(i, kind)
        if found:
            want.add((t, k, i, kind, *found))
    df = spark.createDataFrame(events, "thread long, seq long, id int, type string")
    isin = lambda s: F.col("id").isin(*s) if s else None
    assert {tuple(r) for r in recorded_trace(df, isin(begin), isin(end), isin(scope)).collect()} == want


def test_nested_calls(spark):
    events = [(0, 0, 1, "ENTRY"), (0, 1, 2, "ENTRY"), (0, 2, 2, "ENTRY"), (0, 3, 2, "EXIT"), (0, 4, 2, "EXIT"), (0, 5, 1, "EXIT"), (0, 6, 1, "EXIT")]
    found = recorded_trace(spark.createDataFrame(events, "thread long, seq long, id int, type string")).orderBy("seq").collect()
    assert [(r["depth"], r["value"]) for r in found] == [(0, 1), (1, 2), (2, 2), (2, 2), (1, 1), (0, 0)]


def test_as_of(spark):
    marks = spark.createDataFrame([(10, "a"), (100000, "b"), (100050, "c")], "addr_begin long, path string")
    probes = spark.createDataFrame([(5,), (10,), (99999,), (100000,), (100049,), (900000,)], "addr long")
    assert {r["addr"]: r["path"] for r in last_before(probes, marks).collect()} == {5: None, 10: "a", 99999: "a", 100000: "b", 100049: "b", 900000: "c"}
    maps = marks.withColumn("offset", F.lit(7))
    symbols = spark.createDataFrame([("a", 12, "f")], "binary string, addr long, name string")
    assert {r["addr"]: r["symbol"] for r in resolve_addresses(spark.createDataFrame([(15,), (16,)], "addr long"), maps, symbols).collect()} == {15: "f", 16: None}


def test_stream(spark, tmp_path):
    events = random_events(9)
    df = spark.createDataFrame(events, "thread long, seq long, id int, type string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = trace_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), begin={1}, scope={3})
    run = stream.writeStream.format("memory").queryName("trace_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.table("trace_out").collect()}
    assert got == {tuple(r) for r in recorded_trace(df, F.col("id") == 1, None, F.col("id") == 3).collect()}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "thread long, seq long, id int, type string"


def run_stream(spark, tmp_path, df, make):
    """Rows of make(stream of df), which comes as one file."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_recording_gate_is_after_the_begin_gate(spark):
    """An entry that opens the gate outside of the interval is not recorded, but opens it."""
    events = spark.createDataFrame([(0, 0, 1, "ENTRY"), (0, 1, 2, "ENTRY"), (0, 2, 2, "EXIT"), (0, 3, 1, "EXIT"), (0, 4, 3, "ENTRY")], EVENTS)
    found = recorded_trace(events, F.col("id") == 1, recording=F.col("seq").between(1, 3)).orderBy("seq").collect()
    assert [(r["seq"], r["depth"], r["value"]) for r in found] == [(1, 0, 2), (2, 0, 0)]
    machine = TraceMachine(begin=frozenset([1]))
    assert [machine.event(r["id"], r["type"], 1 <= r["seq"] <= 3) for r in events.orderBy("seq").collect()] == [None, (0, 2), (0, 0), None, None]


def test_within(spark):
    events = spark.createDataFrame([(p, t) for p in ("p", "q", None) for t in range(6)], "process string, ts long")
    intervals = spark.createDataFrame([("p", 1, 3), ("p", 2, 4), ("q", 4, None)], "process string, begin long, end long")
    assert sorted(tuple(r) for r in within(events, intervals).collect()) == [("p", 1), ("p", 2), ("p", 3), ("q", 4), ("q", 5)]


def test_planned_stream(spark, tmp_path):
    df = spark.createDataFrame(random_events(17), EVENTS)
    plan = spark.createDataFrame([(i, i == 3, i == 1, i == 2) for i in range(5)], "fid int, is_scope boolean, is_begin boolean, is_end boolean")
    got = run_stream(spark, tmp_path, df, lambda s: planned_stream(s, plan))
    want = recorded_trace(df.where("id < 5"), F.col("id") == 1, F.col("id") == 2, F.col("id") == 3)
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and got


def test_region_stream(spark, tmp_path):
    events = [(0, k, *e) for k, e in enumerate([(1, "ENTRY"), (2, "ENTRY"), (2, "TAIL"), (3, "ENTRY"), (1, "EXIT"), (9, "ENTRY"), (1, "ENTRY"), (2, "ENTRY")])]
    df = spark.createDataFrame([(*e, e[1] >= 6) for e in events], EVENTS + ", finished boolean")
    names_ = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x" * 128)], "fid int, name string")
    got = run_stream(spark, tmp_path, df, lambda s: region_stream(s, names_))
    want = region_events(df, names_, finished=F.col("finished"))
    assert sorted(got) == sorted(tuple(r) for r in want.collect()) and len(got) == 6


def test_late_events_are_dropped(spark, tmp_path):
    """Two batches: an event that lies behind the watermark of the first one is dropped by both forms."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = EVENTS + ", ts timestamp"
    at = lambda m: F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.lit(12), F.lit(m), F.lit(0))
    batches = [spark.createDataFrame([(0, 0, 1, "ENTRY")], EVENTS).withColumn("ts", at(30)), spark.createDataFrame([(0, 1, 2, "ENTRY")], EVENTS).withColumn("ts", at(1)).union(spark.createDataFrame([(0, 2, 3, "ENTRY")], EVENTS).withColumn("ts", at(31)))]
    for k, make in enumerate([lambda s: trace_stream(s, late="10 minutes").select("id"), lambda s: windowed_calls(s, "5 minutes", late="10 minutes").select("id")]):
        folder, cp = str(tmp_path / f"in{k}"), str(tmp_path / f"cp{k}")
        got = set()
        for n, batch in enumerate([*batches, spark.createDataFrame([(0, 9, 9, "ENTRY")], EVENTS).withColumn("ts", at(59))]):
            batch.coalesce(1).write.mode("append").parquet(folder)
            stream = make(spark.readStream.schema(schema).parquet(folder))
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", cp).trigger(availableNow=True).start()
            run.awaitTermination(120)
        got = {r["id"] for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()}
        assert 2 not in got and {1, 3} <= got


def test_call_log_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    df = spark.createDataFrame([(0, 0, 1, "ENTRY"), (0, 1, 2, "ENTRY"), (0, 2, 2, "EXIT")], EVENTS)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    names_ = spark.createDataFrame([(1, "a"), (2, "b")], "fid int, name string")
    trace = trace_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    call_log_stream(trace, names_, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log" / "batch=0")).collect()] == ["ENTER a", "  ENTER b", "  EXIT b"]
