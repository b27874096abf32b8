"""Traces as window functions over (thread, seq, id, type); type is ENTRY, EXIT or TAIL.

A thread's events are read in order of seq and nothing of a thread is gathered:
each window keeps a running value.  Exits without an open entry are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far() -> Window:
    return Window.partitionBy("thread").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def _before() -> Window:
    return Window.partitionBy("thread").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def begin_end_gate(events: DataFrame, begin: Column, end: Column, starts_active: bool | None = None, any_begin: bool = True) -> DataFrame:
    """events with `active`: is the event recorded?

    begin and end say which ids are triggers.  An ENTRY of a begin trigger
    opens the gate and is recorded; an EXIT of an end trigger closes it and is
    recorded if the gate was open.  A thread starts open if there is no begin
    trigger.
    """
    start = F.lit(not any_begin if starts_active is None else starts_active)
    opens, closes = begin & (F.col("type") == "ENTRY"), end & (F.col("type") == "EXIT")
    set_to = F.when(opens, True).when(closes, False)
    was_open = F.coalesce(F.last(set_to, ignorenulls=True).over(_before()), start)
    return events.withColumn("active", was_open | opens)


def call_depth(events: DataFrame) -> DataFrame:
    """events with depth (open entries after the event), level (of the frame that it opens or closes) and matched (an exit with an open entry, or an entry)."""
    step = F.when(F.col("type") == "ENTRY", 1).otherwise(-1)
    walk = events.withColumn("_s", F.sum(step).over(_so_far()))
    lowest = F.least(F.lit(0), F.min("_s").over(_so_far()))
    before = F.least(F.lit(0), F.coalesce(F.min("_s").over(_before()), F.lit(0)))
    found = walk.withColumn("depth", (F.col("_s") - lowest).cast("int")).withColumn("matched", (F.col("type") == "ENTRY") | (F.col("_s") >= before))
    return found.withColumn("level", F.when(F.col("type") == "ENTRY", F.col("depth")).otherwise(F.col("depth") + 1)).drop("_s")


def scope_gate(events: DataFrame, scope: Column) -> DataFrame:
    """Matched events with `active`: does a frame of a scope trigger hold the event?

    The frame that the first trigger opens is the scope; it ends with that
    frame's exit, which is recorded.
    """
    walked = call_depth(events).where("matched")
    frame = Window.partitionBy("thread", "level").orderBy("seq")
    triggers = walked.withColumn("_t", (scope & (F.col("type") == "ENTRY")).cast("int"))
    step = F.when(F.col("type") == "ENTRY", F.col("_t")).otherwise(-F.lag("_t").over(frame))
    held = triggers.withColumn("_step", step).withColumn("_held", F.sum("_step").over(_so_far()))
    return held.withColumn("active", (F.col("_held") > 0) | (F.col("_step") < 0)).drop("_t", "_step", "_held")


def enclosing(events: DataFrame) -> DataFrame:
    """Matched events with value: the id of an entry, or of the function that an exit returns to (0: none)."""
    walked = call_depth(events).where("matched")
    asks = F.when(F.col("type") != "ENTRY", F.col("level") - 1)
    both = walked.withColumn("_key", F.explode(F.when(F.col("type") == "ENTRY", F.array("level")).otherwise(F.array(asks))))
    frame = Window.partitionBy("thread", "_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("type") == "ENTRY", F.col("id"))
    return both.withColumn("value", F.when(F.col("type") == "ENTRY", F.col("id")).otherwise(F.when(F.col("_key") == 0, 0).otherwise(F.last(opened, ignorenulls=True).over(frame)))).drop("_key")


def within(events: DataFrame, intervals: DataFrame, at: str = "ts", by: str = "process") -> DataFrame:
    """events of a process from begin on and before end: of what happens only while a runtime is up.

    intervals(<by>, begin, end): an end that is null is not reached. An event in
    several intervals stays once, one of a process without intervals goes. The
    intervals of a process are few; the join is on the process, never on ranges
    alone.
    """
    t = intervals.select(F.col(by).alias("_by"), F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    inside = (F.col(at) >= F.col("_begin")) & (F.col("_end").isNull() | (F.col(at) < F.col("_end")))
    return events.join(t, (F.col(by) == F.col("_by")) & inside, "left_semi")


def windowed_calls(events: DataFrame, length: str = "1 hour", late: str | None = None, at: str = "ts") -> DataFrame:
    """(begin, id, type, calls): events of each id by windows of event time, for tables and streams.

    late: how long a stream waits for late events; those that come later are
    dropped, and windows are given out when they are closed.
    """
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(F.window(at, length).alias("w"), "id", "type").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("begin"), "id", "type", "calls")


def recorded_trace(events: DataFrame, begin: Column | None = None, end: Column | None = None, scope: Column | None = None, recording: Column | None = None) -> DataFrame:
    """(thread, seq, id, type, depth, value): what gates let through, with depth before the entry or after the exit, and the trace value.

    recording: events for which it is not true open and close the begin and end
    gate, but are not recorded and change no depth.
    """
    if begin is not None or end is not None:
        events = begin_end_gate(events, begin if begin is not None else F.lit(False), end if end is not None else F.lit(False), any_begin=begin is not None).where("active").drop("active")
    if recording is not None:
        events = events.where(recording)
    if scope is not None:
        events = scope_gate(events, scope).where("active").drop("active", "depth", "level", "matched")
    return enclosing(events).select("thread", "seq", "id", "type", (F.col("level") - 1).alias("depth"), "value")


def region_events(events: DataFrame, names: DataFrame, name_limit: int = 128, finished: Column | None = None) -> DataFrame:
    """(thread, seq, id, name, action): register at a region's first event, then start on ENTRY and stop on EXIT or TAIL.

    Functions without a name, or with one of name_limit characters or more, are
    left out; so is all that finished says comes after the monitor's end.
    """
    known = events.join(names.select(F.col("fid").alias("id"), "name"), "id").where(F.length("name") < name_limit)
    if finished is not None:
        known = known.where(~finished)
    # The first event of each id by partial aggregation: an id that all threads call is no one task's.
    firsts = known.groupBy("id").agg(F.min(F.struct("seq", "thread")).alias("_at"))
    action = F.when(F.col("type") == "ENTRY", "start").otherwise("stop")
    actions = F.when(F.col("_first"), F.array(F.lit("register"), action)).otherwise(F.array(action))
    first = F.struct("seq", "thread") == F.col("_at")
    return known.join(firsts, "id").withColumn("_first", first).withColumn("action", F.explode(actions)).select("thread", "seq", "id", "name", "action")
