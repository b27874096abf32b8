"""Traces as a stateful stream: one machine for each thread."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sinks.logs import call_log

#: What a trigger column is called where events bring their own.
FLAGS = ("is_begin", "is_end", "is_scope")


@dataclass
class TraceMachine:
    """The state of a thread, and what happens with its next event.

    Triggers are sets of ids, or come with each event (step); starts_active and
    scoped then say whether there is no begin trigger, and any scope trigger.
    """

    begin: frozenset[int] = frozenset()
    end: frozenset[int] = frozenset()
    scope: frozenset[int] = frozenset()
    active: bool | None = None
    in_scope: bool = False
    stack: list[int] = field(default_factory=list)
    starts_active: bool | None = None
    scoped: bool | None = None

    def event(self, id: int, type: str, recording: bool = True) -> tuple[int, int] | None:
        return self.step(id, type, id in self.begin, id in self.end, id in self.scope, recording)

    def step(self, id: int, type: str, begins: bool, ends: bool, scopes: bool, recording: bool = True) -> tuple[int, int] | None:
        """(depth, value) if the event is recorded: depth before an entry or after an exit, and the trace value."""
        if self.active is None:
            self.active = not self.begin if self.starts_active is None else self.starts_active
        if self.active:
            if type == "EXIT" and ends:
                self.active = False  # this exit is recorded still
        elif type == "ENTRY" and begins:
            self.active = True
        else:
            return None
        if not recording:
            return None
        if (bool(self.scope) if self.scoped is None else self.scoped) and not self.in_scope:
            if type != "ENTRY" or not scopes:
                return None
            self.in_scope = True
        if type == "ENTRY":
            self.stack.append(id)
            return len(self.stack) - 1, id
        if not self.stack:
            return None
        self.stack.pop()
        if not self.stack:
            self.in_scope = False
        return len(self.stack), self.stack[-1] if self.stack else 0


class TraceProcessor(StatefulProcessor):
    """Events of a thread in order of arrival -> recorded events; columns of triggers and `recording` are used where events have them."""

    def __init__(self, machine: TraceMachine):
        self.machine = machine

    def init(self, handle) -> None:
        self.state = handle.getValueState("thread", "active boolean, in_scope boolean, stack array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m = self.machine
        machine = TraceMachine(m.begin, m.end, m.scope, starts_active=m.starts_active, scoped=m.scoped)
        if self.state.exists():
            machine.active, machine.in_scope, stack = self.state.get()
            machine.stack = list(stack)
        for batch in rows:
            batch = batch.sort_values("seq", kind="stable")
            n = len(batch)
            ids = batch["id"].tolist()
            flags = [batch[c].tolist() if c in batch else [i in ids_of for i in ids] for c, ids_of in zip(FLAGS, (m.begin, m.end, m.scope))]
            on = batch["recording"].tolist() if "recording" in batch else [True] * n
            out = []
            for seq, id_, type_, begins, ends, scopes, recording in zip(batch["seq"].tolist(), ids, batch["type"].tolist(), *flags, on):
                found = machine.step(id_, type_, begins is True, ends is True, scopes is True, recording is True)
                if found:
                    out.append((key[0], seq, id_, type_, *found))
            if out:
                yield pd.DataFrame(out, columns=["thread", "seq", "id", "type", "depth", "value"])
        self.state.update((machine.active, machine.in_scope, machine.stack))

    def close(self) -> None:
        pass


def _recorded(events: DataFrame, machine: TraceMachine, late: str | None) -> DataFrame:
    kept = ["thread", "seq", "id", "type", *(c for c in (*FLAGS, "recording") if c in events.columns)]
    if late:
        events, kept = events.withWatermark("ts", late), [*kept, "ts"]
    return events.select(*kept).groupBy("thread").transformWithStateInPandas(
        statefulProcessor=TraceProcessor(machine),
        outputStructType="thread long, seq long, id int, type string, depth int, value int",
        outputMode="Append",
        timeMode="EventTime" if late else "None",
    )


def trace_stream(events: DataFrame, begin: set[int] = frozenset(), end: set[int] = frozenset(), scope: set[int] = frozenset(), late: str | None = None) -> DataFrame:
    """A stream of (thread, seq, id, type) -> (thread, seq, id, type, depth, value).

    Events of a thread must arrive in order from batch to batch; the state of a
    thread is its stack and two switches. Events with a column `recording` that
    is not true move the begin and end gate only. late: events whose ts lies so
    far behind the latest one of earlier batches are dropped (a watermark).
    """
    own = events.drop(*FLAGS)
    return _recorded(own, TraceMachine(frozenset(begin), frozenset(end), frozenset(scope)), late)


def planned_stream(events: DataFrame, plan: DataFrame, late: str | None = None) -> DataFrame:
    """trace_stream of the functions that a patching plan (fid, is_scope, is_begin, is_end) names; its flags are the triggers.

    The plan is joined to the stream, never gathered: only whether it has a
    begin and a scope trigger is asked once.
    """
    any_of = plan.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in FLAGS)).first()
    flags = plan.select(F.col("fid").alias("id"), *FLAGS)
    machine = TraceMachine(starts_active=not any_of["is_begin"], scoped=any_of["is_scope"])
    return _recorded(events.drop(*FLAGS).join(flags, "id"), machine, late)


class RegionProcessor(StatefulProcessor):
    """Events of one id -> register, start and stop; nothing more after the monitor's end."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("region", "registered boolean, finished boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        registered, finished = self.state.get() if self.state.exists() else (False, False)
        for batch in rows:
            if finished:
                continue
            batch = batch.sort_values(["seq", "thread"], kind="stable")
            if "finished" in batch:
                over = batch["finished"].eq(True).cummax()
                finished = bool(over.iloc[-1])
                batch = batch[~over]
            if batch.empty:
                continue
            actions = batch[["thread", "seq", "id", "name"]].assign(action=batch["type"].eq("ENTRY").map({True: "start", False: "stop"}))
            if not registered:
                actions = pd.concat([actions.iloc[:1].assign(action="register"), actions])
                registered = True
            yield actions
        self.state.update((registered, finished))

    def close(self) -> None:
        pass


def region_stream(events: DataFrame, names: DataFrame, name_limit: int = 128) -> DataFrame:
    """region_events as a stream: (thread, seq, id, type) -> (thread, seq, id, name, action).

    names(fid, name) is a table; functions without a name or with one of
    name_limit characters or more are left out for good. A region is registered
    at the first event that arrives, in order of seq within a batch; from the
    first event on with a true `finished` (if there is such a column) a region
    gives nothing more. The state of an id is two switches; the events of an id
    are one task's, batch by batch.
    """
    known = events.drop("name").join(names.select(F.col("fid").alias("id"), "name"), "id").where(F.length("name") < name_limit)
    kept = ["thread", "seq", "id", "type", "name", *(["finished"] if "finished" in events.columns else [])]
    return known.select(*kept).groupBy("id").transformWithStateInPandas(
        statefulProcessor=RegionProcessor(),
        outputStructType="thread long, seq long, id int, name string, action string",
        outputMode="Append",
        timeMode="None",
    )


def call_log_stream(trace: DataFrame, names: DataFrame, path: str, checkpoint: str):
    """A writer of a recorded stream's call log: one folder path/batch=<n> of text files for each micro-batch; call .start() on it.

    A batch that is run again after a loss replaces its folder, so that no line
    is written twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        lines = call_log(batch, names).repartitionByRange("thread", "seq").sortWithinPartitions("thread", "seq")
        lines.select("line").write.mode("overwrite").text(f"{path}/batch={n}")

    return trace.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
