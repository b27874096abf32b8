"""Call logs, event dictionaries and registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indented, shortened


def call_log(trace: DataFrame, names: DataFrame) -> DataFrame:
    """(thread, seq, line): ENTER and EXIT with the name, indented by depth.

    trace is a recorded trace (thread, seq, id, type, depth), names(fid, name).
    """
    named = trace.join(names.select(F.col("fid").alias("id"), "name"), "id", "left")
    kind = F.when(F.col("type") == "ENTRY", "ENTER").otherwise("EXIT")
    return named.select("thread", "seq", indented(F.col("depth"), F.concat(kind, F.lit(" "), F.coalesce("name", F.lit("")))).alias("line"))


def write_call_log(log: DataFrame, path: str) -> None:
    """A folder of text files, one thread after another in each; a run's folder is not overwritten."""
    log.repartitionByRange("thread", "seq").sortWithinPartitions("thread", "seq").select("line").write.mode("errorifexists").text(path)


def call_tree_log(trace: DataFrame, resolved: DataFrame) -> DataFrame:
    """(thread, seq, line): [ENTER] and [EXIT] with address, name and call site, indented by depth.

    resolved(addr, symbol): names of addresses; trace has addr and callsite.
    """
    own = resolved.select("addr", F.col("symbol").alias("name")).dropDuplicates(["addr"])
    site = resolved.select(F.col("addr").alias("callsite"), F.col("symbol").alias("site")).dropDuplicates(["callsite"])
    rows = trace.join(own, "addr", "left").join(site, "callsite", "left")
    kind = F.when(F.col("type") == "ENTRY", "[ENTER]").otherwise("[EXIT]")
    unknown = F.lit("UNKNOWN")
    text = F.concat(kind, F.lit(" 0x"), F.lower(F.hex("addr")), F.lit(" "), F.coalesce("name", unknown), F.lit(" (callsite: "), F.coalesce("site", unknown), F.lit(")"))
    return rows.select("thread", "seq", indented(F.col("depth"), text).alias("line"))


def event_dictionary(patched: DataFrame, demangle: bool = True, limit: int = 2048) -> DataFrame:
    """(id, description): names of ids, as long as a fixed buffer allows."""
    name = F.coalesce("demangled", "name") if demangle else F.col("name")
    return patched.select(F.col("fid").alias("id"), shortened(name, limit).alias("description"))


def region_registrations(patched: DataFrame, enabled: bool = True) -> DataFrame:
    """(addr, name, demangled) of patched functions, or nothing."""
    rows = patched.select("addr", "name", "demangled")
    return rows if enabled else rows.limit(0)


def gnu_callbacks(events: DataFrame, patched: DataFrame) -> DataFrame:
    """(thread, seq, callback, addr): enter and exit calls with the function's address; events of unknown ids are left out."""
    named = events.join(patched.select(F.col("fid").alias("id"), "addr"), "id")
    return named.select("thread", "seq", F.when(F.col("type") == "ENTRY", "enter").otherwise("exit").alias("callback"), "addr")
