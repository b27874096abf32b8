"""Addresses, symbols and the patching plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import BEGIN_TRIGGER, END_TRIGGER, SCOPE_TRIGGER, accepted, has_flag

#: Addresses of one bucket of the as-of join.
BUCKET = 1 << 16


def last_before(probes: DataFrame, marks: DataFrame, at: str = "addr", begin: str = "addr_begin", bucket: int = BUCKET, levels: int = 3) -> DataFrame:
    """probes with the columns of the mark whose begin is the greatest at or below `at`; null where there is none.

    Marks are unique by begin. Both sides are put into buckets of the ordered
    column; a window finds the last mark within a bucket, and what a bucket
    inherits from those before it comes from the last mark of each bucket, which
    is the same question about buckets. After `levels` such steps the buckets of
    64-bit numbers are so few that one window holds them.
    """
    own = [c for c in marks.columns if c != begin]
    mark = F.struct(F.col(begin), *own)
    one = marks.select(F.floor(F.col(begin) / bucket).alias("_b"), F.col(begin).alias("_at"), F.lit(0).alias("_side"), mark.alias("_mark"), F.lit(None).cast(probes.schema).alias("_probe"))
    two = probes.select(F.floor(F.col(at) / bucket).alias("_b"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(one.schema["_mark"].dataType).alias("_mark"), F.struct(*probes.columns).alias("_probe"))
    inside = Window.partitionBy("_b").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.union(two).withColumn("_found", F.last("_mark", ignorenulls=True).over(inside)).where("_side = 1")
    # The last mark of each bucket that has one, valid up to the next such bucket.
    lasts = one.groupBy("_b").agg(F.max("_mark").alias("_mark"))
    asked = placed.select("_b").distinct()
    if levels:
        carried = last_before(asked.withColumn("_earlier", F.col("_b") - 1), lasts.select(F.col("_b").alias("_mark_b"), F.col("_mark").alias("_carried")), "_earlier", "_mark_b", bucket, levels - 1).select("_b", "_carried")
    else:
        order = Window.orderBy("_b", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        carried = lasts.select(F.col("_b"), F.lit(1).alias("_kind"), "_mark").union(asked.select("_b", F.lit(0).alias("_kind"), F.lit(None).cast(one.schema["_mark"].dataType)))
        carried = carried.withColumn("_carried", F.last("_mark", ignorenulls=True).over(order)).where("_kind = 0").select("_b", "_carried")
    joined = placed.join(carried, "_b", "left").withColumn("_m", F.coalesce("_found", "_carried"))
    return joined.select("_probe.*", *(F.col(f"_m.{c}").alias(c) for c in (begin, *own)))


def resolve_addresses(events: DataFrame, mappings: DataFrame, symbols: DataFrame) -> DataFrame:
    """events(addr, ...) with the binary they lie in and the symbol at their place in it; null where unknown.

    mappings(path, addr_begin, offset), symbols(binary, addr, name).
    """
    placed = last_before(events, mappings).withColumn("local_addr", F.col("addr") - F.col("addr_begin") + F.col("offset"))
    names = symbols.select(F.col("binary").alias("path"), F.col("addr").alias("local_addr"), F.col("name").alias("symbol"))
    return placed.join(names, ["path", "local_addr"], "left")


def patch_plan(patched: DataFrame, selection: DataFrame | None) -> DataFrame:
    """(fid, name, flags, is_scope, is_begin, is_end) of functions to patch: those that the selection accepts, or all without one.

    patched(fid, name, ...): of rows with one fid the least name is used.
    """
    functions = patched.groupBy("fid").agg(F.min("name").alias("name"))
    if selection is None:
        chosen = functions.withColumn("flags", F.lit(1))
    else:
        chosen = functions.join(selection.where(accepted(F.col("flags"))), "name").select("fid", "name", "flags")
    return chosen.select("fid", "name", "flags", *(has_flag(F.col("flags"), bit).alias(c) for bit, c in ((SCOPE_TRIGGER, "is_scope"), (BEGIN_TRIGGER, "is_begin"), (END_TRIGGER, "is_end"))))


def patch_counts(patched: DataFrame, selection: DataFrame | None) -> DataFrame:
    """One row: functions found, patched, and selected names that no function has."""
    found = patched.select("name").distinct()
    plan = patch_plan(patched, selection)
    missing = selection.where(accepted(F.col("flags"))).join(found, "name", "left_anti") if selection is not None else found.limit(0)
    rows = [df.select(*(F.lit(int(c == which)).alias(c) for c in ("found", "patched", "failed"))) for which, df in (("found", found), ("patched", plan), ("failed", missing))]
    return rows[0].union(rows[1]).union(rows[2]).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "patched", "failed")))
