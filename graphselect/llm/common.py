"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, new_folder, written

__all__ = ["crc_of_id", "discard", "fresh_names", "in_id_order", "known_bytes", "new_folder", "nonempty", "partitions_for", "record", "short_batches", "shuffle_partitions", "strings", "table", "written"]

#: Rows and bytes of one Arrow batch sent to Python: texts have no length bound, so both are kept small.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Python workers see at most BATCH_ROWS rows, and BATCH_BYTES or one row, at once; plans are lazy, so this holds for the session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table, as the planner estimates them, for each partition of an exchange of texts.
PARTITION_BYTES = 128 << 20


def known_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as the planner estimates them; nothing is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)  # what is no file has no size


def partitions_for(df: DataFrame) -> int:
    """Partitions for an exchange of all of df: spark.sql.shuffle.partitions at least, more if it reads large tables; nothing is run."""
    return max(shuffle_partitions(df.sparkSession), min(1 << 17, known_bytes(df) // PARTITION_BYTES))


def in_id_order(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text), ranged and sorted by id: null ids first, equal ids in the order of their texts' hashes.

    Rows that are equal in both are told apart by where they stand, so ranges
    split even what is repeated without end.
    """
    keys = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    numbered = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    return numbered.repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Values as str; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def record(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def nonempty(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def crc_of_id(column: str = "doc_id"):
    """crc32 of doc_id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Each of names, with underscores before it until no column of df has that name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
