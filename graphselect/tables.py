"""Written tables that cut lineage, and the shared folder they go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as the table they were made for is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group of a written table: each task that writes or reads one holds it in the heap.
ROW_GROUP_BYTES = 8 << 20
#: Application -> folders of intermediate tables that are still there.
_folders: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs in one process."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="graphselect-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, which cleanup removes."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, what: str = "step", compression: str = "lz4_raw") -> DataFrame:
    """df, written to the shared folder and read again; it stays until discard or cleanup.

    The file's size is known to the planner afterwards, so small steps of a
    loop are broadcast by Spark's own size check and large ones are not.  Row
    groups are small, so a task's memory does not grow with its share of df.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    with _without_leftovers(spark):
        df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by written, which nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        _remove(spark, table.written_to)
        _folders[spark.sparkContext.applicationId].discard(table.written_to)


def cleanup(spark: SparkSession) -> int:
    """Remove all intermediate tables of this application, and return their number; results that were not read yet are lost."""
    paths = _folders.pop(spark.sparkContext.applicationId, set())
    for path in sorted(paths):
        _remove(spark, path)
    return len(paths)
