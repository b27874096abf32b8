"""Tables between steps: what a task holds of one does not grow with the table."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graphselect import tables
from graphselect.llm import common


def test_row_groups_of_a_large_partition_are_small(spark):
    """One task writes 40 MB of texts: whoever reads them needs one row group at a time in memory."""
    text = F.concat_ws(" ", *(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f"/{k}")), 512) for k in range(16)))
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id").coalesce(1).withColumn("text", text)
    found = common.written(docs, "large")
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in glob.glob(found.written_to.removeprefix("file://") + "/*.parquet") for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 20_000 == found.where("length(text) = 16 * 129 - 1").count()
    assert sum(g.total_byte_size for g in groups) > 40e6
    assert max(g.total_byte_size for g in groups) < 1.5 * tables.ROW_GROUP_BYTES
    common.discard(found)
