"""Continuous ingestion of segments into a guarded table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.operators.state import merge_locked, replace_by_id
from clipweave.session import scratch_path
from clipweave.streaming.buckets import BUCKETS, BucketTable
from clipweave.streaming.runs import drain_batches


def ingest_segments(stream: DataFrame, stored: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Merge every micro-batch into the stored table without losing locked rows.

    ``stream`` has the columns of ``stored`` plus ``version``. The table lies in hash buckets of
    its items; a batch reads and rewrites the buckets of its own items only.
    """
    spark: SparkSession = stream.sparkSession
    table = BucketTable(scratch_path(spark, "segments"), stored.schema, "item_id", buckets)
    table.create(stored)
    drain_batches(stream, "ingest", merging(table))
    return table.read(spark)


def merging(table: BucketTable) -> Callable[[DataFrame, int], None]:
    """What a stream does with a batch of segments: a batch that is run again after its commit changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if table.committed(spark, batch_id):
            return
        touched = table.touched(batch)
        if not touched:
            return
        before = table.read(spark, touched)
        keyed = batch.withColumn("_key", _key(batch))
        newest = replace_by_id(before.withColumn("_key", _key(before)), keyed, "_key").select(*table.schema.names)
        table.replace(merge_locked(before, newest), batch_id, touched)

    return merge


def _key(df: DataFrame) -> Column:
    return F.concat_ws(":", F.col("item_id").cast("string"), F.col("seg_id").cast("string"))
