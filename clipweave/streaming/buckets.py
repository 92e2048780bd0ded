"""A table in hash buckets whose versions are committed by a manifest.

A bucket's rows lie under ``data/v=<version>/bucket=<number>``; the manifest holds a row
(version, bucket) for every bucket that a version wrote and is appended in one file after the
data. A bucket is read at its highest version in the manifest, so what a failed attempt left is
never seen and is overwritten by the next one, and a commit rewrites only the buckets it names.

Rows of one key share a bucket; writes are rebalanced, so that a bucket with a hot key becomes
several files written by several tasks. Only bucket numbers and their versions reach the driver,
at most ``buckets`` of them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: buckets of a table; about one per 128 MB of its expected size
BUCKETS = 64
MANIFEST = "version long, bucket int"


class BucketTable:
    """Rows with the given schema, bucketed by ``key`` under ``root`` (a folder all executors reach)."""

    def __init__(self, root: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.root, self.schema, self.key, self.buckets = root, schema, key, buckets

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that rows fall into."""
        return [r.bucket for r in self.bucketed(rows).select("bucket").distinct().collect()]

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def committed(self, spark: SparkSession, version: int) -> bool:
        return bool(self.manifest(spark).filter(F.col("version") == version).head(1))

    def create(self, rows: DataFrame) -> None:
        """The first version, -1. The manifest begins with a row of no bucket, so that it exists for an empty table."""
        spark = rows.sparkSession
        self._put(rows, -1)
        self._commit(spark, -1, [-1, *self.touched(rows)])

    def read(self, spark: SparkSession, only: Collection[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some of them, as last committed."""
        latest = self.manifest(spark).filter("bucket >= 0").groupBy("bucket").agg(F.max("version").alias("version")).collect()
        paths = [f"{self.root}/data/v={r.version}/bucket={r.bucket}" for r in latest if only is None or r.bucket in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, version: int, buckets: Collection[int]) -> None:
        """Commit ``rows`` as all that the named buckets, each of which has rows, hold from this version on."""
        self._put(rows, version)
        self._commit(rows.sparkSession, version, buckets)

    def _put(self, rows: DataFrame, version: int) -> None:
        spread = self.bucketed(rows.select(*self.schema.names)).hint("rebalance", "bucket")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version}")

    def _commit(self, spark: SparkSession, version: int, buckets: Collection[int]) -> None:
        made = spark.createDataFrame([(version, b) for b in sorted(buckets)], MANIFEST)
        made.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
