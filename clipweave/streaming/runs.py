"""Running a streaming query over files to its end, with results in shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clipweave.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files under ``path`` (a glob), in micro-batches of bounded size."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        return reader.option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)
    return reader.option("maxBytesPerTrigger", str(8 << 30)).parquet(path)


#: state stores that hold value and list states, timers and column families
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, write it to parquet and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out, state = scratch_path(spark, name), scratch_path(spark, name + "-state")
    schema = stream.schema
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available through ``write(batch, batch_id)``."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, name + "-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_latest(stream: DataFrame, name: str) -> DataFrame:
    """Update-mode results: every micro-batch writes its changed rows with its number.

    A batch that is run again overwrites its own folder. The latest row of a key is the
    one with the highest ``batch_id``.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    drain_batches(stream, name, write, mode="update")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch_id=*")
