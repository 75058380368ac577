"""Batch queries over files that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, schema: str, job: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
    """Applies `job` to the Parquet files that arrive in `source` and writes each result to a folder of its own under `sink`.

    A run takes what has arrived, at most `files` files at a time, and ends; the next run goes on from the checkpoint. A batch that
    is repeated after a failure overwrites its own folder, so that nothing is written twice. A document must arrive in one file.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
