"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables with at most so many rows of two or three longs may be broadcast (some 60 bytes each, 30 MB); larger ones are shuffled.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors see: the cluster's (spark.checkpoint.dir), or in local mode, as in tests, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the counted rows of `df` are few enough to broadcast."""
    return df.limit(limit + 1).count() <= limit


def written(df: DataFrame) -> DataFrame:
    """The rows of `df` as a Parquet table in the shared checkpoint folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
