"""Intermediate tables that several branches of a job read, written once to a folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (spark.checkpoint.dir); in local mode, where it is unset, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quire-shared-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and read again: lost executors cost no recomputation, and readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
