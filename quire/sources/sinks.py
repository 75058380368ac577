"""Results as files: plans as JSON lines, reports as text, one file for each task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as a JSON object on a line of its own; null fields are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_markdown(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The reports (doc_id, md), a folder for each of at most 256 hashes of doc_id, parted by a line of hyphens."""
    key = F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("part")
    reports.select(key, F.col("md").alias("value")).write.mode(mode).partitionBy("part").option("lineSep", "\n\n---\n\n").text(path)
