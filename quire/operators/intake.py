"""Files as they arrive: in one pass either a report or a row that says at which stage, and why, a file was refused.

`files`: path, content. Nothing is raised for a bad file, and nothing is lost: accepted and refused rows together are the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire import config
from quire.functions import files as N

#: The first bytes of formats that are containers, as hex digits.
CONTAINERS = {"hwpx": "504B", "docx": "504B", "hwp": "D0CF11E0", "pdf": "25504446"}


def judged(files: DataFrame, readers: dict[str, Callable[[Column], Column]] | None = None, counts: Observation | None = None) -> DataFrame:
    """path, format, text, stage, reason, and further columns, for each of `files`; stage and reason are null for an accepted one.

    Stages: `upload` (no name, a format that is not taken), `read` (no content, not what its format begins with, no reader), `parse`
    (the reader gives null). Plain text is read here; `readers` give a column of text for the content of other formats. `counts`
    observes n_files and n_refused as the rows are used, without another pass.
    """
    readers = readers or {}
    path, content = F.trim(F.coalesce("path", F.lit(""))), F.col("content")
    form = N.upload_format(path)
    head = F.hex(F.substring(content, 1, 4))
    begins = [F.when((form == f) & ~head.startswith(mark), F.concat(F.lit("not a "), form)) for f, mark in CONTAINERS.items()]
    known = ("md", "txt", *readers)
    read = F.coalesce(F.when(content.isNull(), "no content"), *begins, F.when(~form.isin(*known), F.concat(F.lit("no reader of "), form)))
    text = N.plain_text(content, path)
    for f, reader in readers.items():
        text = F.when(form == f, reader(content)).otherwise(text)
    upload = F.when(path == "", "no name").when(form.isNull(), F.concat(F.lit("unknown format: "), F.lower(path)))
    own = [c for c in files.columns if c not in ("path", "content", "format", "text", "stage", "reason")]
    rows = files.select(*own, "path", form.alias("format"), upload.alias("_upload"), F.when(upload.isNull(), read).alias("_read"), F.when(upload.isNull() & read.isNull(), text).alias("text"))
    sound = F.col("_upload").isNull() & F.col("_read").isNull()
    stage = F.when(F.col("_upload").isNotNull(), "upload").when(F.col("_read").isNotNull(), "read").when(sound & F.col("text").isNull(), "parse")
    reason = F.coalesce("_upload", "_read", F.when(F.col("text").isNull(), "the reader gave no text"))
    out = rows.select(*own, "path", "format", "text", stage.alias("stage"), reason.alias("reason"))
    return out if counts is None else out.observe(counts, F.count("*").alias("n_files"), F.count("stage").alias("n_refused"))


def accepted(rows: DataFrame) -> DataFrame:
    """path, format, text of the files of `judged` that were taken."""
    return rows.filter("stage IS NULL").select("path", "format", "text")


def refused(rows: DataFrame) -> DataFrame:
    """path, stage, reason of the files of `judged` that were not."""
    return rows.filter("stage IS NOT NULL").select("path", "stage", "reason")
