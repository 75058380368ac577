"""Operator 13: texts rearranged for filling in the middle.

A text of n units (code points) is cut at two places drawn from its doc_id. In form psm prefix, suffix and middle follow each
other, in form spm suffix, prefix and middle, each behind its sign; other texts stay plain.

To find the bytes of a cut, the units of a text are counted block by block, and each block's first byte and first unit are kept
as a checkpoint: one for EVERY bytes. A cut is looked up among the checkpoints' units by binary search, and only the block it
falls into is scanned again.

Scale: one pass, no shuffle; a worker holds one text at a time besides its batch, with 16 bytes of checkpoints for each EVERY bytes.
What is drawn depends on doc_id and seed alone, so that runs and retries give the same output.

Cases: a null text is empty; empty texts, and those that hold a sign, are plain. A null doc_id counts as the empty key. Rows that
repeat a doc_id are drawn alike, each over its own text. Cuts may meet or lie at either end: parts may be empty. An empty table
gives no rows. `transform` keeps all columns of its input; its own columns replace those of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm import common, kernels

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Percent of texts that are rearranged, and of these, of form spm.
RATE, SPM = 90, 20
#: Bytes between two checkpoints.
EVERY = 2048


class Units:
    """Where the units (code points) of a text begin, by sparse checkpoints."""

    def __init__(self, raw: bytes, every: int = EVERY):
        self.raw, self.every = np.frombuffer(raw, np.uint8), every
        leads = (self.raw & 0xC0) != 0x80
        self.byte = np.arange(0, len(raw), every)
        counts = np.add.reduceat(leads, self.byte, dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
        self.unit = np.concatenate([[0], np.cumsum(counts)])  # units before each block, and their number at last
        self.n = int(self.unit[-1])

    def offset(self, unit: int) -> int:
        """The byte at which a unit begins, or the end of the text for unit n."""
        if unit >= self.n:
            return len(self.raw)
        block = int(np.searchsorted(self.unit, unit, "right")) - 1
        start = int(self.byte[block])
        leads = np.flatnonzero((self.raw[start : start + self.every] & 0xC0) != 0x80)
        return start + int(leads[unit - int(self.unit[block])])


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers drawn from a key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(raw: bytes, h: list[int], rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of units, form, units of prefix and middle, output."""
    units = Units(raw)
    if not raw or any(sign in raw for sign in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return units.n, "plain", None, None, raw
    a, b = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    i, j = units.offset(a), units.offset(b)
    prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
    if h[3] % 100 < spm:
        return units.n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return units.n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made from; the signs occur in it nowhere else."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    first, rest = output.removeprefix(one).split(two, 1)
    second, middle = rest.split(MIDDLE, 1)
    return second + middle + first if form == "spm" else first + middle + second


OWN = StructType([
    StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType()),
])
DIGESTS = StructType([*OWN.fields[:-1], StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())])


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, digests: bool = False) -> DataFrame:
    """The columns of `docs` (doc_id, text), then n, form, prefix_chars, middle_chars and output.

    With digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and no text.
    """
    own = DIGESTS if digests else OWN
    docs = docs.select("doc_id", "text") if digests else docs.drop(*own.names)
    kept = docs.select("doc_id").schema.fields if digests else docs.schema.fields
    schema = StructType([*kept, *own.fields])
    at, key_at = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in kernels.parts(batches, 64):
            rows = []
            for key, text in zip(batch.column(key_at), batch.column(at), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                *facts, output = rearrange(raw, draws(key.as_py() or "", seed), rate, spm)
                rows.append((*facts, *((hashlib.sha256(x).hexdigest() for x in (output, restore(output, facts[1]))) if digests else (output.decode(),))))
            columns = [pa.array(c, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f, c in zip(own.fields, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*([batch.column(0)] if digests else batch.columns[:key_at]), *columns], schema.names)

    names = set(docs.columns)
    key = next(x for x in ("key" + "_" * i for i in range(len(names) + 1)) if x not in names)
    return docs.withColumn(key, F.col("doc_id").cast("string")).mapInArrow(run, schema)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform(common.read(spark, sf_dir, "documents"), digests=True)


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
