"""Decodes record streams: a little-endian header of tag (10 bits), level (10) and size (12); size 0xFFF means one more word."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "file string, ord int, offset long, tag int, level int, size long, data binary"


#: Records and bytes of payload after which a batch is handed on.
BATCH_ROWS, BATCH_BYTES = 10_000, 4_000_000
_NAMES = ("file", "ord", "offset", "tag", "level", "size", "data")
_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())


def _records(file: str | None, raw: bytes):
    at = n = 0
    while at + 4 <= len(raw):
        (head,) = struct.unpack_from("<I", raw, at)
        start, size, body = at, head >> 20, at + 4
        if size == 0xFFF:
            if body + 4 > len(raw):
                break
            (size,) = struct.unpack_from("<I", raw, body)
            body += 4
        yield file, n, start, head & 0x3FF, head >> 10 & 0x3FF, size, raw[body : body + size]
        n, at = n + 1, body + size


def record_batches(batches):
    """Batches of records from batches of streams (file, content): many small streams share one, a long stream is parted."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], list(_NAMES))
    rows, held = [], 0
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for row in _records(file, content.as_py() or b""):
                rows.append(row)
                held += len(row[-1])
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def decode_records(streams: DataFrame) -> DataFrame:
    """A row for each record in `streams` (file, content). A short header ends a stream; a cut payload is kept as it is."""
    return streams.select("file", "content").mapInArrow(record_batches, SCHEMA)
