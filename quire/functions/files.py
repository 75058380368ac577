"""Columns over names and bytes of files: format, encoding, text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire import config
from quire.functions import text as T


def _extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def format_of(path: Column) -> Column:
    """The format by extension; plain text for an unknown one."""
    ext = _extension(path)
    return F.when(ext.isin(*config.FORMATS), ext).otherwise("txt")


def upload_format(name: Column, preview: bool = False) -> Column:
    """The format of an upload, or null where it is refused; a preview takes another set of formats."""
    ext = _extension(name)
    return F.when(ext.isin(*(config.PREVIEW_FORMATS if preview else config.FORMATS)), ext)


def format_by_magic(content: Column, path: Column) -> Column:
    """A package or compound file by its first bytes, else by extension."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("504B"), "hwpx").when(head == "D0CF11E0", "hwp").when(_extension(path) == "hwpx", "hwpx").otherwise("hwp")


def encoding_name(name: Column) -> Column:
    low = F.replace(F.lower(T.strip(F.coalesce(name, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(low == "", "utf-8").when(low.isin(*config.KOREAN_ENCODINGS), "euc-kr").when(low == "utf16", "utf-16le").otherwise(low)


def sniff_encoding(content: Column, sample: int = 240) -> Column:
    """The encoding of markup: by its mark, by zero bytes at even or odd places, by what it declares; else UTF-8."""
    raw = F.hex(F.substring(content, 1, sample))
    pairs = F.regexp_extract_all(raw, F.lit("(..)"), 1)
    zeros = lambda odd: F.size(F.filter(pairs, lambda x, i: (x == "00") & (i % 2 == odd)))
    many = F.size(pairs) / 5
    # bytes outside the printable ASCII range become spaces, as they can't be part of a declaration
    shown = F.decode(F.unhex(F.array_join(F.transform(pairs, lambda x: F.when(x.between("20", "7E"), x).otherwise("20")), "")), "US-ASCII")
    declared = F.regexp_extract(shown, r"""(?i)encoding\s*=\s*["']([^"']+)["']""", 1)
    return F.when(raw.startswith("EFBBBF"), "utf-8").when(raw.startswith("FFFE"), "utf-16le").when(raw.startswith("FEFF"), "utf-16be").when(zeros(1) > many, "utf-16le").when(zeros(0) > many, "utf-16be").otherwise(encoding_name(declared))


def _decoded(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    for encoding in ("utf-8", "cp949", "euc-kr"):
        try:
            return bytes(raw).decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_text(content: pd.Series) -> pd.Series:
    """Text of a plain file: the first of UTF-8 and two Korean encodings that fits, else UTF-8 with replacements."""
    return content.map(_decoded)


#: Control codes of paragraph text that take eight units, and those of one.
LONG_CONTROLS = (*range(1, 10), 11, 12, *range(14, 24))
SHORT_CONTROLS = (0, 10, 13, *range(24, 32))


def _paragraph(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    units = np.frombuffer(bytes(raw)[: len(raw) // 2 * 2], "<u2")
    at = np.flatnonzero(units < 32)
    out, free = [], 0
    for i in at.tolist():
        if i < free:
            continue
        out.append(units[free:i].tobytes())
        c = int(units[i])
        out.append("\t".encode("utf-16-le") if c == 9 else "\n".encode("utf-16-le") if c in (10, 13) else b"")
        free = i + (8 if c in LONG_CONTROLS else 1)
    out.append(units[free:].tobytes())
    return b"".join(out).decode("utf-16-le", "replace")


@F.pandas_udf(StringType())
def paragraph_text(payload: pd.Series) -> pd.Series:
    """The text of a paragraph record: UTF-16 units, tabs and line ends kept, other controls (of one or eight units) left out."""
    return payload.map(_paragraph)


def plain_text(content: Column, path: Column) -> Column:
    """The normalised text of a plain file; null for formats that need a reader of containers."""
    return F.when(format_of(path).isin("md", "txt"), T.normalise(decode_text(content)))
