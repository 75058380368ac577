"""Sizes of images from their bytes, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers of the parts of a JPEG file that hold its size.
SIZE_MARKERS = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB)
PNG = "89504E470D0A1A0A"


def number(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The number in `size` bytes from the byte `at` (from 0), or null where the data ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    part = lambda k: F.substring(data, at + 1 + k, F.lit(1))
    word = F.concat(*[part(k) for k in (reversed(range(size)) if little else range(size))])
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(word), 16, 10).cast("long"))


def _signed(c: Column) -> Column:
    return F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def jpeg_size(data: Column, most_parts: int = 512) -> Column:
    """(width, height) of a JPEG, or null: a pointer goes from marker to marker, over at most `most_parts` of them.

    A part's length leads to the next one; bytes up to the next FF are skipped. The bytes are seen as Latin-1 text, in which a
    search for FF is one call. A file that ends before its size has none.
    """
    code = lambda s, at, n: F.conv(F.hex(F.encode(F.substring(s, at, F.lit(n)), "ISO-8859-1")), 16, 10).cast("int")
    none = F.lit(None).cast("int")
    state = lambda s, at, w, h: F.struct(s.alias("s"), at.cast("int").alias("at"), w.cast("int").alias("w"), h.cast("int").alias("h"))

    def at_mark(s: Column, mark: Column) -> Column:
        lost = state(s, F.lit(0), none, none)
        known = lambda kind: (
            F.when(kind.isin(*SIZE_MARKERS), F.when(F.length(s) >= mark + 8, state(s, F.lit(0), code(s, mark + 7, 2), code(s, mark + 5, 2))).otherwise(lost))
            .when(F.length(s) >= mark + 3, state(s, mark + 2 + code(s, mark + 2, 2), none, none)).otherwise(lost)
        )
        return F.when((mark == 0) | (F.length(s) <= mark), lost).otherwise(_let(code(s, mark + 1, 1), known))

    def step(a: Column, _: Column) -> Column:
        return F.when(a["at"] == 0, a).otherwise(_let(F.call_function("locate", F.lit("\u00ff"), a["s"], a["at"]), lambda mark: at_mark(a["s"], mark)))

    parts = F.sequence(F.lit(1), F.least(F.lit(most_parts), F.floor(F.octet_length(data) / 4) + 1).cast("int"))  # a part takes four bytes at least
    end = F.aggregate(parts, state(F.decode(data, "ISO-8859-1"), F.lit(3), none, none), step, lambda a: F.struct(a["w"].alias("width"), a["h"].alias("height")))
    return F.when(F.hex(F.substring(data, 1, 2)) == "FFD8", end)


def image_size(data: Column) -> Column:
    """(width, height) in pixels of a PNG, JPEG, GIF or BMP, else null; a BMP that runs from the top has a negative height."""
    head = F.hex(F.substring(data, 1, 8))
    size = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    found = (
        F.when(head == PNG, size(number(data, 16, 4), number(data, 20, 4))).when(head.startswith("FFD8"), jpeg_size(data))
        .when(F.substring(head, 1, 12).isin("474946383761", "474946383961"), size(number(data, 6, 2, True), number(data, 8, 2, True))).when(head.startswith("424D"), size(_signed(number(data, 18, 4, True)), _signed(number(data, 22, 4, True))))
    )
    return _let(found, lambda s: F.when(s["width"].isNotNull() & s["height"].isNotNull(), s))
