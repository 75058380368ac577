"""Scalar functions over text columns."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire import config


#: All characters of white space, Unicode included.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode included; looks at the ends only, not at the whole text."""
    return F.btrim(c, F.lit(WHITE))


def normalise(c: Column) -> Column:
    """CRLF as LF (a lone CR stays), at most one empty line in a row, stripped."""
    return strip(F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))


def title(line: Column) -> Column:
    """A heading's title: one list or number prefix goes, then hash marks; a line that would be empty stays."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(line, f"(?U){config.TITLE_PREFIX}", "")), r"(?U)^#{1,6}\s+", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), strip(line))


def depth(line: Column) -> Column:
    """The depth of a heading line, or null."""
    return stripped_depth(strip(line))


def may_be_heading(line: Column) -> Column:
    """Whether a line begins with a character that a heading can begin with; cheap, so that `depth` need not look at all lines."""
    return line.rlike(config.HEADING_SIGNS)


def stripped_depth(line: Column) -> Column:
    """The depth of a heading line without white space at either end, or null."""
    marks = F.length(F.regexp_extract(line, r"(?U)^(#{1,6})\s+\S", 1))
    found = F.when(line.startswith("#"), F.when(marks > 0, F.least(marks, F.lit(config.MAX_MARKDOWN_DEPTH))))
    return reduce(lambda c, p: c.when(line.rlike(f"(?U){p[0]}"), F.lit(p[1])), config.HEADINGS, found)


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?iU)(?:{pattern})"))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def strict_json(c: Column) -> Column:
    """The text as a variant, or null where it is no JSON as a whole.

    The parser stops at the end of the first value. A text that is more than one value fails inside a list or inside an object.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), c, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"a":', "}"))]
    return F.when(inside[0] & inside[1], F.try_parse_json(c))


def _reply_object(reply: Column) -> Column:
    """What of a reply may be its JSON object: in a fence, else from the first brace to the last; each pattern is tried once."""
    each = F.array(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    return F.get(F.filter(each, lambda x: x != ""), F.lit(0))


def _once(c: Column, f) -> Column:
    """f(c), with c made once however often f takes it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def json_object(reply: Column) -> Column:
    """The JSON object of a model's reply: in a fence, else from the first brace to the last; null where that is no JSON.

    A fence decides: if what it holds is no JSON, the rest of the reply is not searched. Objects that repeat a key are refused.
    """
    return _once(_reply_object(reply), lambda x: F.when(strict_json(x).isNotNull(), x))


def parsed_object(reply: Column) -> Column:
    """`json_object` as a variant."""
    return _once(_reply_object(reply), strict_json)


# What messages of calls that may be tried again, and of used-up quotas, contain.
TRANSIENT = ("503", "UNAVAILABLE", "overloaded", "high demand", "429", "RESOURCE_EXHAUSTED", "500", "INTERNAL")
QUOTA = ("429", "RESOURCE_EXHAUSTED", "insufficient_quota")


def _has_any(message: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda c, m: c | F.contains(message, F.lit(m)), markers, F.lit(False)), F.lit(False))


def is_transient(message: Column) -> Column:
    """Whether a call that failed with this message may be tried again."""
    return _has_any(message, TRANSIENT)


def is_quota(message: Column) -> Column:
    """Whether a call failed because a quota is used up, so that another key has to be taken."""
    return _has_any(message, QUOTA)


def table_markdown(rows: Column) -> Column:
    """A pipe table from rows of cells: the first row is the header, short rows are padded, pipes and line ends escaped."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.replace(c, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean(c: Column, multiline: bool = False) -> Column:
    """Entities as characters, no-break spaces as spaces; white space as one space, or (multiline) at most one empty line in a row."""
    c = F.coalesce(c, F.lit(""))
    c = F.coalesce(_unescaped(F.when(F.contains(c, F.lit("&")), c)), c)  # texts without an entity stay in the JVM
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), "[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n") if multiline else F.regexp_replace(c, r"(?U)\s+", " "))


def escape_html(c: Column, apostrophe: bool = True) -> Column:
    """Markup characters as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))[: 5 if apostrophe else 4]:
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def line_class(text: Column, is_title: Column) -> Column:
    """The display class of a line: the title, or the first of LINE_CLASSES that fits, or `line`."""
    out = F.when(is_title, "doc-title")
    for pattern, name in config.LINE_CLASSES:
        out = out.when(text.rlike(f"(?U){pattern}"), name)
    return out.otherwise("line")


def looks_like_heading(text: Column) -> Column:
    """At most 40 characters that start with a number, letter or bracket of a heading, or with a square."""
    return (F.length(text) <= config.HEADING_CHARS) & (text.rlike(f"(?U){config.HEADING_START}") | text.rlike("^[□■▣]"))


def is_dark(colour: Column) -> Column:
    """Whether a colour #rrggbb is dark; anything else is not."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    return F.when(colour.rlike("^#[0-9a-fA-F]{6}$"), part(2) * 0.299 + part(4) * 0.587 + part(6) * 0.114 < 100).otherwise(False)


def safe_name(name: Column, chars: int = 90) -> Column:
    """A name for a file: characters that paths can't hold, and white space, as underscores; cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(F.when(name != "", name), F.lit("image")), r'[\\/:*?"<>|]+', "_"), r"(?U)\s+", "_"), 1, chars)


def plain_name(name: Column) -> Column:
    """A name for a file: what is no letter, digit, dot, hyphen or underscore, one character at a time, as an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def count_of(text: Column, needle: str) -> Column:
    """How often the needle occurs in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def clean_reply(text: Column, status: tuple[str, ...]) -> Column:
    """A program's output without its status lines (by prefix), line ends trimmed, at most one empty line in a row."""
    rows = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    rows = F.filter(rows, lambda x: reduce(lambda keep, p: keep & ~x.startswith(p), status, F.lit(True)))
    return strip(F.regexp_replace(F.array_join(rows, "\n"), "\n{3,}", "\n\n"))


def hwp_units(mm: Column) -> Column:
    return F.round(mm * config.UNITS_PER_MM).cast("long")


def size_on_page(width: Column, height: Column, target: int = config.TEXT_WIDTH) -> Column:
    """(org_w, org_h, disp_w, disp_h) of an image of so many pixels, 1920 x 1080 where unknown, shown over the width of the text."""
    known = (width > 0) & (height > 0)
    w, h = (F.when(known, x).otherwise(d).cast("long") * config.UNITS_PER_PIXEL for x, d in ((width, 1920), (height, 1080)))
    return F.struct(w.alias("org_w"), h.alias("org_h"), F.lit(target).cast("long").alias("disp_w"), F.floor(F.lit(target).cast("long") * h / w).alias("disp_h"))
