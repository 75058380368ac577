"""Documents as HTML pages: blocks with their styles in order, a break between sections. All is keyed by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Least and largest size of letters, largest margin, alignments that are shown.
SIZES, MARGIN, ALIGNED = (7, 28), 30, ("left", "center", "right")
IMAGE = ('<div style="text-align:center;margin:8pt 0"><img style="max-width:100%;height:auto" src="', '" alt="그림"></div>')
BREAK = '<div class="page-break"></div>'


def style_attribute(char: str = "char_", para: str = "para_") -> Column:
    """The style attribute of a block, or '', from the columns font_size, bold, italic, color and align, margin_top, margin_bottom
    of its styles, behind the given prefixes. Values that are null, or not of a kind that is shown, are left out."""
    c, p = (lambda k: F.col(f"{char}{k}")), (lambda k: F.col(f"{para}{k}"))
    size = F.when(c("font_size") > SIZES[1], str(SIZES[1])).when(c("font_size") < SIZES[0], str(SIZES[0])).otherwise(c("font_size").cast("string"))
    margin = lambda k: F.when(p(k) != 0, F.concat(F.lit(f"{k.replace('_', '-')}:"), F.when(p(k) > MARGIN, str(MARGIN)).otherwise(p(k).cast("string")), F.lit("pt")))
    parts = [
        F.when(c("font_size") > 0, F.concat(F.lit("font-size:"), size, F.lit("pt"))), F.when(c("bold"), "font-weight:700"), F.when(c("italic"), "font-style:italic"), F.when(c("color").rlike("^#[0-9a-fA-F]{6}$"), F.concat(F.lit("color:"), c("color"))),
        F.when(p("align").isin(*ALIGNED), F.concat(F.lit("text-align:"), p("align"))), margin("margin_top"), margin("margin_bottom"),
    ]
    css = F.concat_ws(";", *parts)
    return F.when(css != "", F.concat(F.lit(' style="'), css, F.lit('"'))).otherwise("")


def _table(rows: Column) -> Column:
    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), T.escape_html(F.coalesce(c, F.lit("")), False), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, row(r, "th")).otherwise(row(r, "td"))), ""), F.lit("</table>"))


def to_html(blocks: DataFrame, sections: DataFrame, css: str = "") -> DataFrame:
    """doc_id, html: a page for each document that has a block to show or more than one section.

    `blocks`: doc_id, section_index, ord, kind (text, table, image), text, rows, src (of an image; null: left out), style (as of
    `style_attribute`). `sections`: doc_id, section_index of all sections, also of those without blocks. Texts that look like
    headings are h3; empty texts and tables without rows are left out.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    tag = F.when(F.coalesce(T.looks_like_heading(text), F.lit(False)), "h3").otherwise("p")
    shown = (
        F.when(F.col("kind") == "image", F.concat(F.lit(IMAGE[0]), F.when(F.col("src") != "", F.col("src")), F.lit(IMAGE[1]))).when(F.col("kind") == "table", F.when(F.size("rows") > 0, _table(F.col("rows"))))
        .when(text != "", F.concat(F.lit("<"), tag, F.coalesce("style", F.lit("")), F.lit(">"), T.escape_html(text, False), F.lit("</"), tag, F.lit(">")))
    )
    rows = blocks.select("doc_id", "section_index", "ord", shown.alias("s")).filter("s IS NOT NULL")
    breaks = sections.groupBy("doc_id").agg(F.collect_set("section_index").alias("_all"), F.min("section_index").alias("_first"))
    breaks = breaks.select("doc_id", F.explode(F.filter("_all", lambda k: k > F.col("_first"))).alias("section_index"))
    rows = rows.unionByName(breaks.select("doc_id", "section_index", F.lit(-1).cast(blocks.schema["ord"].dataType).alias("ord"), F.lit(BREAK).alias("s")))
    each = F.array_sort(F.collect_list(F.struct("section_index", "ord", "s")))
    body = F.array_join(F.transform(each, lambda x: x["s"]), "")
    return rows.groupBy("doc_id").agg(F.concat(F.lit(f'<!DOCTYPE html><html lang="ko"><head><meta charset="utf-8"><style>{css}</style></head><body>'), body, F.lit("</body></html>")).alias("html"))
