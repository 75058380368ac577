"""Blocks and table cells of documents: merged cells, text around a block, the nearest title before it.

`blocks`: doc_id, ord, text. `cells`: doc_id, table_id, ord, r, c, rowspan, colspan, text. All is keyed by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T


def covered_cells(cells: DataFrame, table: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """Columns of `table`, r, c of the places that the spans of cells cover, but for the cells' own."""
    reach = lambda at, span: F.sequence(F.col(at), F.col(at) + F.greatest(F.col(span), F.lit(1)) - 1)
    spread = cells.filter("rowspan > 1 OR colspan > 1").select(*table, F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(reach("r", "rowspan")).alias("r"), reach("c", "colspan").alias("cs"))
    return spread.withColumn("c", F.explode("cs")).filter("r <> r0 OR c <> c0").select(*table, "r", "c").distinct()


def merged_rows(cells: DataFrame, table: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """Columns of `table`, r, texts: the rows of each table without cells that another cell's spans cover; blank rows go."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    rows = cells.join(covered_cells(cells, table), [*table, "r", "c"], "left_anti").groupBy(*table, "r").agg(texts.alias("texts"))
    return rows.filter(F.exists("texts", lambda x: x != ""))


#: Blocks on either side of one that are its context.
SPAN = 8


def with_context(blocks: DataFrame, span: int = SPAN, of: Column | None = None) -> DataFrame:
    """Adds context: the texts of at most `span` blocks on either side and of the block itself.

    With `of` the context is right for blocks where it holds, and holds only their texts elsewhere: texts that are near none of
    them are not gathered for anything.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(-span, span)
    text = F.coalesce("text", F.lit(""))
    if of is None:
        return blocks.withColumn("context", T.normalise(F.array_join(F.collect_list(text).over(w), "\n")))
    rows = blocks.withColumn("_of", F.coalesce(of, F.lit(False))).withColumn("_near", F.max("_of").over(w))
    return rows.withColumn("context", T.normalise(F.array_join(F.collect_list(F.when(F.col("_near"), text)).over(w), "\n"))).drop("_of", "_near")


def with_nearest_title(blocks: DataFrame, pattern: str, default: str, chars: int = 80) -> DataFrame:
    """Adds nearest_title: the last text up to the block that has the pattern, white space collapsed, cut for display."""
    shown: Column = F.substring(F.regexp_replace("text", r"(?U)\s+", " "), 1, chars)
    found = F.last(F.when(F.col("text").rlike(pattern), shown), ignorenulls=True)
    return blocks.withColumn("nearest_title", F.coalesce(found.over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))


def _in_order(blocks: DataFrame, piece: Column, sep: str, name: str) -> DataFrame:
    """doc_id and the pieces of its blocks (null ones left out) in order, as one text."""
    each = F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("ord", piece.alias("s")))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["s"]), sep).alias(name))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, md: text blocks as paragraphs and tables as pipe tables, cleaned, in order; images are left out.

    `blocks`: doc_id, ord, kind (text, table, image), text, rows.
    """
    cells = F.transform(F.filter("rows", lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: T.strip(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"(?U)\s+", " "))))
    wide = F.array_max(F.transform(cells, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    table = F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))
    text = T.clean(F.col("text"))
    piece = F.when((F.col("kind") == "text") & (text != ""), text).when(F.col("kind") == "table", table)
    return _in_order(blocks, F.concat(piece, F.lit("\n")), "\n", "md").withColumn("md", T.strip(F.col("md")))


def to_plain_text(blocks: DataFrame) -> DataFrame:
    """doc_id, plain: a line for each text and each row of a table that isn't empty, its cells parted by tabs."""
    rows = F.transform("rows", lambda r: F.transform(r, lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    rows = F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, "\t"))
    text = T.strip(F.col("text"))
    piece = F.when((F.col("kind") == "text") & (text != ""), text).when((F.col("kind") == "table") & (F.size(rows) > 0), F.array_join(rows, "\n"))
    return _in_order(blocks, piece, "\n", "plain")


def to_display_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, md: the first longer text as title, headings and bullets by their marks, tables as pipe tables with escaped pipes."""
    text = T.strip(F.coalesce("text", F.lit("")))
    is_text = (F.col("kind") == "text") & (text != "")
    first = F.min(F.when(is_text & (F.length(text) > config.MARKDOWN_TITLE_CHARS), F.col("ord"))).over(Window.partitionBy("doc_id"))
    rows = blocks.withColumn("_first", first)
    shown = (
        F.when(F.col("ord") == F.col("_first"), F.concat(F.lit("# "), text)).when(text.rlike(f"(?U){config.MARKDOWN_HEADING}"), F.concat(F.lit("## "), text))
        .when(text.rlike(f"(?U){config.MARKDOWN_BULLET}"), F.concat(F.lit("- "), F.regexp_replace(text, f"(?U){config.MARKDOWN_BULLET}", ""))).otherwise(text)
    )
    cells = F.transform("rows", lambda r: F.transform(r, lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    piece = F.when(is_text, shown).when(F.col("kind") == "table", F.when(F.size("rows") > 0, T.table_markdown(cells)).otherwise(""))
    return _in_order(rows, piece, "\n\n", "md")


def statistics(blocks: DataFrame) -> DataFrame:
    """doc_id, section_count, paragraph_count, table_count, total_chars (of texts and cells)."""
    kind = lambda k: F.col("kind") == k
    cells = F.aggregate(F.flatten("rows"), F.lit(0).cast("long"), lambda n, c: n + F.length(F.coalesce(c, F.lit(""))))
    chars = F.when(kind("text"), F.length("text").cast("long")).when(kind("table"), cells).otherwise(0)
    return blocks.groupBy("doc_id").agg(F.count_distinct("section_index").alias("section_count"), F.count_if(kind("text")).alias("paragraph_count"), F.count_if(kind("table")).alias("table_count"), F.sum(F.coalesce(chars, F.lit(0))).alias("total_chars"))


def with_line_class(blocks: DataFrame) -> DataFrame:
    """Adds class to text blocks: the first longer one that has no number is the title."""
    text = F.col("text")
    able = (F.col("kind") == "text") & (F.length(text) > config.TITLE_CHARS) & ~text.rlike(f"(?U){config.NO_TITLE}")
    first = F.min(F.when(able, F.col("ord"))).over(Window.partitionBy("doc_id"))
    rows = blocks.withColumn("_first", first)
    return rows.withColumn("class", F.when(F.col("kind") == "text", T.line_class(text, F.coalesce(F.col("ord") == F.col("_first"), F.lit(False))))).drop("_first")


def table_class(rows: Column) -> Column:
    """`title` for a table of one short cell, `restoration` if its first row compares before and after, else null."""
    first = F.get(rows, F.lit(0))
    lone = F.get(first, F.lit(0))
    return F.when((F.size(rows) == 1) & (F.size(first) == 1) & (lone != "") & (F.length(lone) <= 80), "title").when(F.array_join(first, " ").rlike(r"(?U)복원\s*[전후]"), "restoration")


def distinct_images(images: DataFrame) -> DataFrame:
    """The first of the references to one image within a paragraph. `images`: doc_id, paragraph, ord, bin_ref, and more."""
    first = Window.partitionBy("doc_id", "paragraph", "bin_ref").orderBy("ord")
    return images.filter(F.coalesce("bin_ref", F.lit("")) != "").withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def with_styles(paragraphs: DataFrame, styles: DataFrame, ref: str, prefix: str) -> DataFrame:
    """Adds the columns of the style that `ref` names, with a prefix; else those of style "0", else null. `styles`: doc_id, id (once in a document), and more.

    The styles of a document meet its paragraphs as one array, by the document alone.
    """
    own = [c for c in styles.columns if c not in ("doc_id", "id")]
    known = styles.groupBy("doc_id").agg(F.collect_list(F.struct("id", *own)).alias("_styles"))
    named = lambda name: F.get(F.filter("_styles", lambda s: s["id"] == name), F.lit(0))
    rows = paragraphs.withColumn(ref, F.coalesce(ref, F.lit("0"))).join(known, "doc_id", "left").withColumn("_s", F.coalesce(named(F.col(ref)), named(F.lit("0"))))
    return rows.select(*paragraphs.columns, *[F.col(f"_s.{c}").alias(f"{prefix}{c}") for c in own])


def gathered(blocks: DataFrame, *columns: str) -> DataFrame:
    """doc_id, _blocks: the blocks of a document in order as one array of ord, text (null: empty) and more columns."""
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"), *columns))).alias("_blocks"))


def ord_of_anchor(blocks: Column, anchor: Column, chars: int = config.ANCHOR_CHARS) -> Column:
    """ord of the first of the blocks (of `gathered`) that holds the start of an anchor, or -1."""
    needle = F.substring(anchor, 1, chars)
    found = F.get(F.filter(blocks, lambda b: F.contains(b["text"], needle)), F.lit(0))["ord"]
    return F.coalesce(F.when(F.coalesce(anchor, F.lit("")) != "", found), F.lit(-1)).cast("int")


def block_of_anchor(figures: DataFrame, blocks: DataFrame, chars: int = config.ANCHOR_CHARS) -> DataFrame:
    """Adds block_ord: the first block of the document that holds the start of the figure's anchor, or -1.

    The texts of a document's blocks meet its figures as one array.
    """
    return figures.join(gathered(blocks), "doc_id", "left").withColumn("block_ord", ord_of_anchor(F.col("_blocks"), F.col("anchor_text"), chars)).drop("_blocks")
