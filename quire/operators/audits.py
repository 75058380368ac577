"""Checks of packages, tables, sections and headers, over rows of their entries and elements.

`tables`: doc_id, table_ord, table_id, width, inline. `cells`: doc_id, table_ord, r, c, width. `elements`: doc_id, section, name,
text (and group, for children of style groups). Findings of `validate` are rows (doc_id, rule, detail); audits are rows
(doc_id, level, title, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config


def _finding(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))


def repeated_ids(tables: DataFrame) -> DataFrame:
    """doc_id and the ids, sorted, that several tables have."""
    twice = tables.filter("table_id IS NOT NULL").groupBy("doc_id", "table_id").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy("doc_id").agg(F.array_sort(F.collect_list("table_id")).alias("ids"))


def several_origins(cells: DataFrame) -> DataFrame:
    """Tables with more than one cell at row 0, column 0."""
    return cells.groupBy("doc_id", "table_ord").agg(F.count_if((F.col("r") == 0) & (F.col("c") == 0)).alias("n")).filter("n > 1")


def wrong_widths(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables whose width is not the sum of the widths in the first row, unless that is 0."""
    first = F.min("r").over(Window.partitionBy("doc_id", "table_ord"))
    sums = cells.withColumn("_first", first).filter("r = _first").groupBy("doc_id", "table_ord").agg(F.sum("width").alias("cell_sum"))
    return tables.filter("width IS NOT NULL").join(sums, ["doc_id", "table_ord"]).filter("cell_sum <> 0 AND cell_sum <> width")


def validate(tables: DataFrame, cells: DataFrame, line_segments: DataFrame, pre_bake: bool = True) -> DataFrame:
    """doc_id, rule, detail: signs of damage, and with pre_bake what only a fresh file must not have.

    `line_segments`: doc_id, children; a row for each array of line segments.
    """
    parts = [
        _finding(repeated_ids(tables), "repeated id", F.array_join("ids", ",")), _finding(several_origins(cells), "origins", F.concat_ws(":", F.col("table_ord").cast("string"), F.col("n").cast("string"))),
        _finding(wrong_widths(tables, cells), "width", F.concat_ws(":", F.col("table_ord").cast("string"), F.col("cell_sum").cast("string"), F.col("width").cast("string"))),
    ]
    if pre_bake:
        parts.append(_finding(line_segments.filter("children > 0").groupBy("doc_id").agg(F.count("*").alias("n")), "line segments", F.col("n")))
        parts.append(_finding(tables.filter("NOT inline").groupBy("doc_id").agg(F.count("*").alias("n")), "floating", F.col("n")))
    return reduce(DataFrame.unionAll, parts)


def audit_package(entries: DataFrame) -> DataFrame:
    """Required entries, the place and method of the first one, sections. `entries`: doc_id, ord, name, method (0: stored)."""
    docs = entries.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("name").isin(*config.REQUIRED_ENTRIES), F.col("name"))).alias("has"), F.min_by("name", "ord").alias("first"),
        F.min(F.when(F.col("name") == "mimetype", F.col("method"))).alias("method"), F.count_if(F.col("name").rlike(r"(?i)^Contents/section\d+\.xml$")).alias("sections"),
    )
    level = lambda ok: F.when(ok, "ok").otherwise("warn")
    item = lambda title, ok, detail=None: F.struct(level(ok).alias("level"), F.lit(title).alias("title"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))
    items = [item(name, F.array_contains("has", name)) for name in config.REQUIRED_ENTRIES]
    packed = F.when(F.array_contains("has", "mimetype"), item("packaging", (F.col("first") == "mimetype") & F.coalesce(F.col("method") == 0, F.lit(False))))
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*items, packed, item("sections", F.col("sections") > 0, F.col("sections"))))).alias("x")).select("doc_id", "x.*")


def structure_counts(elements: DataFrame) -> DataFrame:
    """Numbers of kinds of elements in each section, of paragraphs that contain others (container), and of empty bullets."""
    named = lambda *names: F.count_if(F.col("name").isin(*names))
    return elements.groupBy("doc_id", "section").agg(
        named("p").alias("paragraphs"), named("tbl").alias("tables"), named("ctrl").alias("controls"), named("linesegarray").alias("line_segments"), F.count_if(F.col("name").rlike("(?i)textbox|drawText")).alias("text_boxes"),
        named("run").alias("runs"), named("t").alias("texts"), F.count_if((F.col("name") == "p") & F.col("container")).alias("containers"), F.count_if((F.col("name") == "p") & F.col("text").rlike(r"(?U)^[◦❍-]\s*$")).alias("empty_bullets"),
    )


def audit_sections(elements: DataFrame) -> DataFrame:
    """doc_id, section, level, title, detail of what a section's structure calls for."""
    n = structure_counts(elements)
    item = lambda level, title, cond, detail: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"), detail.cast("string").alias("detail")))
    c, some = F.col, lambda k: F.col(k) > 0
    items = F.array(
        item("ok", "leaf paragraphs", some("containers"), c("containers")), item("info", "tables", some("tables"), c("tables")), item("warn", "fixed objects", some("controls") | some("text_boxes"), c("controls") + c("text_boxes")),
        item("info", "line segments", some("line_segments"), c("line_segments")), item("info", "empty bullets", some("empty_bullets"), c("empty_bullets")),
        item("info", "split runs", some("runs") & (c("texts") / F.when(some("runs"), c("runs")) > 1.8), c("texts")),
    )
    return n.select("doc_id", "section", F.explode(F.array_compact(items)).alias("x")).select("doc_id", "section", "x.*")


def style_counts(elements: DataFrame) -> DataFrame:
    named = {k: F.count_if(F.col("name") == k).alias(k) for k in config.STYLE_GROUPS.values()}
    return elements.groupBy("doc_id").agg(*named.values())


def audit_groups(groups: DataFrame, elements: DataFrame) -> DataFrame:
    """Whether style groups declare as many items as they have children. `groups`: doc_id, name, declared."""
    known = groups.filter(F.col("name").isin(*config.STYLE_GROUPS) & F.col("declared").isNotNull())
    child = F.element_at(F.create_map(*[F.lit(x) for kv in config.STYLE_GROUPS.items() for x in kv]), F.col("name"))
    actual = elements.filter("group IS NOT NULL").groupBy("doc_id", F.col("group").alias("name"), F.col("name").alias("child")).agg(F.count("*").alias("actual"))
    both = known.withColumn("child", child).join(actual, ["doc_id", "name", "child"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return both.select("doc_id", F.when(F.col("declared") == F.col("actual"), "ok").otherwise("warn").alias("level"), F.concat("name", F.lit(" itemCnt")).alias("title"), F.concat_ws(":", F.col("declared").cast("string"), F.col("actual").cast("string")).alias("detail"))


def audit_header(elements: DataFrame) -> DataFrame:
    """doc_id, level, title, detail of what every header gives: how many styles it defines, and that references to them are to be kept."""
    n = style_counts(elements)
    counts = F.concat_ws(":", *[F.col(k).cast("string") for k in config.STYLE_GROUPS.values()])
    items = [F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"), detail.alias("detail")) for level, title, detail in (("ok", "header styles", counts), ("info", "style references", F.lit("")))]
    return n.select("doc_id", F.explode(F.array(*items)).alias("x")).select("doc_id", "x.*")


def warnings(audit: DataFrame) -> DataFrame:
    """doc_id, warnings: how many items of the audit are warnings."""
    return audit.groupBy("doc_id").agg(F.count_if(F.col("level") == "warn").alias("warnings"))


def section_entries(entries: DataFrame) -> DataFrame:
    """doc_id, name, rank of the entries that hold sections, in lexicographic order: those in the usual place, else those of the
    usual name, else any markup with `section` in its name; the first kind that a package has counts."""
    base = F.substring_index("name", "/", -1)
    tier = F.when(F.col("name").rlike(r"(?i)^Contents/section\d+\.xml"), 1).when(base.rlike(r"(?i)^section\d+\.xml"), 2).when(F.col("name").endswith(".xml") & F.contains(F.lower("name"), F.lit("section")), 3)
    rows = entries.select("doc_id", "name", tier.alias("tier")).filter("tier IS NOT NULL")
    rows = rows.withColumn("least", F.min("tier").over(Window.partitionBy("doc_id"))).filter("tier = least")
    return rows.select("doc_id", "name", F.row_number().over(Window.partitionBy("doc_id").orderBy("name")).alias("rank"))


def numbered_sections(entries: DataFrame) -> DataFrame:
    """doc_id, name, section_index of the entries `section<number>.xml`, in order of their numbers, from 0."""
    number = F.regexp_extract("name", r"(?i)(^|/)section(\d+)\.xml$", 2)
    rows = entries.select("doc_id", "name", number.alias("number")).filter("number <> ''")
    return rows.select("doc_id", "name", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("number").cast("decimal(38,0)"), "name")) - 1).alias("section_index"))
