"""Sections in their rows, figures that meet a report once, settings and labels, queries as a whole."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import config
from quire.functions import settings as V
from quire.functions import text as T
from quire.operators import figures as G
from quire.operators import sections as S

MD = "doc_id long, md string"


def test_repeated_and_null_ids_stay_apart(spark):
    rows = [(1, "x\n# A\n◦ b\n◦ c\ntail"), (1, "# Z\n- y"), (None, "1. q"), (None, "no heading"), (2, None), (3, " \n"), (4, "")]
    got = S.split_sections(spark.createDataFrame(rows, MD), paths=True).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.section_path, r.title, r.depth, r.text, r.char_start, r.char_end, r.section_id) for r in got)
    assert found == sorted([
        (False, 1, "A", "A", 1, "# A", 2, 6, "S0"), (False, 1, "A > b", "b", 3, "◦ b", 6, 10, "S1"), (False, 1, "A > b > c", "c", 3, "◦ c\ntail", 10, 18, "S2"), (False, 1, "Z", "Z", 1, "# Z", 0, 4, "S0"), (False, 1, "Z > y", "y", 4, "- y", 4, 7, "S1"),
        (True, 0, "q", "q", 1, "1. q", 0, 4, "S0"), (True, 0, config.WHOLE_TITLE, config.WHOLE_TITLE, 0, "no heading", 0, 10, "S0"),
    ])
    plan = S.split_sections(spark.createDataFrame(rows, MD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_paths_equal_those_by_windows(spark):
    marks = ["# ", "## ", "1. ", "가. ", "◦ ", "- ", "", "#### ", "  - ", "-"]
    rows = [(d, "\n".join(f"{marks[(d * i * 7 + i * i) % 10]}t{i}" for i in range(d % 23))) for d in range(120)]
    sections = S.split_sections(spark.createDataFrame(rows, MD), paths=True)
    windows = S.with_parents(sections.drop("parent_path", "section_path"))
    key = lambda df: sorted((r.doc_id, r.ord, r.parent_path, r.section_path) for r in df.collect())
    assert key(sections) == key(windows) and sections.count() > 900


def test_heading_signs_cover_all_headings(spark):
    lines = ["# a", "#a", "###### b", "□ (x) y", "1. x", "１２. x", "가. x", "하. x", "◦ x", "☐ x", "- x", "-x", " \t- x", "　- x", "x", "", "x - y", "나. "]
    r = spark.createDataFrame([(x,) for x in lines], "l string").select("l", T.depth(F.col("l")).alias("d"), T.may_be_heading(F.col("l")).alias("m")).collect()
    assert all(x.m for x in r if x.d is not None) and sum(x.d is not None for x in r) >= 11


def test_figures_meet_a_report(spark):
    reports = spark.createDataFrame([(1, "one two three  four five"), (2, None)], MD)
    figures = spark.createDataFrame([(1, "a", "two three  four"), (1, "b", "two three four"), (1, "c", "absent words here"), (1, "d", None), (2, "e", "one two three"), (3, "f", "one two three")], "doc_id long, figure_id string, anchor_text string")
    got = {r.figure_id: (r.total_chars, r.here and tuple(r.here), r.anchored) for r in G.in_report(figures, reports).collect()}
    assert got == {"a": (24, (4, 19), True), "b": (24, None, True), "c": (24, None, False), "d": (24, None, False), "e": (None, None, False), "f": (None, None, False)}


def test_labels_and_settings(spark):
    row = spark.range(1).select(
        V.labelled(F.lit("x [a] 1\n2 [b]  [a] 3")).alias("m"), V.labelled(F.lit(None).cast("string")).alias("none"), V.parsed(F.lit("A=1\n#B=2\r\nB = \"x=y\" \nA=9\nC={c}\nD=\nE='q'\nno")).alias("p"),
        V.layered(F.create_map(F.lit("A"), F.lit("")), V.parsed(F.lit("A=2\nB=3")), V.parsed(F.lit("B=4\nC=5/"))).alias("l"), V.layered(F.lit(None).cast("map<string,string>")).alias("e"),
    )
    r = row.select("*", V.setting(F.col("l"), "X", "C").alias("c"), V.setting(F.col("l"), "X").alias("x")).first()
    assert r.m == {"a": "3", "b": ""} or r.m == {"a": "3"}
    assert r.none == {} and r.p == {"A": "1", "B": "x=y", "E": "q"} and r.l == {"A": "2", "B": "3", "C": "5/"} and r.e == {} and r.c == "5" and r.x is None


def test_white_space_is_what_the_pattern_takes(spark):
    signs = [chr(c) for c in range(0x3100) if c < 0xD800]
    r = spark.createDataFrame([(f"{c}x{c}",) for c in signs], "t string").select("t", T.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b")).filter("a <> b").collect()
    assert r == []


def test_every_query_with_sql_is_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 120


def test_pages(spark):
    from quire.operators import pages as H

    style = "char_font_size double, char_bold boolean, char_italic boolean, char_color string, para_align string, para_margin_top double, para_margin_bottom double"
    rows = [
        (1, 0, 0, "text", " 1. Head & <b> ", None, None, 10.0, True, True, "#00ff00", "left", 3.5, 99.0), (1, 0, 1, "text", "plain " * 9, None, None, 99.0, False, None, "green", "justify", 0.0, None), (1, 2, 0, "table", None, [["a", None], ['"', "d"]], None, *[None] * 7),
        (1, 2, 1, "image", None, None, "data:x", *[None] * 7), (1, 2, 2, "image", None, None, None, *[None] * 7), (1, 2, 3, "table", None, [], None, *[None] * 7), (1, 2, 4, "text", " ", None, None, *[None] * 7), (2, 0, 0, "text", None, None, None, *[None] * 7),
    ]
    blocks = spark.createDataFrame(rows, f"doc_id long, section_index int, ord int, kind string, text string, rows array<array<string>>, src string, {style}").withColumn("style", H.style_attribute())
    sections = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)], "doc_id long, section_index int")
    got = {r.doc_id: r.html.split("<body>")[1] for r in H.to_html(blocks, sections).collect()}
    assert got == {
        1: '<h3 style="font-size:10.0pt;font-weight:700;font-style:italic;color:#00ff00;text-align:left;margin-top:3.5pt;margin-bottom:30pt">1. Head &amp; &lt;b&gt;</h3>' + f'<p style="font-size:28pt">{("plain " * 9).strip()}</p>' + H.BREAK * 2
        + f"<table><tr><th>a</th><th></th></tr><tr><td>&quot;</td><td>d</td></tr></table>{H.IMAGE[0]}data:x{H.IMAGE[1]}</body></html>", 3: f"{H.BREAK}</body></html>",
    }
