import random
import struct

from pyspark.sql import functions as F

from quire import config, streaming
from quire.functions import files
from quire.functions import text as T
from quire.operators import blocks, figures, plan, records, sections, streams
from quire.sources import sinks
from quire.sources.records import decode_records

REPORT = "머리말\n# 사업 개요\n1. 추진 계획\n가. 2024년 1단계 착공\n◦ 세부 위치\n◦ 면적 비교"


def test_sections_scores_and_parents(spark):
    md = spark.createDataFrame([(1, REPORT), (2, ""), (3, "plain\ntext"), (4, "# A\n◦ b\n◦ c")], "doc_id long, md string")
    found = sections.scores(sections.features(sections.with_parents(sections.split_sections(md))))
    rows = {(r.doc_id, r.section_id): r for r in found.collect()}
    one = [rows[1, f"S{i}"] for i in range(5)]
    assert [(r.depth, r.title, r.parent_path, r.char_start, r.char_end) for r in one] == [
        (1, "사업 개요", "", 4, 12), (1, "추진 계획", "", 12, 21), (2, "2024년 1단계 착공", "추진 계획", 21, 37),
        (3, "세부 위치", "추진 계획 > 2024년 1단계 착공", 37, 45), (3, "면적 비교", "추진 계획 > 2024년 1단계 착공", 45, 52),
    ]
    assert (one[0].t1, one[0].t6, one[1].t4, round(one[1].t2, 4), one[2].t4) == (0.3, 0.2, 1.0, 0.1333, 0.5)
    assert {k for k in rows if k[0] == 2} == set() and rows[3, "S0"].depth == 0
    assert [rows[4, f"S{i}"].parent_path for i in range(3)] == ["", "A", "A > b"]
    assert {r.section_id for r in sections.candidates(found).filter("doc_id = 1").collect()} == {"S1", "S2", "S3", "S4"}


def test_vote(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0, "A", "roadmap", 0.8, 0.6, ["a", "b"]), (1, 0, 1, "A", "photo", 0.6, 0.9, ["x"]), (1, 0, 2, "A", "photo", 0.4, 0.7, ["y"]), (1, 1, 0, "A", "roadmap", 0.6, 0.8, ["b", "c"]), (1, 2, 0, "B", "photo", 0.9, 0.9, ["z"])],
        "doc_id long, run_id int, pos int, section_path string, figure_type string, confidence double, final_score double, suggested_content array<string>",
    )
    out = {r.figure_id: (r.figure_type, r.vote_count, round(r.confidence, 2), round(r.final_score, 2), r.suggested_content) for r in figures.vote(runs).collect()}
    assert out == {"F1": ("roadmap", 2, 0.7, 0.7, ["a", "b", "c"]), "F2": ("photo", 2, 0.5, 0.8, ["x", "y"])}


def test_similar_purposes(spark):
    rows = [(1, 0, "a b c d e"), (1, 1, "a b c x y"), (1, 2, "a b c d y"), (1, 3, ""), (1, 4, "")]
    kept = figures.drop_similar(spark.createDataFrame(rows, "doc_id long, pos int, purpose string"))
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 3, 4]


def test_decode_and_rules(spark):
    def record(tag, level, data):
        return struct.pack("<I", tag | level << 10 | len(data) << 20) + data

    raw = record(0x32, 0, b"abcd") + record(0x33, 0, b"xy") + record(0x36, 1, b"secd") + record(0x45, 2, b"\1\0") + record(0x32, 3, b"")
    long = struct.pack("<II", 0x10 | 0xFFF << 20, 5000) + b"z" * 5000 + b"\0\0\0"
    out = decode_records(spark.createDataFrame([("a", raw), ("b", long), ("c", b""), ("d", None)], "file string, content binary"))
    rows = {(r.file, r.ord): r for r in out.collect()}
    assert len(raw) == 32 and [rows["a", i].offset for i in range(5)] == [0, 8, 14, 22, 28]
    assert rows["b", 0].size == 5000 and len(rows) == 6
    assert records.findings(out.filter("file = 'a'")).count() == 0
    assert {r.parent_ord for r in records.parents(out.filter("file = 'a'")).collect()} == {None, 1, 2, 3}
    same = out.filter("file = 'a'")
    assert records.compare(same, same).count() == 0
    assert [(r.kind, r.severity) for r in records.compare(same, same.filter("ord < 4")).collect()] == [("MISSING", "CRITICAL")]


def test_text_functions(spark):
    df = spark.createDataFrame([(" a\r\nb\n\n\n\nc ", '```json\n{"a": 1}\n```')], "t string, j string")
    r = df.select(T.normalise(F.col("t")).alias("t"), T.json_object(F.col("j")).alias("j"), figures.anchor_exists(F.lit("abcdefghij  k"), F.lit("x abcdefghij k y")).alias("f")).first()
    assert (r.t, r.j, r.f) == ("a\nb\n\nc", '{"a": 1}', True)
    assert config.CANDIDATE_SCORE == 0.4


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_list_counts_and_parents(spark):
    raw = b"".join(struct.pack("<I", tag | level << 10 | len(data) << 20) + data for tag, level, data in [(0x45, 0, b"\2\0"), (0x32, 1, b""), (0x32, 2, b""), (0x32, 1, b""), (0x45, 0, b"\3\0"), (0x32, 1, b""), (0x45, 0, b"\1"), (0x32, 0, b"")])
    out = decode_records(spark.createDataFrame([("a", raw)], "file string, content binary")).withColumn("declared", records.declared_count(F.col("data")))
    assert {(r.ord, r.declared, r.actual) for r in records.wrong_list_counts(out).collect()} == {(4, 3, 1), (6, None, 0)}
    assert {r.ord: r.parent_ord for r in records.parents(out).collect()} == {0: None, 1: 0, 2: 1, 3: 0, 4: None, 5: 4, 6: None, 7: None}
    assert records.parents(out.limit(0)).count() == 0 and {r.parent_ord for r in records.parents(out.filter("level = 0")).collect()} == {None}


def test_merged_cells(spark):
    rows = [(1, 0, 0, 0, 0, 1, 2, "h"), (1, 0, 1, 0, 1, 1, 1, "p"), (1, 0, 2, 1, 0, 1, 1, "a"), (1, 0, 3, 1, 1, 1, 1, "b"), (1, 0, 4, 2, 0, 0, 0, None), (1, 0, 5, 2, 1, 1, 1, "")]
    out = blocks.merged_rows(spark.createDataFrame(rows, "doc_id long, table_id int, ord int, r int, c int, rowspan int, colspan int, text string"))
    assert {r.r: r.texts for r in out.collect()} == {0: ["h"], 1: ["a", "b"]}


def test_context_and_nearest_title(spark):
    rows = [(1, 0, "x"), (1, 1, "# T  one"), (1, 2, None), (1, 3, "y"), (2, 0, "z")]
    out = blocks.with_context(blocks.with_nearest_title(spark.createDataFrame(rows, "doc_id long, ord int, text string"), "^#", "none"), 1).collect()
    assert {(r.doc_id, r.ord): (r.nearest_title, r.context) for r in out} == {(1, 0): ("none", "x\n# T  one"), (1, 1): ("# T one", "x\n# T  one"), (1, 2): ("# T one", "# T  one\n\ny"), (1, 3): ("# T one", "y"), (2, 0): ("none", "z")}


def test_positions_and_additions(spark):
    reports = spark.createDataFrame([(1, "ab cd ef")], "doc_id long, md string")
    parts = spark.createDataFrame([(1, 0, "A", "A", 0, 2), (1, 1, "B", "A > B", 3, 5), (1, 2, "A", "A", 6, 8), (1, 3, "", "", 9, 9)], "doc_id long, ord int, title string, section_path string, char_start long, char_end long")
    figs = spark.createDataFrame([(1, "F1", "cd", "A"), (1, "F2", "", "A"), (1, "F3", "zz", "x B"), (1, "F4", None, "none"), (2, "F1", "ab", "A")], "doc_id long, figure_id string, anchor_text string, section_path string")
    out = {(r.doc_id, r.figure_id): (r.char_start, r.char_end) for r in figures.locate(figs, reports, parts).collect()}
    assert out == {(1, "F1"): (3, 5), (1, "F2"): (6, 8), (1, "F3"): (3, 5), (1, "F4"): (None, None), (2, "F1"): (None, None)}
    voted = spark.createDataFrame([(1, "F1", "A", "photo", 0.9, 0.8, 2), (1, "F2", "A", "map", 0.9, 0.8, 2)], "doc_id long, figure_id string, section_path string, figure_type string, confidence double, final_score double, vote_count long")
    more = spark.createDataFrame([(1, 5, None, None, None), (3, 1, "B", "photo", 0.7)], "doc_id long, pos long, section_path string, figure_type string, confidence double")
    out = figures.add_missing(voted.filter("figure_id = 'F2'"), voted, more).collect()
    assert {(r.doc_id, r.figure_id, r.section_path, r.figure_type, r.confidence) for r in out} == {(1, "F2", "A", "map", 0.9), (1, "F3", "", "concept_diagram", 0.5), (3, "F1", "B", "photo", 0.7)}
    same = spark.createDataFrame([(1, 0, " An ", "p", "t", None), (1, 1, "an", "q", "t", ""), (1, 2, "", "an", "t", ""), (1, 3, None, "", "t", "")], "doc_id long, pos int, anchor_text string, purpose string, figure_type string, section_path string")
    assert sorted(r.pos for r in figures.drop_repeated(same).collect()) == [0, 3]


def test_tree_parents_past_gaps(spark):
    rng = random.Random(12)
    files = {"gap": [0, 3, 3, 2], "deep": [5, 1, 0, 2, 9, 9, 1], **{f"r{k}": [rng.randrange(6) for _ in range(rng.randrange(1, 40))] for k in range(30)}}
    want = {}
    for name, levels in files.items():
        stack = []
        for i, level in enumerate(levels):
            del stack[level:]
            want[name, 10 * i] = stack[-1] if stack else None
            stack.append(10 * i)
    assert [want["gap", i] for i in (0, 10, 20, 30)] == [None, 0, 10, 10]
    rows = spark.createDataFrame([(name, 10 * i, level) for name, levels in files.items() for i, level in enumerate(levels)], "file string, ord long, level int")
    assert {(r.file, r.ord): r.parent_ord for r in records.tree_parents(rows).collect()} == want
    assert records.tree_parents(rows.limit(0)).columns == ["file", "ord", "level", "parent_ord"]


def test_stack_of_sections_and_wide_spaces(spark):
    md = "# A\n◦ b\n◦ c\n1.　한글\n가. 둘\n- x"
    rows = sections.with_parents(sections.split_sections(spark.createDataFrame([(1, md)], "doc_id long, md string"))).orderBy("ord").collect()
    assert [(r.title, r.depth, r.parent_path) for r in rows] == [("A", 1, ""), ("b", 3, "A"), ("c", 3, "A > b"), ("한글", 1, ""), ("둘", 2, "한글"), ("x", 4, "한글 > 둘")]


def test_features_of_a_table(spark):
    md = "# T\n| a | b |\n| 대비 12 | 3 |"
    rows = sections.scores(sections.features(sections.split_sections(spark.createDataFrame([(1, md)], "doc_id long, md string")))).collect()
    assert rows[0].has_table and 0 < rows[0].t2 <= 0.3


def _file(spark, records, name="f", stream="BodyText/Section0"):
    rows = [(name, stream, i, tag, level, bytes(data)) for i, (tag, level, data) in enumerate(records)]
    return spark.createDataFrame([(name, stream)], "file string, stream string"), spark.createDataFrame(rows, "file string, stream string, ord int, tag int, level int, data binary")


GOOD = [(0x32, 0, b"abcd"), (0x33, 0, b"xy"), (0x36, 1, b"secd"), (0x45, 2, b"\1\0"), (0x32, 3, b"")]


def test_contract_and_checks_of_a_stream(spark):
    found = streams.section_rules(*_file(spark, GOOD)).collect()
    assert found == [] and streams.structure_checks(_file(spark, GOOD)[1]).count() == 0
    bad = [(0x33, 0, b"x"), (0x36, 2, b"zzzz"), (0x45, 0, b"\1"), (0x45, 0, b"\5\0"), (0x32, 1, b""), (0x36, 1, b"revt")]
    assert {(r.rule, r.offset) for r in streams.section_rules(*_file(spark, bad)).collect()} == {("R-031", 0), ("R-042", 0), ("R-040", 5), ("R-041", 5), ("R-041", 28)}
    checks = {(r.rule, r.severity, r.detail) for r in streams.verify(*_file(spark, bad)).collect()}
    assert {("S-001", "ERROR", None), ("S-002", "ERROR", "too short"), ("S-002", "WARN", "5:1"), ("controls", "ERROR", "unknown"), ("controls", "ERROR", "no data"), ("controls", "WARN", "REVISION")} == checks
    counts = (2).to_bytes(4, "little") + bytes(28)
    doc = [(0x10, 0, b""), (0x11, 0, counts), (0x12, 0, b""), (0x1E, 1, b"")]
    assert {(r.rule, r.detail) for r in streams.document_rules(*_file(spark, doc, stream="DocInfo")).collect()} == {("R-014", "BIN_DATA:2:1"), ("R-015", None)}
    assert {r.rule for r in streams.document_rules(*_file(spark, GOOD)).collect()} == {"R-010"}


def test_streams_that_are_empty_or_missing(spark):
    names = spark.createDataFrame([("a", "DocInfo"), ("a", "BodyText/Section0"), ("a", "MasterPage/0"), ("b", "BodyText/Section0"), ("b", "BodyText/Section1")], "file string, stream string")
    records = _file(spark, [(0x32, 0, b""), (0x36, 0, b"hdr ")], "b")[1]
    assert {(r.file, r.rule) for r in streams.contract(names, records).collect()} == {("a", "R-011"), ("a", "R-030"), ("b", "R-010"), ("b", "R-030"), ("b", "R-041")}
    assert {(r.file, r.rule) for r in streams.contract(names, records, 1).collect()} == {("a", "R-011"), ("a", "R-030"), ("b", "R-010"), ("b", "R-041")}
    assert {(r.file, r.severity) for r in streams.master_checks(names, records).collect()} == {("a", "ERROR"), ("b", "WARN")}
    report = {r.file: r.status for r in streams.report(names, streams.master_checks(names, records), ("ERROR", "WARN", "INFO")).collect()}
    assert report == {"a": "FAIL", "b": "PASS"}


def test_comparison_of_files(spark):
    one = _file(spark, GOOD)
    assert streams.compare(one, one).count() == 0
    same = streams.diff_report(one[0], streams.compare(one, one)).first()
    changed = [*GOOD[:1], (0x33, 0, b"xz"), *GOOD[2:]]
    assert same.status == "IDENTICAL" and streams.diff_report(one[0], streams.compare(one, _file(spark, changed))).first().status == "WARN"
    diffs = streams.prioritised(streams.compare(one, _file(spark, [(0x32, 1, b"abXdef"), *changed[1:4]]))).orderBy("priority").collect()
    assert [(r.kind, r.severity, r.i, r.differs_at) for r in diffs] == [("MISSING", "CRITICAL", 4, None), ("LEVEL", "HIGH", 0, None), ("SIZE", "HIGH", 0, None), ("DATA", "MEDIUM", 0, 2), ("DATA", "MEDIUM", 1, 1)]
    raw = spark.createDataFrame([(bytes(5000) + b"a", bytes(5000) + b"b"), (b"", b"x"), (b"ab", b"ab"), (b"ab", b"abc")], "a binary, b binary")
    assert [r.n for r in raw.select(streams.first_difference(F.col("a"), F.col("b")).alias("n")).collect()] == [5000, 0, 2, 2]


def test_vote_counts_runs_without_figures(spark):
    rows = [(1, 0, 0, "A", "photo", 0.5, 0.5, ["x", "y"], "first"), (1, 1, 0, "A", "photo", 0.7, 0.9, ["y", "z"], "second")]
    runs = spark.createDataFrame(rows, "doc_id long, run_id int, pos int, section_path string, figure_type string, confidence double, final_score double, suggested_content array<string>, purpose string")
    got = figures.vote(runs).first()
    assert (got.suggested_content, got.purpose, round(got.confidence, 6), got.vote_count) == (["x", "y", "z"], "first", 0.6, 2)
    assert figures.vote(runs, spark.createDataFrame([(1, k) for k in range(4)], "doc_id long, run_id int")).count() == 0


def test_islands_keep_content(spark):
    rows = [(1, k, f"F{k}", "A", "photo", 1.0 - k / 10, c) for k, c in enumerate((["a", "b"], ["b", "c"], None))] + [(1, 3, "F3", "B", "photo", 0.1, ["d"])]
    got = figures.merge_islands(spark.createDataFrame(rows, "doc_id long, rank int, figure_id string, section_path string, figure_type string, final_score double, suggested_content array<string>")).orderBy("rank").collect()
    assert [(r.figure_id, r.suggested_content, r.merged) for r in got] == [("F0", ["a", "b", "c"], 3), ("F3", ["d"], 1)]


def test_similar_figures_and_self_check(spark):
    purposes = ["a b c d e", "a b c d x", "", " ", "a b c", "e d c b a", None]
    got = figures.drop_similar(spark.createDataFrame([(1, k, p) for k, p in enumerate(purposes)], "doc_id long, pos int, purpose string"))
    assert sorted(r.pos for r in got.collect()) == [0, 2, 3, 4, 6]
    md = "the first anchor of all\nand another　anchor here " + "x" * 3000
    rows = [(1, "F1", "first anchor of", 0.9, "p q"), (1, "F2", "another anchor here", 0.5, "r s"), (1, "F3", "not in the text", 0.9, "t"), (1, "F4", "the first anchor", 0.4, "u"), (1, "F5", "the first anchor", 0.9, "q p"), (1, "F10", "short", 1.0, "v")]
    checked = plan.self_check(spark.createDataFrame(rows, "doc_id long, figure_id string, anchor_text string, confidence double, purpose string"), spark.createDataFrame([(1, md)], "doc_id long, md string"))
    assert sorted((r.figure_id, r.purpose) for r in checked.collect()) == [("F1", "p q"), ("F2", "r s")]


def test_blocks(spark):
    rows = [(1, 0, "text", "&lt;T&gt; &amp; title here", []), (1, 1, "table", "", [["a|b", "c"], ["d\ne"], []]), (1, 2, "image", "", []), (1, 3, "text", " ", []), (1, 4, "text", "- point", [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, ord int, kind string, text string, rows array<array<string>>, section_index int")
    assert blocks.to_markdown(df).first().md == "<T> & title here\n\n| a|b | c |\n| --- | --- |\n| d e |  |\n\n- point"
    assert blocks.to_plain_text(df).first().plain == "&lt;T&gt; &amp; title here\na|b\tc\nd e\n- point"
    assert blocks.to_display_markdown(df.filter("ord <> 1")).first().md == "# &lt;T&gt; &amp; title here\n\n- point"
    assert tuple(blocks.statistics(df).first()) == (1, 1, 3, 1, 41)


def test_file_functions(spark):
    raw = "한글".encode("cp949")
    df = spark.createDataFrame([("a.TXT", raw), ("b.md", "﻿é\r\n\r\n\r\n\r\nx".encode()), ("c.pdf", b"%PDF"), ("d", b"\xff\xff\xff"), (None, None)], "path string, content binary")
    got = [r.t for r in df.select(files.plain_text(F.col("content"), F.col("path")).alias("t")).collect()]
    assert got[0] == "한글" and got[1].endswith("é\n\nx") and got[2] is None and got[3] == "�" * 3 and got[4] is None
    assert spark.range(1).select(T.table_markdown(F.array(F.array(F.lit("a\nb"), F.lit("|")), F.array(F.lit("c")))).alias("t")).first().t == "| a<br>b | \\| |\n| --- | --- |\n| c |  |"


def test_sinks_and_files_that_arrive(spark, tmp_path):
    df = spark.createDataFrame([(1, "# a"), (2, None)], "doc_id long, md string")
    sinks.write_json(df, f"{tmp_path}/json")
    sinks.write_markdown(df, f"{tmp_path}/md")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect()) == ['{"doc_id":1,"md":"# a"}', '{"doc_id":2}']
    df.write.parquet(f"{tmp_path}/in")
    job = lambda batch: sections.split_sections(batch)
    for _ in range(2):
        streaming.follow(spark, f"{tmp_path}/in", "doc_id long, md string", job, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 1
        spark.createDataFrame([], "doc_id long, md string").write.mode("append").parquet(f"{tmp_path}/in")
