"""Queries against their SQL over small tables with rows that the test tables lack."""

import dataclasses

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire import config
from quire.operators import blocks as B
from quire.operators import edits as E
from quire.operators import figures as G
from quire.operators import markup as M
from quire.operators import plan as Q
from quire.operators import planner as R
from quire.operators import sections as N
from quire.operators import slots as P
from quire.operators import streams as S
from quire.sources import records as D


def differences(spark, folder, name: str, table: str, rows: list, schema: str) -> list:
    """Rows of a query over one small table that its SQL lacks, and the reverse."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = entry.queries()[name](spark, str(folder))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
        want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in got.collect()]
    assert want
    return sorted(map(repr, set(got) ^ set(want))) + ([] if len(got) == len(want) else [f"{len(got)} rows, not {len(want)}"])


DOCS = "doc_id long, text string, lang string, source string"


def test_classify_of_prose_with_a_type_word(spark, tmp_path):
    rows = [(k, t, "en", "a") for k, t in enumerate(["building 3D wing", "building a wing", "eau 3D\nx\nring 3D\n\n3D", "12 tion 3D", "und 2020 2021 and 2022"])]
    assert differences(spark, tmp_path, "classify", "documents", rows, DOCS) == []


HEADLESS = [(k, t, "en", "a") for k, t in enumerate(["", "\nthe 12 ing", " \n12 eau", "\n\n\nand the que 3", "x the and ing eau\nand the eau ing 2020"])]


@pytest.mark.parametrize("name", ["blocks_of_anchors", "classify", "figure_types", "optimised_figures", "sections", "figure_positions", "planned_figures"])
def test_reports_without_a_heading_have_no_sections(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, "documents", HEADLESS, DOCS) == []


def test_reports_without_a_heading_have_no_slots(spark, tmp_path):
    spark.createDataFrame(HEADLESS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in entry.queries()["figure_slots"](spark, str(tmp_path)).collect()] == [4]


def test_prompts_are_whole_texts(spark, tmp_path):
    rows = [(1, 0, "user", "draw a map"), (1, 1, "user", "draw a plan"), (2, 0, "user", "draw a map"), (2, 1, "bot", "draw a map")]
    assert differences(spark, tmp_path, "prompt_answers", "conversations", rows, "conv_id long, turn long, role string, text string") == []
    got = [(r.conv_id, r.turn, r.prompt, r.answer) for r in entry.queries()["prompt_answers"](spark, str(tmp_path)).collect()]
    want = [(1, 0, "user draw a map", 1), (1, 2, "user draw a plan", 1), (2, 0, "user draw a map", 1), (2, 2, "bot draw a map", 2)]
    assert sorted(got) == sorted((c, t + k, p, f"made for {a}") for c, t, p, a in want for k in (0, 1))


def test_runs_are_counted_once_a_paragraph(spark):
    runs = spark.range(3).select(F.lit(1).alias("doc_id"), F.lit(0).alias("para"), F.col("id").cast("int").alias("ord"), F.lit("the end").alias("text"))
    out = E.replaced(runs, {"e": "x", "xt": "-"})
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, k, "thx xnd", 6) for k in range(3)]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("+- Generate")[0]
    assert "aggregate(" not in above  # else each run goes over all runs of its paragraph


def test_replies_are_searched_and_parsed_once(spark):
    rows = [(1, 0, '```json\n{"figures": []}\n``` {"x": 1}', None), (1, 1, '{"a": 1} and {}', None), (1, 2, "x {1", None), (2, 0, '{"a": 1}, {"b": 2}', None), (2, 1, 'so {"a": 1}.', None), (2, 2, "{}", "429"), (3, 0, None, None), (3, 1, '```\n{]}\n``` {"x": 1}', None)]
    replies = spark.createDataFrame(rows, "doc_id long, run_id int, reply string, error string")
    got = R.failures(replies)
    assert sorted((r.doc_id, r.run_id, r.reason) for r in got.collect()) == [(1, 1, R.NO_OBJECT), (1, 2, R.NO_OBJECT), (2, 0, R.NO_OBJECT), (2, 2, "429"), (3, 0, R.NO_OBJECT), (3, 1, R.NO_OBJECT)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2


def test_small_streams_share_a_batch():
    record = (1 << 20 | 5).to_bytes(4, "little") + b"x"
    streams = pa.RecordBatch.from_pydict({"file": [*map(str, range(300)), "none", "empty"], "content": [record * 2] * 300 + [None, b""]})
    got = list(D.record_batches([streams, streams]))
    assert [b.num_rows for b in got] == [1200]
    assert got[0].slice(598, 4).to_pydict() == {"file": ["299", "299", "0", "0"], "ord": [0, 1, 0, 1], "offset": [0, 5, 0, 5], "tag": [5] * 4, "level": [0] * 4, "size": [1] * 4, "data": [b"x"] * 4}
    assert list(D.record_batches([])) == []


def test_items_of_a_vote_are_dealt_without_their_paths(spark):
    rows = [(1, r, p, s, t, 0.5, 0.25 * r, [s, f"x{r}"], "a") for r in range(3) for p, (s, t) in enumerate([("long > path", "photo"), ("other", None), (None, "photo")])] + [(2, 0, 0, "q", "t", 1.0, 1.0, None, "b")]
    voted = G.vote(spark.createDataFrame(rows, "doc_id long, run_id int, pos int, section_path string, figure_type string, confidence double, final_score double, suggested_content array<string>, anchor_text string"))
    got = sorted((r.doc_id, r.section_path, r.figure_type, r.vote_count, r.suggested_content, r.figure_id, r.vote_rank) for r in voted.collect())
    items = ["x0", "x1", "x2"]
    assert got == [(1, "", "photo", 3, [None, *items], "F3", 3), (1, "long > path", "photo", 3, ["long > path", *items], "F1", 1), (1, "other", "", 3, ["other", *items], "F2", 2), (2, "q", "t", 1, [], "F1", 1)]
    assert [c for c in voted.columns if c.startswith("_")] == []
    lines = voted._jdf.queryExecution().optimizedPlan().toString().splitlines()
    keys = [x.split("Aggregate [")[1].split("]")[0] for x in lines if "Aggregate [" in x and "item#" in x.split("]")[0]]
    assert keys and not any("section_path" in k for k in keys)


def test_markup_is_decoded_where_it_is_read(spark):
    xml = "<s><p><run charPrIDRef='1'><t>a</t></run><tbl><sz width='3'/><tr><tc><p><run charPrIDRef='2'><t>b</t></run></p><cellSz width='7'/></tc></tr></tbl></p></s>"
    rows = M.nested(M.tokens(spark.createDataFrame([(1, 0, xml), (2, 0, "<s>")], "doc_id long, section_index int, xml string")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = [(r.name, r.n_p, r.n_tc, r.in_tbl, r.has_table, r.direct, r.row) for r in rows.orderBy("at").collect() if r.starts]
    assert got == [("s", 0, 0, None, None, None, None), ("p", 0, 0, None, True, None, None), ("tbl", 1, 0, None, None, None, 1), ("tr", 1, 0, 7, None, True, 0), ("tc", 1, 0, 7, None, True, 0), ("p", 1, 1, 7, False, None, None)]


def shuffles(rows) -> tuple[int, str]:
    """How often the plan of `rows` shuffles where nothing is broadcast, and the plan."""
    session = rows.sparkSession
    held = session.conf.get("spark.sql.autoBroadcastJoinThreshold")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    return plan.count("Exchange hashpartitioning"), plan


def test_paragraphs_meet_styles_by_their_document(spark):
    paras = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "zz"), (2, 0, "a"), (3, 0, "0")], "doc_id long, ord int, char string")
    styles = spark.createDataFrame([(1, "0", 10), (1, "a", 20), (2, "b", 30)], "doc_id long, id string, size int")
    got = B.with_styles(paras, styles, "char", "char_")
    assert sorted((r.doc_id, r.ord, r.char_size) for r in got.collect() if r.char_size) == [(1, 0, 20), (1, 1, 10), (1, 2, 10)] and got.count() == 5
    assert shuffles(B.with_styles(got.withColumn("para", F.lit("b")), styles, "para", "para_"))[0] <= 3


def test_figures_meet_the_blocks_of_their_document_once(spark):
    blocks = spark.createDataFrame([(1, k, k // 7, f"line {k}") for k in range(30)], "doc_id long, ord int, section_index int, text string")
    figures = spark.createDataFrame([(1, 5, "line 20", "p"), (1, 2, "no such", "p"), (1, 9, "line 1", None), (2, 1, "line 1", "")], "doc_id long, pos int, anchor_text string, purpose string")
    figures = figures.withColumns({"figure_type": F.lit(""), "section_path": F.lit(""), "suggested_content": F.array().cast("array<string>")})
    out = P.figure_slots(figures, blocks)
    around = lambda k: "\n".join(f"line {i}" for i in range(max(0, k - 8), min(30, k + 9)))
    assert sorted((r.doc_id, r.id, r.block_ord, r.section_index, r.context) for r in out.collect()) == [(1, 0, 0, 0, around(0)), (1, 1, 20, 2, around(20)), (1, 2, 1, 0, around(1)), (2, 0, 0, 0, "")]
    n, plan = shuffles(out)
    assert n <= 2 and "Window" not in plan


def test_slots_are_found_in_one_shuffle_and_ordered_in_another(spark):
    blocks = [(1, k, "text", "x [mark]" if k in (3, 9) else f"line {k}") for k in range(12)] + [(2, k, "text", f"line {k}") for k in range(25)] + [(3, 0, "text", None)]
    blocks = spark.createDataFrame(blocks, "doc_id long, ord int, kind string, text string").withColumns({"section_index": F.floor(F.col("ord") / 7).cast("int"), "width": F.lit(0), "height": F.lit(0), "empty_large": F.lit(False)})
    words = dataclasses.replace(config.SlotWords(), marker="mark")
    found = P.find_slots(blocks, words)
    near = "\n".join(f"line {k}" for k in range(19))
    got = sorted((r.doc_id, r.id, r.block_ord, r.section_index, r.context.count("line"), r.context) for r in found.collect())
    assert [g[:5] for g in got] == [(1, 0, 3, 0, 10), (1, 1, 9, 1, 9), (2, 0, 0, 0, 19), (3, 0, 0, 0, 0)] and got[2][5] == near
    assert shuffles(found)[0] == 1
    slots = spark.createDataFrame([(1, 7, 3, "a"), (1, 2, 9, "b"), (1, 4, 3, "c"), (1, 5, 1, None), (2, 0, 0, "d")], "doc_id long, id int, block_ord int, image string")
    shown = P.in_visual_order(slots)
    assert sorted((r.doc_id, r.block_ord, r.image) for r in shown.collect()) == [(1, 3, "b"), (1, 3, "c"), (1, 9, "a"), (2, 0, "d")]
    assert shuffles(shown)[0] == 1


def test_cells_and_updates_are_dealt_by_table(spark):
    cells = spark.createDataFrame([(1, 0, 1, 0, 0, "a", "text"), (1, 0, 2, 0, 1, "b", "empty"), (1, 0, 3, None, 0, "c", "text"), (None, 0, 1, 0, 0, "d", "text")], "doc_id long, table_id int, ord int, r int, c int, text string, state string")
    updates = [(1, 1, "set", 0, 1, 0, "early"), (1, 2, "append", 0, None, None, None), (1, 3, "set", 0, 1, 0, "x"), (1, 4, "set", 0, 0, 0, "y"), (1, 5, "set", 0, 0, 0, None), (1, 6, "set", 0, None, 0, "z"), (1, 7, "set", 9, 0, 0, "z"), (1, 8, "set", 0, 0, 1, "z"), (None, 1, "set", 0, 0, 0, "z")]
    updates = spark.createDataFrame(updates, "doc_id long, pos int, op string, table_id int, r int, c int, text string").withColumn("values", F.array(F.lit("v")))
    out, bad = E.updated_cells(cells, updates)
    got = sorted((r.doc_id is None, r.ord, r.r, r.c, r.text) for r in out.collect() if r.r is not None)
    assert got == [(False, 1, 0, 0, None), (False, 2, 0, 1, "b"), (False, 4, 1, 0, "x"), (False, 5, 1, 1, "b"), (True, 1, 0, 0, "d")] and out.count() == 6
    assert sorted((r.doc_id is None, r.pos, r.reason) for r in bad.collect()) == [(False, 1, "no such cell"), (False, 6, "no such cell"), (False, 7, "no such table"), (True, 1, "no such table")]
    assert shuffles(out)[0] <= 6


def test_controls_are_checked_in_one_pass(spark):
    head, more = config.CTRL_HEADER, config.CTRL_DATA
    rows = [("f", "BodyText/Section0", k, t, lv, bytearray(d)) for k, (t, lv, d) in enumerate([(head, 0, b"zzzz"), (head, 0, b"abc"), (head, 1, b"qqqq"), (more, 1, b""), (head, None, b"revt")])]
    found = S.control_checks(spark.createDataFrame(rows, "file string, stream string, ord int, tag int, level int, data binary"))
    assert sorted((r.offset, r.severity, r.detail) for r in found.collect()) == [(0, "ERROR", "no data"), (0, "ERROR", "unknown"), (15, "ERROR", "unknown"), (27, "WARN", config.CONTROL_NAMES["revt"])]
    n, plan = shuffles(found)
    assert n == 1 and "Union" not in plan


def test_islands_are_cut_from_the_array_of_a_document(spark):
    rows = [(1, 1, "a", "x", 3.0, ["p", "q"], 40), (1, 2, "a", "x", 5.0, ["q", "r"], 10), (1, 3, None, "x", 1.0, None, 5), (1, 4, None, "x", 1.0, ["s"], 7), (1, 5, "a", "x", 0.5, ["t"], None), (None, 1, "b", "y", 2.0, [], 1)]
    ranked = spark.createDataFrame(rows, "doc_id long, rank int, section_path string, figure_type string, final_score double, suggested_content array<string>, char_start int")
    out = G.merge_islands(ranked)
    got = sorted((r.doc_id is None, r.island, r.section_path, r.final_score, r.merged, r.suggested_content, r.char_start, r["rank"]) for r in out.collect())
    assert got == [(False, 1, "a", 5.0, 2, ["p", "q", "r"], 40, 1), (False, 2, None, 1.0, 2, ["s"], 5, 3), (False, 3, "a", 0.5, 1, ["t"], None, 5), (True, 1, "b", 2.0, 1, [], 1, 1)]
    assert "Window" not in shuffles(out)[1] and "suggested_content" not in G.merge_islands(ranked.drop("suggested_content")).columns


def test_figures_meet_the_reply_of_their_critic_in_one_row(spark):
    figures = spark.createDataFrame([(1, "F1", "a", 1), (1, "F2", None, 2), (1, None, "c", 3), (2, "F1", "a", 1), (3, "F1", "a", 1), (None, "F1", "a", 1)], "doc_id long, figure_id string, figure_type string, rank int")
    text = '{"reviewed": [{"figure_id": "F1", "approved": false}, {"approved": false}, 7, {"figure_id": "F2", "suggest_alternative_type": "x"}, {"figure_id": "F1", "suggest_alternative_type": "null"}], "add_missing": [{}, 7, {"purpose": "p", "confidence": 0.25}]}'
    replies = spark.createDataFrame([(1, text, None), (2, '{"reviewed": [{"figure_id": "F1", "approved": false}]}', None), (3, text, "503"), (4, text, None), (None, text, None)], "doc_id long, reply string, error string")
    out = R.reviewed(figures, replies)
    got = sorted(((r.doc_id or 0, r.figure_id or "", r.figure_type, r["rank"], r.purpose, r.confidence, r.vote_count, r.t6) for r in out.collect()), key=repr)
    none = (None,) * 4
    want = [(0, "F1", "a", 1, *none), (1, "", "c", 3, *none), (1, "F1", "a", 1, *none), (1, "F2", "x", 2, *none), (1, "F4", "concept_diagram", None, "", 0.5, 1, 0.0), (1, "F5", "concept_diagram", None, "p", 0.25, 1, 0.0), (3, "F1", "a", 1, *none)]
    assert got == sorted(want, key=repr)
    missing = spark.createDataFrame([], "doc_id long, pos int, section_path string, anchor_text string, figure_type string, purpose string, confidence double")
    assert out.schema.simpleString() == G.add_missing(figures, figures, missing).schema.simpleString()
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()  # small replies may hold many rows


def test_runs_of_a_report_are_made_and_read_in_its_row(spark):
    trigger = ", ".join(f"t{k} double" for k in range(1, 7))
    rows = [(d, o, f"S{o}", f"S{o}", f"text {o}", *(0.0,) * 5, 0.9) for d in (1, 2) for o in range(9)]
    candidates = spark.createDataFrame(rows, f"doc_id long, ord int, section_path string, title string, text string, {trigger}")
    replies = R.rule_replies(candidates, spark.createDataFrame([(1, 100_000), (2, 1400), (3, 5000)], "doc_id long, total_chars int"))
    n, plan = shuffles(replies)
    assert n == 2 and "Window" not in plan
    n, plan = shuffles(R.runs(spark.createDataFrame([(1, "x"), (2, None), (4, "y")], "doc_id long, md string"), replies))
    assert n <= 3 and "FileScan" not in plan and "Window" not in plan  # neither written nor dealt again


def test_candidates_are_scored_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    scored = N.scores(N.features(N.split_sections(spark.createDataFrame([(1, "1. a\n2. b 대비 1 위치 위치")], "doc_id long, md string"))))
    assert plan(N.candidates(scored)).count("regexp_count(") == plan(scored).count("regexp_count(")
    assert [r.section_id for r in N.candidates(scored).collect()] == ["S1"] and N.candidates(scored).columns == scored.columns


def test_figures_meet_sections_and_report_in_one_row(spark):
    md = ["1. a map\n지도 x\n가. b plan\n 평면 배치 \n1. a map\n- last\n", "x\n\n", None, "no heading 투시", "# 3D\n# b\n2. "]
    reports = spark.createDataFrame([*enumerate(md), (None, "1. null")], "doc_id long, md string")
    sections = N.split_sections(reports, paths=True)
    paths = ["a map", "a map > b plan", "z > b plan", "", None, "a map > last", config.WHOLE_TITLE, "3D", "none"]
    anchors = ["지도 x", "no such anchor at all", "", None, "평면 배치 \n1. a map", "no heading 투시"]
    rows = [(d, p, path, kind, anchors[(p + d) % 6], ["k", None], *(0.0,) * 2, 0.5 if p % 2 else 0.0, *(0.25,) * 3) for d in range(6) for p, (path, kind) in enumerate((x, k) for x in paths for k in ("", None, "photo"))]
    figures = spark.createDataFrame(rows, "doc_id long, pos int, section_path string, figure_type string, anchor_text string, suggested_content array<string>, " + ", ".join(f"{t} double" for t in N.TRIGGERS))
    out = Q.met(figures, reports, sections)
    want = G.place(G.in_report(Q.classify(figures, sections), reports), sections)
    assert out.columns == [*figures.columns, "total_chars", "here", "anchored", "char_start", "char_end"]
    key = lambda df: sorted(map(repr, df.select(sorted(out.columns)).collect()))
    assert key(out) == key(want) and out.count() == len(rows) and out.filter("figure_type = 'floor_plan'").count() > 0
    assert shuffles(out)[0] <= 3 < shuffles(want)[0]
    voted = figures.withColumns({"figure_id": F.concat(F.lit("F"), "pos"), "vote_rank": F.col("pos"), "final_score": F.col("pos") / 100, "confidence": F.lit(0.75), "purpose": F.col("section_path")})
    n, plan = shuffles(Q.final_figures(reports, sections, voted))
    assert n <= 3 and "FileScan" not in plan


def test_few_figures_are_compared_in_one_row(spark):
    words = ["a b c", "c b a", "a b c d", "a b", "", None, " ", "x", "x y", "x y z", "a b c"]
    rows = [(d, p, words[(p * (d + 1)) % len(words)]) for d in range(5) for p in range(9)]
    figures = spark.createDataFrame(rows, "doc_id long, pos int, purpose string")
    out = G.drop_similar_few(figures)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, G.drop_similar(figures).collect()))
    assert shuffles(out)[0] == 1
