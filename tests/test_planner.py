"""Calls of planner and critic: failures as rows, tolerant replies, seeded runs; payloads of unsure shape."""

import json

from pyspark.sql import functions as F

from quire.functions import payloads as L
from quire.functions import text as T
from quire.operators import plan as P
from quire.operators import planner as R

REPLIES = "doc_id long, run_id int, reply string, error string"


def test_json_object_is_strict(spark):
    cases = [
        ('{"a": 1}', True), ('x {"a": 1} y', True), ('{"a": 1} and {"b": 2}', False), ("{bad}", False), ('```json\n{"a": {"b": 1}}\n```', True), ('```\n{bad}\n``` {"a": 1}', False), ("none", False), (None, False),
        ('{"a": 1}}', False), ('{"a": 1}] {"b": 1}', False), ('{"a": 1}, {"b": 1}', False), ('{"a": 1}, "b": {}', False), ("{}", True),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", T.json_object(F.col("c")).alias("j")).collect()
    for r in got:
        assert (r.j is not None) == cases[r.i][1], cases[r.i]
        assert r.j is None or isinstance(json.loads(r.j), dict)


def test_failed_runs_are_rows(spark):
    reports = spark.createDataFrame([(1, "x" * 3100), (2, "y"), (3, None), (4, "z")], "doc_id long, md string")
    fig = '{"figures": [{"section_path": "A", "figure_type": "photo", "confidence": "0.5", "suggested_content": ["a", 1, null], "trigger_scores": {"T2": 0.5}}, 7, {"confidence": "high"}]}'
    replies = spark.createDataFrame([(1, 0, None, "503 UNAVAILABLE"), (1, 1, fig, None), (1, 2, '{"figures": "none"}', None), (2, 0, "no", None), (2, 1, None, "429"), (4, 0, "{}", None), (9, 0, "{}", None), (1, 3, None, None)], REPLIES)
    bad = {(r.doc_id, r.run_id, r.reason, r.transient, r.quota) for r in R.failures(replies).collect()}
    assert bad == {(1, 0, "503 UNAVAILABLE", True, False), (2, 0, R.NO_OBJECT, False, False), (2, 1, "429", True, True), (1, 3, R.NO_OBJECT, False, False)}
    runs = R.runs(reports, replies)
    got = {(r.doc_id, r.run_id): (r.errors, json.loads(r.result.toJson())) for r in runs.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 0), (3, 0), (4, 0)}
    assert got[1, 1][0] == ["run 0: 503 UNAVAILABLE", f"run 3: {R.NO_OBJECT}"] and got[1, 2][0] is None and got[4, 0] == (None, {})
    assert got[2, 0] == ([f"run 0: {R.NO_OBJECT}", "run 1: 429"], {"report_summary": "", "total_chars": 1, "baseline_count": 0, "total_figures": 0, "figures": []})
    figures = sorted(R.run_figures(runs).collect(), key=lambda r: r.pos)
    assert [(r.doc_id, r.run_id, r.pos, r.section_path, r.figure_type, r.confidence, r.suggested_content, r.t1, r.t2) for r in figures] == [(1, 1, 0, "A", "photo", 0.5, ["a", "1"], 0.0, 0.5), (1, 1, 1, "", "", None, [], 0.0, 0.0)]
    facts = {r.doc_id: r.meta.planner_errors for r in P.run_facts(runs).collect()}
    assert facts == {1: got[1, 1][0], 2: got[2, 0][0], 3: [], 4: []}
    assert R.voted(reports, replies).count() == 0  # one of two successful runs is no majority


def test_failed_review_approves_all(spark):
    figures = spark.createDataFrame([(d, f"F{k}", "photo") for d in (1, 2, 3) for k in (1, 2)], "doc_id long, figure_id string, figure_type string")
    good = '{"reviewed": [{"figure_id": "F1", "approved": false}, {"figure_id": "F2", "suggest_alternative_type": "roadmap"}, 3], "add_missing": [{"purpose": "more"}]}'
    replies = spark.createDataFrame([(1, 0, good, None), (2, 0, good, "500 INTERNAL"), (4, 0, good, None)], REPLIES)
    got = {(r.doc_id, r.figure_id, r.figure_type, r.purpose, r.position_hint) for r in R.reviewed(figures, replies).collect()}
    same = {(d, f"F{k}", "photo", None, None) for d in (2, 3) for k in (1, 2)}
    assert got == same | {(1, "F2", "roadmap", None, None), (1, "F3", "concept_diagram", "more", "after")}


def test_rule_runs_are_seeded(spark):
    trigger = ", ".join(f"t{k} double" for k in range(1, 7))
    rows = [(d, o, f"S{o}", f"S{o}", f"text {o}", *(0.0,) * 5, 0.9 if o else 0.45) for d in (1, 2) for o in range(9)]
    candidates = spark.createDataFrame(rows, f"doc_id long, ord int, section_path string, title string, text string, {trigger}")
    totals = spark.createDataFrame([(1, 100_000), (2, 1400), (3, 5000)], "doc_id long, total_chars int")
    one, two, other = ({(r.doc_id, r.run_id): r.reply for r in R.rule_replies(candidates, totals, seed=s).collect()} for s in (1, 1, 2))
    assert one == two != other and len(one) == 9 and len({v for (d, _), v in one.items() if d == 1}) == 3
    for (d, _), reply in one.items():
        got = json.loads(reply.strip("`json\n"))
        assert len(got["figures"]) <= {1: 8, 2: 1, 3: 0}[d] and [f["rank"] for f in got["figures"]] == [*range(1, len(got["figures"]) + 1)]
        for f in got["figures"]:
            assert abs(f["final_score"] - 0.4 * max(f["trigger_scores"].values()) - 0.6 * f["cognitive_load"]) < 1e-9 and f["final_score"] >= 0.5


def test_payload_shapes(spark):
    cases = [
        ('{"pages": ["QQ=="]}', [(1, "QQ==", None, 0)], None, None), ('{"images": [{"image": "", "base64": "Qg==", "width": 3.9}, "data:image/png;base64,Qw=="]}', [(1, "Qg==", None, 3), (2, "Qw==", None, 0)], None, None),
        ('{"pages": "QQ=="}', [], None, "no page"), ('{"pages": [[1], 2, null, true]}', [], None, "no page"), ("[1]", [], None, "no JSON object"), ("{", [], None, "no JSON object"), (None, [], None, "no payload"), ("", [], None, "no JSON object"),
        ('{"pdf": "data:x;base64,UA=="}', [], "UA==", None), ('{"pages": [{"image_url": "http://a/b"}]}', [(1, None, "http://a/b", 0)], None, None), ('{"pages": ["A", "B", "C"]}', [(1, "A", None, 0), (2, "B", None, 0)], None, None),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, p string").withColumn("v", L.parse(F.col("p")))
    for r in rows.select("i", L.pages(F.col("v"), 2).alias("pages"), L.document(F.col("v")).alias("d"), L.reason(F.col("p"), F.col("v")).alias("why")).collect():
        _, pages, document, why = cases[r.i]
        assert ([(p.page_number, p.image, p.url, p.width) for p in r.pages or []], r.d, r.why) == (pages, document, why), cases[r.i]


def test_prompts_cut_report_and_context_together(spark):
    reports = spark.createDataFrame([(1, "r" * 50), (2, None)], "doc_id long, md string")
    contexts = spark.createDataFrame([(1, "ctx")], "doc_id long, context string")
    got = {r.doc_id: r.prompt for r in R.prompts(reports, contexts, "<{{REPORT_TEXT}}|{{MAX_FIGURES}}>", "e.g.", 4, 60).collect()}
    assert got == {1: f"<{'r' * 50}\n\n[Candida|4>\n\ne.g.", 2: "<\n\n[Candidate Sections]\n|4>\n\ne.g."}
