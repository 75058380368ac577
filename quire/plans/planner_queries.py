"""Queries from planner calls to the finished plan.

The rule planner is asked three times about each report; some calls fail, some replies hold no JSON, and of some reports all do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import config
from quire.functions import payloads as L
from quire.operators import plan as P
from quire.operators import planner as R
from quire.operators import sections as S
from quire.plans.base import _query, _read
from quire.plans.plan_queries import _DOM, _FINAL, _PATHS, _PROPOSED, WORDS, _sections
from quire.plans.views import _reports, _scored


def _replies(reports: DataFrame, sections: DataFrame) -> DataFrame:
    totals = reports.select("doc_id", F.length("md").alias("total_chars"))
    d, r = F.col("doc_id"), F.col("run_id")
    rows = R.rule_replies(S.candidates(sections), totals, words=WORDS)
    rows = rows.withColumn("error", F.when((d + r) % 7 == 0, F.when(r == 1, "429 RESOURCE_EXHAUSTED").otherwise("503 UNAVAILABLE")))
    broken = F.when(d % 11 == 5, F.concat(F.lit("Here: {"), r.cast("string"))).when(d % 11 == 6, F.replace("reply", F.lit("\n```"), F.lit("} and {}\n```"))).when(d % 11 == 7, F.replace(F.replace("reply", F.lit("```json"), F.lit("")), F.lit("```"), F.lit(".")))
    return rows.withColumn("reply", F.coalesce(broken, "reply"))


_kind = "CASE {dom} WHEN 'T6' THEN 'cover_banner' WHEN 'T3' THEN CASE WHEN {maps} THEN 'map_layout' WHEN {plans} THEN 'floor_plan' WHEN {views} THEN 'rendering' ELSE 'map_layout' END WHEN 'T4' THEN CASE WHEN {dates} >= 3 THEN 'roadmap' ELSE 'flow_chart' END WHEN 'T2' THEN CASE WHEN {numbers} >= 5 THEN 'bar_chart' ELSE 'comparison_table' END WHEN 'T5' THEN CASE WHEN {trends} THEN 'line_chart' ELSE 'photo' END ELSE 'concept_diagram' END".format(
    dom=f"({_DOM.replace('t.t', 't')})", **{k: f"regexp_matches(text, '{getattr(WORDS, k)}')" for k in ("maps", "plans", "views", "trends")}, **{k: f"len(regexp_extract_all(text, '(?i){getattr(WORDS, k)}'))" for k in ("dates", "numbers")},
)
_CALLS = """, calls AS (SELECT doc_id, r AS run_id, length(md) AS total_chars, CASE WHEN (doc_id + r) % 7 = 0 THEN CASE WHEN r = 1 THEN '429 RESOURCE_EXHAUSTED' ELSE '503 UNAVAILABLE' END WHEN doc_id % 11 IN (5, 6) THEN 'no JSON object in the reply' END AS reason FROM reports, (VALUES (0), (1), (2)) v(r)),
nr AS (SELECT doc_id, count(*) AS n FROM calls WHERE reason IS NULL GROUP BY doc_id)"""
_RUNS = _CALLS + f""", cand AS (SELECT *, greatest(t1, t2, t3, t4, t5, t6) AS best, {_kind} AS kind FROM sp WHERE greatest(t1, t2, t3, t4, t5, t6) >= 0.4),
asked AS (SELECT cand.*, run_id, total_chars, CAST('0x' || substr(md5('1:' || doc_id || ':' || run_id || ':' || ord), 1, 3) AS BIGINT) / 4096 AS load FROM cand JOIN calls USING (doc_id) WHERE reason IS NULL),
rated AS (SELECT *, best * 0.4e0 + load * 0.6e0 AS fs FROM asked), strong AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run_id ORDER BY fs DESC, ord) AS rank FROM rated WHERE fs >= 0.5e0),
runs AS (SELECT doc_id, run_id, rank - 1 AS pos, run_id * CAST(1000000000 AS BIGINT) + rank - 1 AS k, section_path, kind AS figure_type, substr(text, 1, 24) AS anchor_text, load / 2 + 0.5e0 AS confidence, fs AS final_score, title AS purpose, [title, kind] AS content,
  {{'t1': t1, 't2': t2, 't3': t3, 't4': t4, 't5': t5, 't6': t6}} AS t FROM strong WHERE rank <= greatest(1, least(total_chars // 1500, 8)))"""
_OLD_NR = "nr AS (SELECT doc_id, count(DISTINCT run_id) AS n FROM runs GROUP BY doc_id),\n"
_PLANNED = _FINAL.replace(_PROPOSED[len(_PATHS) :], _RUNS).replace(_OLD_NR, "").replace("ORDER BY final_score DESC", "ORDER BY round(final_score, 9) DESC")
assert _OLD_NR in _FINAL and "calls AS" in _PLANNED


@_query(f"WITH {_PLANNED} SELECT doc_id, 'F' || r AS figure_id, section_path, figure_type, purpose, vote_count, round(confidence, 6) AS confidence, round(final_score, 6) AS final_score, array_to_string(content, ',') AS content FROM final")
def planned_figures(spark, sf_dir):
    reports, sections = _reports(spark, sf_dir), _scored(spark, sf_dir, paths=True)
    f = P.final_figures(reports, sections, R.voted(reports, _replies(reports, sections)), WORDS)
    return f.select("doc_id", "figure_id", "section_path", "figure_type", "purpose", "vote_count", F.round("confidence", 6).alias("confidence"), F.round("final_score", 6).alias("final_score"), F.array_join("suggested_content", ",").alias("content"))


@_query(f"""WITH {_PATHS}{_CALLS}, bad AS (SELECT doc_id, string_agg('run ' || run_id || ': ' || reason, '; ' ORDER BY run_id) AS errors FROM calls WHERE reason IS NOT NULL GROUP BY doc_id),
good AS (SELECT doc_id, run_id, total_chars FROM calls WHERE reason IS NULL UNION ALL SELECT DISTINCT doc_id, 0, total_chars FROM calls WHERE doc_id NOT IN (SELECT doc_id FROM nr))
SELECT doc_id, CAST(run_id AS INTEGER) AS run_id, CAST(total_chars AS INTEGER) AS total_chars, CAST(least(total_chars // 1500, 8) AS INTEGER) AS baseline_count, CASE WHEN run_id = min(run_id) OVER (PARTITION BY doc_id) THEN errors END AS errors FROM good LEFT JOIN bad USING (doc_id)""")
def planner_runs(spark, sf_dir):
    reports, sections = _reports(spark, sf_dir), _scored(spark, sf_dir, paths=True)
    found = R.runs(reports, _replies(reports, sections))
    return found.select("doc_id", "run_id", *[F.try_variant_get("result", f"$.{c}", "int").alias(c) for c in ("total_chars", "baseline_count")], F.array_join("errors", "; ").alias("errors"))


@_query(f"WITH {_PATHS}{_CALLS} SELECT doc_id, CAST(run_id AS INTEGER) AS run_id, 'plan' AS stage, reason, NOT starts_with(reason, 'no') AS transient, starts_with(reason, '429') AS quota FROM calls WHERE reason IS NOT NULL")
def planner_failures(spark, sf_dir):
    reports, sections = _reports(spark, sf_dir), _scored(spark, sf_dir, paths=True)
    return R.failures(_replies(reports, sections))


@_query(f"""WITH {_PATHS}, c AS (SELECT doc_id, string_agg(chr(10) || '--- Section: ' || section_path || ' (depth=' || depth || ') ---' || chr(10) || 'Trigger scores: {{''T1'': ' || round(t1, 3) || ', ''T2'': ' || round(t2, 3) || ', ''T3'': ' || round(t3, 3) || ', ''T4'': ' || round(t4, 3) || ', ''T5'': ' || round(t5, 3) || ', ''T6'': ' || round(t6, 3) || '}}' || chr(10)
  || 'Text: ' || substr(text, 1, 500) || chr(10), '' ORDER BY ord) AS context FROM sp WHERE greatest(t1, t2, t3, t4, t5, t6) >= 0.4 GROUP BY doc_id)
SELECT doc_id, sha256('Plan at most 8 figures. ' || substr(md || chr(10) || chr(10) || '[Candidate Sections]' || chr(10) || coalesce(context, ''), 1, 12000) || chr(10) || chr(10) || 'Example.') AS prompt_sha256 FROM reports LEFT JOIN c USING (doc_id)""")
def planner_prompts(spark, sf_dir):
    context = P.candidate_context(S.candidates(_sections(spark, sf_dir)))
    return R.prompts(_reports(spark, sf_dir), context, "Plan at most {{MAX_FIGURES}} figures. {{REPORT_TEXT}}", "Example.").select("doc_id", F.sha2("prompt", 256).alias("prompt_sha256"))


# Line items are voted figures of an order, each reviewed by one turn of a critic; of some orders the critic's call failed.
@_query("""WITH li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), o AS (SELECT *, doc_id % 5 = 0 AS failed FROM li),
kept AS (SELECT doc_id, 'F' || n AS figure_id, 's' || p % 3 AS section_path, CASE WHEN NOT failed AND p % 4 = 2 THEN 'photo' ELSE 'map_layout' END AS figure_type, p % 8 / 8 AS confidence, NULL AS position_hint, NULL AS cognitive_load FROM o WHERE failed OR p % 4 <> 1),
c AS (SELECT doc_id, count(*) AS n, max(failed) AS failed FROM o GROUP BY doc_id)
SELECT * FROM kept UNION ALL SELECT doc_id, 'F' || (n + k), CASE k WHEN 1 THEN 'new' ELSE '' END, CASE k WHEN 1 THEN 'roadmap' ELSE 'concept_diagram' END, CASE k WHEN 1 THEN 0.75e0 ELSE 0.5e0 END, 'after', 0.6e0 FROM c, (VALUES (1), (2)) v(k) WHERE NOT failed AND doc_id % 3 = 0""")
def critic_replies(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    p, doc = F.col("p"), F.col("doc_id")
    figures = li.select("doc_id", F.concat(F.lit("F"), "n").alias("figure_id"), F.concat(F.lit("s"), p % 3).alias("section_path"), F.lit("map_layout").alias("figure_type"), (p % 8 / 8).alias("confidence"), F.lit(None).cast("string").alias("position_hint"), F.lit(None).cast("double").alias("cognitive_load"))
    # a review of every figure but some, a second one of one kind that takes the first back, an entry without an id
    one = F.struct(F.concat(F.lit("F"), "n").alias("figure_id"), F.when(p % 4 != 0, p % 4 != 1).alias("approved"), F.when(p % 4 == 2, "photo").when(p % 4 == 3, "null").alias("suggest_alternative_type"))
    two = F.struct(F.concat(F.lit("F"), "n").alias("figure_id"), (F.lit(1) == 1).alias("approved"), F.lit(None).cast("string").alias("suggest_alternative_type"))
    each = F.when(p % 4 == 3, F.array(F.struct(one["figure_id"].alias("figure_id"), (F.lit(1) == 0).alias("approved"), one["suggest_alternative_type"].alias("suggest_alternative_type")), two)).otherwise(F.array(one))
    replies = li.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", each.alias("e")))), lambda x: x["e"])).alias("reviewed"))
    added = F.when(doc % 3 == 0, F.lit(', "add_missing": [{"section_path": "new", "figure_type": "roadmap", "confidence": 0.75}, {}, 7]')).otherwise("")
    text = F.concat(F.lit('Reviewed: {"reviewed": '), F.to_json("reviewed"), added, F.lit("}"))
    replies = replies.select("doc_id", F.when(doc % 10 == 0, "no answer {").otherwise(text).alias("reply"), F.when(doc % 10 == 5, "500 INTERNAL").alias("error"))
    return R.reviewed(figures, replies).select("doc_id", "figure_id", "section_path", "figure_type", "confidence", "position_hint", "cognitive_load")


# Pages as payloads of a renderer: lists of strings, objects with other names, wrong types, broken JSON, whole documents.
_SHAPES = 9


@_query(r"""WITH p AS (SELECT page_id, page_id % 9 AS k, replace(url, '"', '') AS u FROM pages),
x AS (SELECT page_id, 1 AS page_number, 'QUJD' || page_id AS image, NULL AS url, 0 AS width, 0 AS height, '' AS text FROM p WHERE k = 0
UNION ALL SELECT page_id, 2, 'REVG', NULL, 0, 0, '' FROM p WHERE k = 0
UNION ALL SELECT page_id, 1, 'QUJD', NULL, 640, 480, u FROM p WHERE k = 1
UNION ALL SELECT page_id, 2, NULL, 'https://a.b/c.png', 12, 0, '' FROM p WHERE k = 2
UNION ALL SELECT page_id, 4, 'Rg==', NULL, 7, 0, '' FROM p WHERE k = 3)
SELECT page_id, page_number, image, url, width, height, text, NULL AS document, NULL AS reason FROM x
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k = 7 THEN 'JVBERi0=' END, CASE k WHEN 4 THEN 'no page' WHEN 5 THEN 'no JSON object' WHEN 6 THEN 'no JSON object' WHEN 8 THEN 'no payload' END FROM p WHERE k >= 4""")
def page_payloads(spark, sf_dir):
    k, url = F.col("page_id") % _SHAPES, F.replace("url", F.lit('"'), F.lit(""))
    payload = (
        F.when(k == 0, F.concat(F.lit('{"pages": ["QUJD'), F.col("page_id").cast("string"), F.lit('", "data:image/png;base64,REVG", "", "x", "y"]}')))
        .when(k == 1, F.concat(F.lit('{"pages": [], "page_images": [{"base64": "QUJD", "image": "no", "width": "640", "height": 480.9, "text": "'), url, F.lit('"}]}')))
        .when(k == 2, '{"images": [{"text": "no image"}, {"image_base64": "", "image_url": "https://a.b/c.png", "width": 12, "height": "high", "text": null}]}')
        .when(k == 3, '{"pages": [1, null, [], {"image_base64": 5, "image": "data:image/gif;base64,Rg==", "width": 7}, {"image": "cut"}]}')
        .when(k == 4, '{"pages": {"image": "QUJD"}, "images": "QUJD"}').when(k == 5, '{"pages": ["QUJD"').when(k == 6, '["QUJD"]').when(k == 7, '{"images": [{}], "pdf": "data:application/pdf;base64,JVBERi0="}')
    )
    rows = _read(spark, sf_dir, "pages").select("page_id", payload.alias("payload")).withColumn("v", L.parse(F.col("payload")))
    limit = F.when(k == 0, 2).otherwise(4)
    rows = rows.select("page_id", L.pages(F.col("v"), 4).alias("pages"), L.document(F.col("v")).alias("document"), L.reason(F.col("payload"), F.col("v")).alias("reason"), limit.alias("most"))
    found = rows.withColumn("pages", F.filter("pages", lambda p: p["page_number"] <= F.col("most")))
    alone = F.size("pages") == 0
    return found.select("page_id", F.explode_outer("pages").alias("p"), F.when(alone, F.col("document")).alias("document"), "reason").select("page_id", "p.*", "document", "reason")


# Turns as pages of a report.
@_query("""WITH p AS (SELECT conv_id AS doc_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations) SELECT doc_id, string_agg('[Page ' || turn || ' text]' || chr(10) || substr(s, 1, 1800), chr(10) || chr(10) ORDER BY turn) AS text FROM p WHERE s <> '' GROUP BY doc_id""")
def page_texts(spark, sf_dir):
    return R.page_texts(_read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"))
