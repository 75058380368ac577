"""Queries from sections to final figures.

Three planner runs are derived from the scored sections of each report: a run leaves out every third section, some figures
lack a type, and every fifth section has an anchor that the report doesn't hold. Scores are fractions of powers of two, so that
their means are equal in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import config
from quire.operators import figures as G
from quire.operators import plan as P
from quire.operators import sections as S
from quire.plans.base import _query, _read
from quire.plans.views import _SCORES, _reports, _scored
from quire.sources.tables import written

#: Words that occur in the invented prose.
WORDS = config.TypeWords(maps="ingb", plans="enbe", views="eaux", dates=r"\d|th", numbers=r"\d|en", trends="ou")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_scored(spark, sf_dir, paths=True))  # several branches read them


# What several branches read of sections beside their texts: of these only the start, for anchors.
def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir, paths=True)
    return written(rows.select("doc_id", "ord", "title", "section_path", "char_start", "char_end", F.substring("text", 1, 24).alias("text"), *S.TRIGGERS))


def _proposed(sections: DataFrame) -> DataFrame:
    run, i, d = F.explode(F.array(*map(F.lit, range(3)))), F.col("ord"), F.col("doc_id")
    rows = sections.withColumn("run_id", run).filter((d + i + F.col("run_id")) % 3 != 0)
    r = F.col("run_id")
    return rows.select(
        "doc_id", "run_id", i.alias("pos"), "section_path", F.element_at(F.array(*map(F.lit, ("", "photo", "flow_chart", ""))), (i % 4 + 1).cast("int")).alias("figure_type"),
        F.when(i % 5 != 0, F.substring("text", 1, 24)).otherwise("zz zz zz zz zz").alias("anchor_text"), ((i * 7 + r * 3 + d) % 8 / 8).alias("confidence"), ((i * 13 + r * 5 + d) % 128 / 128).alias("final_score"),
        F.col("title").alias("purpose"), F.array("title", F.concat(F.lit("x"), i % 3)).alias("suggested_content"), *S.TRIGGERS,
    )


_PATHS = _SCORES + """, ll AS (SELECT doc_id, list({'d': depth, 't': title, 's': CAST([] AS VARCHAR[])} ORDER BY ord) AS l FROM sections GROUP BY doc_id),
rr AS (SELECT s.doc_id, s.section_id, s.title, s.depth, list_reduce(list_prepend({'d': 0, 't': '', 's': CAST([] AS VARCHAR[])}, l[1:s.ord]), lambda a, x: {'d': x.d, 't': x.t, 's': list_append(a.s[1:greatest(x.d - 1, 0)], x.t)}).s AS st FROM sections s JOIN ll USING (doc_id)),
pp AS (SELECT doc_id, section_id, array_to_string(st[1:greatest(depth - 1, 0)], ' > ') AS parent_path FROM rr),
sp AS (SELECT scored.*, CASE WHEN parent_path = '' THEN title ELSE parent_path || ' > ' || title END AS section_path FROM scored JOIN pp USING (doc_id, section_id))"""
_PROPOSED = _PATHS + """, runs AS (SELECT doc_id, r AS run_id, ord AS pos, r * CAST(1000000000 AS BIGINT) + ord AS k, section_path, ['', 'photo', 'flow_chart', ''][ord % 4 + 1] AS figure_type, CASE WHEN ord % 5 <> 0 THEN substr(text, 1, 24) ELSE 'zz zz zz zz zz' END AS anchor_text,
  (ord * 7 + r * 3 + doc_id) % 8 / 8 AS confidence, (ord * 13 + r * 5 + doc_id) % 128 / 128 AS final_score, title AS purpose, [title, 'x' || (ord % 3)] AS content, {'t1': t1, 't2': t2, 't3': t3, 't4': t4, 't5': t5, 't6': t6} AS t FROM sp, (VALUES (0), (1), (2)) v(r) WHERE (doc_id + ord + r) % 3 <> 0)"""
_ELECTED = _PROPOSED + """, parts AS (SELECT doc_id, section_path, figure_type, x, min(k * 4 + i) AS f FROM (SELECT *, unnest(content) AS x, generate_subscripts(content, 1) AS i FROM runs) GROUP BY ALL),
contents AS (SELECT doc_id, section_path, figure_type, list(x ORDER BY f)[1:8] AS content FROM parts GROUP BY ALL),
g AS (SELECT doc_id, section_path, figure_type, count(*) AS vote_count, avg(confidence) AS confidence, avg(final_score) AS final_score, min(k) AS f, arg_min(anchor_text, k) AS anchor_text, arg_min(purpose, k) AS purpose, arg_min(t, k) AS t FROM runs GROUP BY ALL),
nr AS (SELECT doc_id, count(DISTINCT run_id) AS n FROM runs GROUP BY doc_id),
voted AS (SELECT g.*, content, row_number() OVER (PARTITION BY doc_id ORDER BY final_score DESC, f) AS vote_rank FROM g JOIN nr USING (doc_id) JOIN contents USING (doc_id, section_path, figure_type) WHERE vote_count >= n // 2 + 1)"""
_DOM = "CASE greatest(t.t1, t.t2, t.t3, t.t4, t.t5, t.t6) WHEN t.t1 THEN 'T1' WHEN t.t2 THEN 'T2' WHEN t.t3 THEN 'T3' WHEN t.t4 THEN 'T4' WHEN t.t5 THEN 'T5' ELSE 'T6' END"
_has = "regexp_matches(full_text, '{}')".format
_n = "len(regexp_extract_all(full_text, '(?i){}'))".format
_TYPED = _ELECTED + f""", first AS (SELECT v.doc_id, v.vote_rank, min(s.ord) AS o FROM voted v JOIN sp s ON s.doc_id = v.doc_id AND (s.section_path = v.section_path OR contains(v.section_path, s.title)) GROUP BY ALL),
full_ AS (SELECT v.*, anchor_text || ' ' || array_to_string(content, ' ') || ' ' || coalesce(s.text, '') AS full_text, {_DOM} AS dom FROM voted v LEFT JOIN first f USING (doc_id, vote_rank) LEFT JOIN sp s ON s.doc_id = v.doc_id AND s.ord = f.o),
typed AS (SELECT * EXCLUDE (figure_type), CASE WHEN figure_type <> '' THEN figure_type WHEN dom = 'T6' THEN 'cover_banner' WHEN dom = 'T3' THEN CASE WHEN {_has(WORDS.maps)} THEN 'map_layout' WHEN {_has(WORDS.plans)} THEN 'floor_plan' WHEN {_has(WORDS.views)} THEN 'rendering' ELSE 'map_layout' END
  WHEN dom = 'T4' THEN CASE WHEN {_n(WORDS.dates)} >= 3 THEN 'roadmap' ELSE 'flow_chart' END WHEN dom = 'T2' THEN CASE WHEN {_n(WORDS.numbers)} >= 5 THEN 'bar_chart' ELSE 'comparison_table' END
  WHEN dom = 'T5' THEN CASE WHEN {_has(WORDS.trends)} THEN 'line_chart' ELSE 'photo' END ELSE 'concept_diagram' END AS figure_type FROM full_)"""
_PLACED = _TYPED + """, sv AS (SELECT *, {'a': char_start, 'b': char_end} AS v FROM sp), bp AS (SELECT doc_id, section_path, arg_max(v, ord) AS pv FROM sv GROUP BY ALL), bt AS (SELECT doc_id, title, min(ord) AS first, arg_max(v, ord) AS tv FROM sv WHERE title <> '' GROUP BY ALL),
bm AS (SELECT f.doc_id, f.vote_rank, arg_min(b.tv, b.first) AS mv FROM typed f JOIN bt b ON f.doc_id = b.doc_id AND contains(f.section_path, b.title) GROUP BY ALL),
placed AS (SELECT f.*, md, length(md) AS total_chars, CASE WHEN anchor_text <> '' AND instr(md, anchor_text) > 0 THEN instr(md, anchor_text) - 1 ELSE coalesce(pv.a, mv.a) END AS char_start FROM typed f JOIN reports USING (doc_id) LEFT JOIN bp USING (doc_id, section_path) LEFT JOIN bm USING (doc_id, vote_rank))"""
_CHOSEN = _PLACED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY final_score DESC, vote_rank) AS rank FROM placed),
tp AS (SELECT * FROM rk WHERE rank <= greatest(1, least(total_chars // 1500, 8))),
cg AS (SELECT *, CASE WHEN section_path = lag(section_path) OVER w AND figure_type = lag(figure_type) OVER w THEN 0 ELSE 1 END AS c FROM tp WINDOW w AS (PARTITION BY doc_id ORDER BY rank)),
il AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY rank) AS island FROM cg),
mg AS (SELECT doc_id, island, flatten(list(content ORDER BY rank)) AS items, max(final_score) AS final_score, arg_min(section_path, rank) AS section_path, arg_min(figure_type, rank) AS figure_type, arg_min(anchor_text, rank) AS anchor_text, arg_min(purpose, rank) AS purpose,
  arg_min(confidence, rank) AS confidence, arg_min(vote_count, rank) AS vote_count, arg_min({'c': char_start}, rank).c AS char_start, any_value(md) AS md, any_value(total_chars) AS total_chars FROM il GROUP BY doc_id, island),
chosen AS (SELECT * EXCLUDE (items), list_filter(items, lambda x, i: list_position(items, x) = i) AS content, row_number() OVER (PARTITION BY doc_id ORDER BY char_start NULLS LAST, island) AS n FROM mg)"""


def _greedy(source: str, key: str, order: str, words: str) -> str:
    """CTEs down to `kept` (key, order): the greedy choice by overlap of words, folded over a list for each key."""
    return f"""gw AS (SELECT {key}, {order}, {words} AS w FROM {source}),
gl AS (SELECT {key}, list([{{'p': CAST({order} AS BIGINT), 'w': w}}] ORDER BY {order}) AS l FROM gw GROUP BY {key}),
gr AS (SELECT {key}, list_reduce(l, lambda a, x: CASE WHEN len(x[1].w) > 0 AND len(list_filter(a, lambda y: len(y.w) > 0 AND len(list_intersect(x[1].w, y.w)) / greatest(len(x[1].w), len(y.w)) > 0.6)) > 0 THEN a ELSE list_concat(a, x) END) AS r FROM gl),
kept AS (SELECT {key}, unnest(r).p AS {order} FROM gr)"""


_WORDS = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))".format
_FINAL = _CHOSEN + """, ff AS (SELECT *, trim(regexp_replace(md, '\\s+', ' ', 'g')) AS ft, trim(regexp_replace(anchor_text, '\\s+', ' ', 'g')) AS fa FROM chosen), fp AS (SELECT *, greatest(1, CAST(floor(length(fa) * 0.7e0) AS INTEGER)) AS fn FROM ff),
sound AS (SELECT * FROM fp WHERE confidence >= 0.5 AND length(anchor_text) >= 10 AND (contains(md, anchor_text) OR contains(ft, fa) OR len(list_filter(range(0, greatest(length(fa) - fn, 0) + 1), lambda i: contains(ft, substr(fa, i + 1, fn)))) > 0)),
""" + _greedy("sound", "doc_id", "n", _WORDS("purpose")) + """,
final AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM sound s JOIN kept USING (doc_id, n)) WHERE r <= greatest(1, total_chars // 1500))"""


def _voted(sections: DataFrame) -> DataFrame:
    return G.vote(_proposed(sections))


def _finished(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    reports, sections = _reports(spark, sf_dir), _named(spark, sf_dir)
    return reports, P.final_figures(reports, sections, _voted(sections), WORDS)


@_query(f"WITH {_TYPED} SELECT doc_id, section_path, vote_rank, figure_type FROM typed".replace("vote_rank, figure_type FROM typed", "CAST(vote_rank AS INTEGER) AS vote_rank, figure_type FROM typed"))
def figure_types(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    return P.classify(_voted(sections), sections, WORDS).select("doc_id", "section_path", "vote_rank", "figure_type")


@_query(f"WITH {_CHOSEN} SELECT doc_id, 'F' || n AS figure_id, section_path, figure_type, array_to_string(content, ',') AS content, CAST(char_start AS BIGINT) AS char_start FROM chosen")
def optimised_figures(spark, sf_dir):
    sections = _named(spark, sf_dir)
    out = P.optimised_figures(_reports(spark, sf_dir), sections, _voted(sections), WORDS)
    return out.select("doc_id", "figure_id", "section_path", "figure_type", F.array_join("suggested_content", ",").alias("content"), "char_start")


@_query(f"WITH {_FINAL} SELECT doc_id, 'F' || r AS figure_id, section_path, figure_type, purpose, vote_count, round(confidence, 6) AS confidence, round(final_score, 6) AS final_score, array_to_string(content, ',') AS content FROM final")
def final_figures(spark, sf_dir):
    f = _finished(spark, sf_dir)[1]
    return f.select("doc_id", "figure_id", "section_path", "figure_type", "purpose", "vote_count", F.round("confidence", 6).alias("confidence"), F.round("final_score", 6).alias("final_score"), F.array_join("suggested_content", ",").alias("content"))


def _facts(reports: DataFrame) -> DataFrame:
    errors = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit('run 1: a "b"'), F.lit("run 2: c"))).otherwise(F.array().cast("array<string>"))
    meta = F.struct(F.lit("rules").alias("model"), F.lit(3).alias("self_consistency_n"), F.lit(False).alias("critic_used"), F.col("doc_id").alias("elapsed_ms"), errors.alias("planner_errors"))
    return reports.select("doc_id", F.concat(F.lit("About "), "doc_id").alias("report_summary"), meta.alias("meta"))


@_query(f"""WITH {_FINAL}, js AS (SELECT doc_id, count(*) AS n, array_to_string(list(json_object('figure_id', 'F' || r, 'section_path', section_path, 'figure_type', figure_type, 'purpose', purpose, 'vote_count', vote_count) ORDER BY r), ',') AS j FROM final GROUP BY doc_id)
SELECT doc_id, 'About ' || doc_id AS report_summary, CAST(length(md) AS INTEGER) AS total_chars, CAST(least(length(md) // 1500, 8) AS INTEGER) AS baseline_count, CAST(coalesce(n, 0) AS INTEGER) AS total_figures, '[' || coalesce(j, '') || ']' AS figures,
  '{{"model":"rules","self_consistency_n":3,"critic_used":false,"elapsed_ms":' || doc_id || ',"planner_errors":[' || CASE WHEN doc_id % 3 = 0 THEN '"run 1: a \\"b\\"","run 2: c"' ELSE '' END || ']}}' AS meta FROM reports LEFT JOIN js USING (doc_id)""")
def plan_json(spark, sf_dir):
    reports, final = _finished(spark, sf_dir)
    return P.summary(reports, final.select("doc_id", "figure_id", "section_path", "figure_type", "purpose", "vote_count"), _facts(reports)).withColumn("meta", F.to_json("meta"))


_L = config.ReportLabels()


@_query(f"""WITH {_FINAL}, fm AS (SELECT doc_id, count(*) AS n, string_agg('### F' || r || ' — ' || figure_type || chr(10) || '- **{_L.section}**: ' || section_path || chr(10) || '- **{_L.place}**: ' || chr(10) || '- **{_L.purpose}**: ' || purpose || chr(10) || '- **{_L.anchor}**: ' || anchor_text || chr(10)
  || '- **{_L.confidence}**: ' || printf('%.2f', floor(confidence * 64) / 64) || chr(10) || '- **{_L.score}**: ' || printf('%.2f', floor(final_score * 64) / 64) || chr(10) || '- **{_L.votes}**: ' || vote_count || chr(10) || '- **{_L.content}**: ' || array_to_string(content, ', ') || chr(10) || '- **{_L.prompt}**: ' || chr(10), chr(10) ORDER BY r) AS body FROM final GROUP BY doc_id)
SELECT doc_id, '# {config.REPORT_TITLE}' || chr(10) || chr(10) || '- **{_L.file}**: report-' || doc_id || '.md' || chr(10) || '- **{_L.total}**: ' || format('{{:,}}', length(md)) || chr(10) || '- **{_L.baseline}**: ' || least(length(md) // 1500, 8) || chr(10) || '- **{_L.final}**: ' || coalesce(n, 0) || chr(10) || '- **{_L.summary}**: About ' || doc_id || chr(10) || chr(10) || '## {_L.figures}' || chr(10) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body END || chr(10) || '## {_L.meta}' || chr(10) || chr(10) || '```json' || chr(10)
  || '{{' || chr(10) || '  "model": "rules",' || chr(10) || '  "self_consistency_n": 3,' || chr(10) || '  "critic_used": false,' || chr(10) || '  "elapsed_ms": ' || doc_id || ',' || chr(10) || '  "planner_errors": ' || CASE WHEN doc_id % 3 = 0 THEN '[' || chr(10) || '    "run 1: a \\"b\\"",' || chr(10) || '    "run 2: c"' || chr(10) || '  ]' ELSE '[]' END || chr(10) || '}}' || chr(10) || '```' AS md FROM reports LEFT JOIN fm USING (doc_id)""")
def plan_markdown(spark, sf_dir):
    reports, final = _finished(spark, sf_dir)
    final = written(final.withColumns({"confidence": F.floor(F.col("confidence") * 64) / 64, "final_score": F.floor(F.col("final_score") * 64) / 64}))  # summary and lines read it
    return P.report_lines(P.summary(reports, final, _facts(reports)), final, F.concat(F.lit("report-"), "doc_id", F.lit(".md")))


@_query(f"""WITH {_PATHS}, c AS (SELECT * FROM sp WHERE greatest(t1, t2, t3, t4, t5, t6) >= 0.4)
SELECT doc_id, string_agg(chr(10) || '--- Section: ' || section_path || ' (depth=' || depth || ') ---' || chr(10) || 'Trigger scores: {{''T1'': ' || round(t1, 3) || ', ''T2'': ' || round(t2, 3) || ', ''T3'': ' || round(t3, 3) || ', ''T4'': ' || round(t4, 3) || ', ''T5'': ' || round(t5, 3) || ', ''T6'': ' || round(t6, 3) || '}}' || chr(10)
  || 'Text: ' || substr(text, 1, 500) || chr(10), '' ORDER BY ord) AS context FROM c GROUP BY doc_id""")
def candidate_context(spark, sf_dir):
    return P.candidate_context(S.candidates(_sections(spark, sf_dir)))


# Line items as figures with few words, so that some repeat each other.
_LOW = "lw AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), lp AS (SELECT *, CASE WHEN p % 7 = 0 THEN ' ' ELSE 'c w' || p % 3 || '  x' || p % 4 || ' y' || p % 2 END AS purpose FROM lw)"


@_query(f"WITH {_LOW}, {_greedy('lp', 'doc_id', 'n', _WORDS('purpose'))} SELECT doc_id, CAST(n AS INTEGER) AS pos FROM kept")
def drop_similar(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("p"))
    p = F.col("p")
    return G.drop_similar(li.withColumn("purpose", F.when(p % 7 == 0, " ").otherwise(F.concat(F.lit("c w"), p % 3, F.lit("  x"), p % 4, F.lit(" y"), p % 2)))).select("doc_id", "pos")


# Events as figures of the vision planner: some values are missing.
@_query("""WITH e AS (SELECT user_id AS doc_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'photo' END AS figure_type, CASE WHEN event_id % 4 <> 0 THEN event_id % 8 / 8 END AS confidence, CASE WHEN event_id % 5 = 0 THEN 0.5e0 END AS final_score FROM events)
SELECT doc_id, event_id AS pos, 'F' || row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS figure_id, coalesce(figure_type, 'concept_diagram') AS figure_type, coalesce(confidence, 0.7e0) AS confidence, coalesce(final_score, confidence, 0.7e0) AS final_score, 'after' AS position_hint, 0e0 AS t1, CAST(1 AS INTEGER) AS vote_count FROM e""")
def vision_defaults(spark, sf_dir):
    e, i = _read(spark, sf_dir, "events"), F.col("event_id")
    f = e.select(F.col("user_id").alias("doc_id"), i.alias("pos"), F.when(i % 3 == 0, "photo").alias("figure_type"), F.when(i % 4 != 0, i % 8 / 8).alias("confidence"), F.when(i % 5 == 0, 0.5).alias("final_score"))
    return P.with_defaults(f).select("doc_id", "pos", "figure_id", "figure_type", "confidence", "final_score", "position_hint", "t1", "vote_count")


_KINDS = {"photo": ("the", "que"), "bar_chart": ("und",)}


@_query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS purpose, ['photo', 'bar_chart', 'roadmap'][doc_id % 3 + 1] AS kind, source FROM documents)
SELECT doc_id, CASE kind WHEN 'photo' THEN contains(purpose, 'the') OR contains(purpose, 'que') WHEN 'bar_chart' THEN contains(purpose, 'und') ELSE true END AS matches FROM d""")
def content_matches(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("photo", "bar_chart", "roadmap"))), (F.col("doc_id") % 3 + 1).cast("int"))
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("purpose"), kind.alias("figure_type"), F.array("source").alias("suggested_content"))
    return d.select("doc_id", P.content_matches(_KINDS).alias("matches"))
