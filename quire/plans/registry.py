"""All queries by name, and the same in SQL for DuckDB.

The test tables hold no reports, figures or records. The views below derive them from documents, events and lineitem by
formulas that both engines share; word lists are those of `config.PROSE`, since the Korean ones match nothing there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import figures as G
from quire.operators import records as R
from quire.operators import sections as S
from quire.operators import slots, streams
from quire.plans import block_queries, edit_queries, markup_queries, plan_queries, planner_queries, slot_queries, stream_queries  # noqa: F401  (they add theirs)
from quire.plans.base import ORACLE_SQL, QUERIES, _query, _read
from quire.plans.views import _FEATURES, _LINES, _SCORES, _SECTIONS, _T, _headed, _reports, _rounded, _scored
from quire.sources.records import decode_records

FLAGSHIP = "section_ranking"


# Some texts get line ends of two characters, some lone carriage returns, some runs of empty lines.
@_query(r"WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, '. ', '.' || chr(13)) WHEN 2 THEN replace(text, chr(10), chr(10) || chr(13) || chr(10) || chr(10) || chr(10)) ELSE text END AS t FROM documents) SELECT doc_id, regexp_replace(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS md FROM d")
def normalize_text(spark, sf_dir):
    k, to = F.col("doc_id") % 4, lambda old, new: F.replace("text", F.lit(old), F.lit(new))
    text = F.when(k == 0, to("\n", "\r\n")).when(k == 1, to(". ", ".\r")).when(k == 2, to("\n", "\n\r\n\n\n")).otherwise(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.normalise(text).alias("md"))


@_query(f"WITH {_LINES} SELECT doc_id, CAST(ord AS INTEGER) AS ord, line, start FROM lines")
def split_lines_offsets(spark, sf_dir):
    return S.lines(_reports(spark, sf_dir))


@_query(f"WITH {_SECTIONS} SELECT * FROM sections")
def sections(spark, sf_dir):
    return _headed(spark, sf_dir)


@_query(
    f"""WITH {_SECTIONS}, l AS (SELECT doc_id, list({{'d': depth, 't': title, 's': CAST([] AS VARCHAR[])}} ORDER BY ord) AS l FROM sections GROUP BY doc_id),
r AS (SELECT s.doc_id, s.section_id, s.title, s.depth, list_reduce(list_prepend({{'d': 0, 't': '', 's': CAST([] AS VARCHAR[])}}, l[1:s.ord]), lambda a, x: {{'d': x.d, 't': x.t, 's': list_append(a.s[1:greatest(x.d - 1, 0)], x.t)}}).s AS st FROM sections s JOIN l USING (doc_id)),
p AS (SELECT *, array_to_string(st[1:greatest(depth - 1, 0)], ' > ') AS parent_path FROM r)
SELECT doc_id, section_id, parent_path, CASE WHEN parent_path = '' THEN title ELSE parent_path || ' > ' || title END AS section_path FROM p"""
)
def section_paths(spark, sf_dir):
    return _headed(spark, sf_dir, paths=True).select("doc_id", "section_id", "parent_path", "section_path")


@_query(f"WITH {_FEATURES} SELECT doc_id, section_id, length, round(numeric_density, 6) AS numeric_density, comparison_words, process_words, space_words, evidence_words, has_table, is_top FROM feat")
def section_features(spark, sf_dir):
    f = S.features(_headed(spark, sf_dir), config.PROSE)
    return f.select("doc_id", "section_id", "length", F.round("numeric_density", 6).alias("numeric_density"), "comparison_words", "process_words", "space_words", "evidence_words", "has_table", "is_top")


@_query(f"WITH {_SCORES} SELECT doc_id, section_id, {_T} FROM scored")
def trigger_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "section_id", *_rounded())


@_query(f"WITH {_SCORES} SELECT doc_id, section_id FROM scored WHERE greatest(t1, t2, t3, t4, t5, t6) >= 0.4")
def candidates(spark, sf_dir):
    return S.candidates(_scored(spark, sf_dir)).select("doc_id", "section_id")


_DOMINANT = "CASE greatest(t1, t2, t3, t4, t5, t6) WHEN t1 THEN 'T1' WHEN t2 THEN 'T2' WHEN t3 THEN 'T3' WHEN t4 THEN 'T4' WHEN t5 THEN 'T5' ELSE 'T6' END"


@_query(f"WITH {_SCORES} SELECT doc_id, section_id, {_DOMINANT} AS dominant FROM scored")
def dominant_trigger(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "section_id", S.dominant().alias("dominant"))


@_query(
    rf"""WITH {_SCORES}, d AS (SELECT doc_id, section_id, text, {_DOMINANT} AS t FROM scored)
SELECT doc_id, section_id, CASE t WHEN 'T6' THEN 'cover_banner' WHEN 'T3' THEN 'map_layout' WHEN 'T4' THEN CASE WHEN len(regexp_extract_all(text, '\d{{4}}년|\d{{1,2}}월|\d{{4}}')) >= 3 THEN 'roadmap' ELSE 'flow_chart' END
  WHEN 'T2' THEN CASE WHEN len(regexp_extract_all(text, '\d+(?:\.\d+)?')) >= 5 THEN 'bar_chart' ELSE 'comparison_table' END WHEN 'T5' THEN 'photo' ELSE 'concept_diagram' END AS figure_type FROM d"""
)
def classify(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "section_id", S.figure_type(S.dominant(), F.col("text"), config.PROSE_TYPES).alias("figure_type"))


@_query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(t1, t2, t3, t4, t5, t6) DESC, ord) AS rank FROM scored)
SELECT doc_id, section_id, title, CAST(rank AS INTEGER) AS rank, round(greatest(t1, t2, t3, t4, t5, t6), 6) AS score FROM r WHERE rank <= 3""")
def section_ranking(spark, sf_dir):
    return S.ranking(_scored(spark, sf_dir)).select("doc_id", "section_id", "title", "rank", F.round(F.greatest(*S.TRIGGERS), 6).alias("score"))


# Events as runs of a planner: a document is ten users, a run is event_id % 3.
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 10).alias("doc_id"), (F.col("event_id") % 3).alias("run_id"), F.col("event_id").alias("pos"), (F.col("user_id") % 7).cast("string").alias("section_path"),
        F.col("event_type").alias("figure_type"), (F.col("event_id") % 10 / 10).alias("confidence"), (F.col("event_id") % 100 / 100).alias("final_score"), F.array("event_type", (F.col("event_id") % 5).cast("string")).alias("suggested_content"), F.concat(F.lit("a"), "event_id").alias("anchor_text"),
    )


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document has one more run, without figures."""
    runs = _runs(spark, sf_dir)
    empty = runs.filter(F.col("doc_id") % 2 == 0).select("doc_id", F.lit(3).cast("long").alias("run_id"))
    return G.vote(runs, runs.select("doc_id", "run_id").union(empty).distinct())


_RUNS = "runs AS (SELECT user_id % 10 AS doc_id, event_id % 3 AS run_id, event_id AS pos, CAST(user_id % 7 AS VARCHAR) AS section_path, event_type AS figure_type, event_id % 10 / 10 AS confidence, event_id % 100 / 100 AS final_score, [event_type, CAST(event_id % 5 AS VARCHAR)] AS suggested_content, 'a' || event_id AS anchor_text FROM events)"
_VOTE = _RUNS + """, items AS (SELECT doc_id, section_path, figure_type, x, min((run_id * 1000000000 + pos) * 2 + i) AS f FROM (SELECT *, unnest(suggested_content) AS x, generate_subscripts(suggested_content, 1) AS i FROM runs) GROUP BY ALL),
lists AS (SELECT doc_id, section_path, figure_type, list(x ORDER BY f)[1:8] AS items FROM items GROUP BY ALL),
g AS (SELECT doc_id, section_path, figure_type, count(*) AS vote_count, avg(confidence) AS confidence, avg(final_score) AS final_score, min(run_id * 1000000000 + pos) AS f, arg_min(anchor_text, run_id * 1000000000 + pos) AS anchor_text FROM runs GROUP BY ALL),
n AS (SELECT doc_id, count(DISTINCT run_id) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM runs GROUP BY doc_id),
voted AS (SELECT g.*, items, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY final_score DESC, f) AS INTEGER) AS vote_rank, 'F' || row_number() OVER (PARTITION BY doc_id ORDER BY f) AS figure_id FROM g JOIN n USING (doc_id) JOIN lists USING (doc_id, section_path, figure_type) WHERE vote_count >= n // 2 + 1)"""


@_query(f"WITH {_VOTE} SELECT doc_id, section_path, figure_type, figure_id, vote_count, round(confidence, 6) AS confidence, round(final_score, 6) AS final_score, array_to_string(items, ',') AS content, anchor_text, vote_rank FROM voted")
def vote(spark, sf_dir):
    v = _voted(spark, sf_dir)
    return v.select("doc_id", "section_path", "figure_type", "figure_id", "vote_count", F.round("confidence", 6).alias("confidence"), F.round("final_score", 6).alias("final_score"), F.array_join("suggested_content", ",").alias("content"), "anchor_text", "vote_rank")


@_query(
    f"""WITH {_VOTE}, rev AS (SELECT user_id % 10 AS doc_id, 'F' || (event_id % 40) AS figure_id, event_id % 4 <> 0 AS approved, CASE event_id % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'null' END AS alt, event_id FROM events),
last AS (SELECT doc_id, figure_id, arg_max(approved, event_id) AS approved, arg_max({{'a': alt}}, event_id).a AS alt FROM rev GROUP BY ALL)
SELECT doc_id, figure_id, section_path, CASE WHEN alt IS NOT NULL AND alt <> 'null' THEN alt ELSE figure_type END AS figure_type FROM voted LEFT JOIN last USING (doc_id, figure_id) WHERE coalesce(approved, true)"""
)
def critic_merge(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    alt = F.when(F.col("event_id") % 3 == 0, "photo").when(F.col("event_id") % 3 == 1, "null")
    reviews = e.select((F.col("user_id") % 10).alias("doc_id"), F.concat(F.lit("F"), F.col("event_id") % 40).alias("figure_id"), (F.col("event_id") % 4 != 0).alias("approved"), alt.alias("alternative"), F.col("event_id").alias("ord"))
    return G.review(_voted(spark, sf_dir), reviews).select("doc_id", "figure_id", "section_path", "figure_type")


# Line items as figures of orders: total_chars from the order, score from the quantity.
def _lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"))
    li = li.agg(F.min("l_returnflag").alias("section_path"), F.min("l_linestatus").alias("figure_type"), F.max("l_quantity").alias("final_score"), F.min("l_partkey").alias("part"))
    return li.select("doc_id", "pos", F.concat(F.lit("F"), "pos").alias("figure_id"), "section_path", "figure_type", "final_score", F.when(F.col("part") % 5 != 0, F.col("part")).alias("char_start"), F.array("section_path", F.concat(F.lit("p"), F.col("part") % 3)).alias("suggested_content"), (F.col("doc_id") % 10 * 1000).alias("total_chars"))


_FIGURES = """figs AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, 'F' || l_linenumber AS figure_id, min(l_returnflag) AS section_path, min(l_linestatus) AS figure_type, max(l_quantity) AS final_score,
  CASE WHEN min(l_partkey) % 5 <> 0 THEN min(l_partkey) END AS char_start, [min(l_returnflag), 'p' || min(l_partkey) % 3] AS suggested_content, l_orderkey % 10 * 1000 AS total_chars FROM lineitem GROUP BY l_orderkey, l_linenumber),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY final_score DESC, pos) AS rank FROM figs),
top AS (SELECT * FROM ranked WHERE rank <= greatest(1, least(total_chars // 1500, 8)))"""
_ISLANDS = _FIGURES + """, ch AS (SELECT *, CASE WHEN section_path = lag(section_path) OVER w AND figure_type = lag(figure_type) OVER w THEN 0 ELSE 1 END AS c FROM top WINDOW w AS (PARTITION BY doc_id ORDER BY rank)),
isl AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY rank) AS island FROM ch),
merged AS (SELECT doc_id, island, arg_min(figure_id, rank) AS figure_id, any_value(section_path) AS section_path, any_value(figure_type) AS figure_type, max(final_score) AS final_score, count(*) AS merged, flatten(list(suggested_content ORDER BY rank)) AS items, arg_min({'c': char_start}, rank).c AS char_start FROM isl GROUP BY doc_id, island)"""


@_query(f"WITH {_FIGURES} SELECT doc_id, figure_id, final_score, CAST(rank AS INTEGER) AS rank FROM top")
def optimize_topk(spark, sf_dir):
    return G.top_k(_lineitems(spark, sf_dir)).select("doc_id", "figure_id", "final_score", "rank")


@_query(f"WITH {_ISLANDS} SELECT doc_id, figure_id, section_path, figure_type, final_score, merged, array_to_string(list_filter(items, lambda x, i: list_position(items, x) = i), ',') AS content FROM merged")
def merge_islands(spark, sf_dir):
    return G.merge_islands(G.top_k(_lineitems(spark, sf_dir))).select("doc_id", "figure_id", "section_path", "figure_type", "final_score", "merged", F.array_join("suggested_content", ",").alias("content"))


@_query(f"WITH {_ISLANDS} SELECT doc_id, 'F' || row_number() OVER (PARTITION BY doc_id ORDER BY char_start NULLS LAST, island) AS figure_id, section_path, figure_type, CAST(coalesce(char_start, -1) AS BIGINT) AS char_start FROM merged")
def doc_order_renumber(spark, sf_dir):
    top = G.top_k(_lineitems(spark, sf_dir)).drop("pos", "figure_id", "total_chars", "suggested_content")  # not in the result
    return G.in_document_order(G.merge_islands(top)).select("doc_id", "figure_id", "section_path", "figure_type", F.coalesce("char_start", F.lit(-1)).alias("char_start"))


# Anchors cut from a document, every third with another word in it.
@_query(
    r"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 20, 14) || ' zzzz ' || substr(text, 60, 10) WHEN doc_id % 3 = 1 THEN replace(substr(text, 20, 40), ' ', '  ') ELSE substr(text, 20, doc_id % 40) END AS anchor FROM documents),
f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(regexp_replace(anchor, '\s+', ' ', 'g')) AS a FROM a),
p AS (SELECT *, greatest(1, CAST(floor(length(a) * 0.7e0) AS INTEGER)) AS p FROM f)
SELECT doc_id, length(anchor) >= 10 AND (contains(text, anchor) OR contains(t, a) OR len(list_filter(range(0, greatest(length(a) - p, 0) + 1), lambda i: contains(t, substr(a, i + 1, p)))) > 0) AS found FROM p"""
)
def anchor_exists(spark, sf_dir):
    d, key = _read(spark, sf_dir, "documents"), F.col("doc_id") % 3
    sub = lambda at, n: F.substring(F.col("text"), F.lit(at), n)
    anchor = F.when(key == 0, F.concat(sub(20, F.lit(14)), F.lit(" zzzz "), sub(60, F.lit(10)))).when(key == 1, F.replace(sub(20, F.lit(40)), F.lit(" "), F.lit("  "))).otherwise(sub(20, (F.col("doc_id") % 40).cast("int")))
    return d.select("doc_id", G.anchor_exists(anchor, F.col("text")).alias("found"))


# Each turn is followed by a near copy with one more word.
@_query(f"""WITH cv AS (SELECT conv_id AS doc_id, turn * 2 + k AS pos, text || CASE k WHEN 1 THEN ' again' ELSE '' END AS purpose FROM conversations, (VALUES (0), (1)) v(k)), {plan_queries._greedy('cv', 'doc_id', 'pos', plan_queries._WORDS('purpose'))} SELECT cv.* FROM cv JOIN kept USING (doc_id, pos)""")
def near_dup_greedy(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return G.drop_similar(c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + F.col("k")).alias("pos"), F.concat("text", F.when(F.col("k") == 1, " again").otherwise("")).alias("purpose")))


@_query("SELECT event_id, trim(props) AS object FROM events")
def json_extract(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", T.json_object(F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).alias("object"))


@_query("""WITH x AS (SELECT n_regionkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS l, n_nationkey FROM nation)
SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(l, chr(10) ORDER BY n_nationkey) AS md FROM x GROUP BY n_regionkey""")
def md_table(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").withColumn("row", F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells")))
    rows = n.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["cells"]).alias("rows"))
    return rows.select("n_regionkey", T.table_markdown(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), "rows")).alias("md"))


# Line items as records: the order is the file.
def _records(spark: SparkSession, sf_dir: str, shift: int = 0, keep: bool = False) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"))
    tag = F.element_at(F.array(*map(F.lit, (0x32, 0x33, 0x36, 0x3A, 0x45))), (F.col("p") % 5 + 1).cast("int"))
    rows = li.select("file", "ord", tag.alias("tag"), (F.col("p") % 7 % 4).cast("int").alias("level"), (F.col("p") % 11).alias("size"), "p")
    if shift:  # a perturbed copy
        rows = rows.filter(F.col("p") % 13 != 0).withColumn("tag", F.when(F.col("p") % 17 == 0, 0x99).otherwise(F.col("tag"))).withColumn("size", F.when(F.col("p") % 19 == 0, F.col("size") + shift).otherwise(F.col("size")))
    return rows if keep else rows.drop("p")


_RECORDS = "base AS (SELECT l_orderkey AS file, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY ALL), rec AS (SELECT file, ord, [50, 51, 54, 58, 69][p % 5 + 1] AS tag, p % 7 % 4 AS level, p % 11 AS size, p FROM base)"
_FINDINGS = _RECORDS + """, w AS (SELECT *, lag(level) OVER o AS pl, lag(tag) OVER o AS pt, list({'t': tag, 'l': level}) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM rec WINDOW o AS (PARTITION BY file ORDER BY ord)),
st AS (SELECT *, list_filter([CASE WHEN x.l <= level AND x.t <> 58 THEN -1 WHEN x.t = 69 AND x.l = level + 1 THEN 1 ELSE 0 END for x in ahead], lambda s: s <> 0)[1] AS s FROM w),
findings AS (SELECT file, ord, 'R-040' AS rule, 'HIGH' AS severity FROM w WHERE level - pl > 1 UNION ALL SELECT file, ord, 'R-042', 'MEDIUM' FROM w WHERE tag = 51 AND pt IS DISTINCT FROM 50 UNION ALL SELECT file, ord, 'R-041', 'HIGH' FROM st WHERE tag = 54 AND s IS DISTINCT FROM 1)"""
_DIFF = _RECORDS + """, cand AS (SELECT file, ord, CASE WHEN p % 17 = 0 THEN 153 ELSE tag END AS tag, level, CASE WHEN p % 19 = 0 THEN size + 3 ELSE size END AS size FROM rec WHERE p % 13 <> 0),
j AS (SELECT r.file AS file, r.ord AS ord, r.tag AS a, c.tag AS b, r.level AS al, c.level AS bl, r.size AS sa, c.size AS sb FROM rec r LEFT JOIN cand c USING (file, ord)),
diffs AS (SELECT file, ord, 'MISSING' AS kind, 'CRITICAL' AS severity FROM j WHERE b IS NULL UNION ALL SELECT file, ord, 'TAG', 'HIGH' FROM j WHERE a <> b UNION ALL SELECT file, ord, 'LEVEL', 'HIGH' FROM j WHERE a = b AND al <> bl UNION ALL SELECT file, ord, 'SIZE', 'HIGH' FROM j WHERE a = b AND sa <> sb)"""


@_query(f"WITH {_FINDINGS} SELECT * FROM findings")
def record_rules(spark, sf_dir):
    return R.findings(_records(spark, sf_dir))


@_query(f"WITH {_RECORDS} SELECT file, ord, coalesce((SELECT max(e.ord) FROM rec e WHERE e.file = rec.file AND e.ord < rec.ord AND e.level < rec.level), -1) AS parent_ord FROM rec")
def record_parent(spark, sf_dir):
    return R.parents(_records(spark, sf_dir)).select("file", "ord", F.coalesce("parent_ord", F.lit(-1)).alias("parent_ord"))


# The stack itself, folded for each record over those up to it; its last but one element is the parent.
@_query(f"""WITH {_RECORDS}, l AS (SELECT file, list({{'o': CAST(ord AS BIGINT), 'l': level, 's': CAST([] AS BIGINT[])}} ORDER BY ord) AS l FROM rec GROUP BY file),
i AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord) AS i FROM rec),
st AS (SELECT i.file, i.ord, list_reduce(list_prepend({{'o': CAST(-1 AS BIGINT), 'l': CAST(0 AS BIGINT), 's': CAST([] AS BIGINT[])}}, l[1:i]), lambda a, x: {{'o': x.o, 'l': x.l, 's': list_append(a.s[1:x.l], x.o)}}).s AS s FROM i JOIN l USING (file))
SELECT file, ord, coalesce(s[len(s) - 1], -1) AS parent_ord FROM st""")
def record_tree(spark, sf_dir):
    return R.tree_parents(_records(spark, sf_dir)).select("file", "ord", F.coalesce("parent_ord", F.lit(-1)).alias("parent_ord"))


@_query(f"WITH {_DIFF} SELECT * FROM diffs")
def record_diff(spark, sf_dir):
    return R.compare(_records(spark, sf_dir), _records(spark, sf_dir, 3))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


@_query(f"""WITH {_DIFF}, n AS (SELECT f.file AS file, {_COUNTS} FROM (SELECT DISTINCT file FROM base) f LEFT JOIN diffs USING (file) GROUP BY f.file)
SELECT *, CASE WHEN n_critical + n_high > 0 THEN 'FAIL' WHEN n_medium + n_low > 0 THEN 'WARN' ELSE 'IDENTICAL' END AS status FROM n""")
def severity_rollup(spark, sf_dir):
    records = _records(spark, sf_dir)
    return streams.diff_report(records, R.compare(records, _records(spark, sf_dir, 3)))



@_query(f"WITH {_RECORDS}, f AS (SELECT DISTINCT file FROM rec), n AS (SELECT file, tag FROM f, (VALUES (50), (69)) v(tag)) SELECT file, tag FROM n WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.file = n.file AND rec.tag = n.tag)")
def required_tags(spark, sf_dir):
    return R.missing_tags(_records(spark, sf_dir), [0x32, 0x45])


# Prompts are roles and first words, so that many turns share one.
@_query("SELECT role || ' ' || split_part(text, ' ', 1) AS prompt, min(conv_id) AS first_conv, count(*) AS uses FROM conversations GROUP BY ALL")
def prompt_dedup(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").groupBy(_prompt().alias("prompt")).agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("uses"))


def _prompt():
    return F.concat("role", F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1)))


@_query(f"""WITH {_RECORDS}, lists AS (SELECT file, ord, level, p % 3 AS declared FROM rec WHERE tag = 69),
own AS (SELECT l.file, l.ord, c.ord AS child FROM lists l JOIN rec c ON c.file = l.file AND c.ord > l.ord AND c.tag = 50 AND c.level = l.level + 1 WHERE NOT EXISTS (SELECT 1 FROM rec b WHERE b.file = l.file AND b.ord > l.ord AND b.ord < c.ord AND b.level <= l.level)),
n AS (SELECT file, ord, count(*) AS n FROM own GROUP BY ALL)
SELECT file, ord, CAST(declared AS INTEGER) AS declared, CAST(coalesce(n, 0) AS BIGINT) AS actual FROM lists LEFT JOIN n USING (file, ord) WHERE declared <> coalesce(n, 0)""")
def list_counts(spark, sf_dir):
    return R.wrong_list_counts(_records(spark, sf_dir, keep=True).withColumn("declared", (F.col("p") % 3).cast("int")))


# Line items as table cells: three rows, with spans from the part.
@_query(f"""WITH {_RECORDS}, cells AS (SELECT file AS doc_id, ord, ord % 3 AS r, ord // 3 AS c, 1 + p // 2 % 2 AS rs, 1 + p % 2 AS cs, CASE WHEN p % 3 = 0 THEN '' ELSE 'c' || p END AS text FROM base),
kept AS (SELECT * FROM cells a WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.doc_id = a.doc_id AND a.r >= b.r AND a.r < b.r + b.rs AND a.c >= b.c AND a.c < b.c + b.cs AND (a.r <> b.r OR a.c <> b.c)))
SELECT doc_id, CAST(r AS INTEGER) AS r, string_agg(text, '|' ORDER BY ord) AS cells FROM kept GROUP BY doc_id, r HAVING bool_or(text <> '')""")
def merged_cells(spark, sf_dir):
    ord_, p = F.col("ord"), F.col("p")
    cells = _records(spark, sf_dir, keep=True).select(
        F.col("file").alias("doc_id"), F.lit(0).alias("table_id"), "ord", (ord_ % 3).cast("int").alias("r"), F.floor(ord_ / 3).cast("int").alias("c"),
        (F.floor(p / 2) % 2 + 1).cast("int").alias("rowspan"), (p % 2 + 1).cast("int").alias("colspan"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("c"), p)).alias("text"),
    )
    return B.merged_rows(cells).select("doc_id", "r", F.array_join("texts", "|").alias("cells"))


# Each section as a figure: with an anchor from its text, with its path, or with a path that only holds its title.
@_query(f"""WITH {_SECTIONS}, s AS (SELECT doc_id, ord, title, title || '#' || depth AS path, text, {{'a': char_start, 'b': char_end}} AS v FROM sections),
f AS (SELECT doc_id, 'F' || ord AS figure_id, CASE WHEN ord % 3 = 0 THEN substr(text, 1, 12) ELSE '' END AS anchor, CASE WHEN ord % 3 = 1 THEN path ELSE 'x ' || title END AS path FROM s),
p AS (SELECT doc_id, path, arg_max(v, ord) AS pv FROM s GROUP BY ALL), t AS (SELECT doc_id, title, min(ord) AS first, arg_max(v, ord) AS tv FROM s WHERE title <> '' GROUP BY ALL),
m AS (SELECT f.doc_id, f.figure_id, arg_min(t.tv, t.first) AS mv FROM f JOIN t ON f.doc_id = t.doc_id AND contains(f.path, t.title) GROUP BY ALL),
j AS (SELECT doc_id, figure_id, anchor, CASE WHEN anchor <> '' THEN instr(md, anchor) ELSE 0 END AS i, pv, mv FROM f JOIN reports USING (doc_id) LEFT JOIN p USING (doc_id, path) LEFT JOIN m USING (doc_id, figure_id))
SELECT doc_id, figure_id, CAST(CASE WHEN i > 0 THEN i - 1 ELSE coalesce(pv.a, mv.a) END AS BIGINT) AS char_start, CAST(CASE WHEN i > 0 THEN i - 1 + length(anchor) ELSE coalesce(pv.b, mv.b) END AS BIGINT) AS char_end FROM j""")
def figure_positions(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    s = _headed(spark, sf_dir).withColumn("section_path", F.concat("title", F.lit("#"), "depth"))
    path = F.when(F.col("ord") % 3 == 1, F.col("section_path")).otherwise(F.concat(F.lit("x "), "title"))
    f = s.select("doc_id", F.concat(F.lit("F"), "ord").alias("figure_id"), F.when(F.col("ord") % 3 == 0, F.substring("text", 1, 12)).otherwise("").alias("anchor_text"), path.alias("section_path"))
    return G.locate(f, reports, s).select("doc_id", "figure_id", "char_start", "char_end")


@_query(f"""WITH {_VOTE}, nv AS (SELECT doc_id, count(*) AS n FROM voted GROUP BY doc_id),
more AS (SELECT user_id % 10 AS doc_id, CAST(user_id % 7 AS VARCHAR) AS section_path, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS k FROM events WHERE event_type = 'error')
SELECT doc_id, figure_id, section_path, figure_type, vote_count, round(final_score, 6) AS final_score FROM voted UNION ALL SELECT doc_id, 'F' || (coalesce(n, 0) + k), section_path, 'concept_diagram', 1, 0.6e0 FROM more LEFT JOIN nv USING (doc_id)""")
def critic_additions(spark, sf_dir):
    e = _read(spark, sf_dir, "events").filter("event_type = 'error'")
    more = e.select((F.col("user_id") % 10).alias("doc_id"), F.col("event_id").alias("pos"), (F.col("user_id") % 7).cast("string").alias("section_path"), F.lit(None).cast("string").alias("figure_type"), F.lit(None).cast("double").alias("confidence"))
    voted = _voted(spark, sf_dir)
    return G.add_missing(voted, voted, more).select("doc_id", "figure_id", "section_path", "figure_type", "vote_count", F.round("final_score", 6).alias("final_score"))


# Every turn comes twice, the second time later, with capitals and blanks.
@_query("""WITH c AS (SELECT conv_id, turn + n * 1000 AS turn, role, CASE n WHEN 1 THEN replace(text, 'a', 'A') || '  ' ELSE text END AS text FROM conversations, (VALUES (0), (1)) v(n)),
k AS (SELECT conv_id AS doc_id, turn, role, CASE WHEN role <> 'user' AND trim(text) <> '' THEN lower(trim(text)) ELSE lower(substr(text, 1, 30)) END AS k FROM c)
SELECT doc_id, role AS figure_type, min(turn) AS pos FROM k GROUP BY doc_id, role, k""")
def figure_dedup(spark, sf_dir):
    n = F.col("n")
    c = _read(spark, sf_dir, "conversations").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"turn": F.col("turn") + n * 1000, "text": F.when(n == 1, F.concat(F.replace("text", F.lit("a"), F.lit("A")), F.lit("  "))).otherwise(F.col("text"))})
    f = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") != "user", F.col("text")).alias("anchor_text"), F.col("text").alias("purpose"), F.col("role").alias("figure_type"), F.lit("").alias("section_path"))
    return G.drop_repeated(f).select("doc_id", "figure_type", "pos")


@_query(rf"""WITH {_LINES}, t AS (SELECT doc_id, ord, line, last_value(CASE WHEN regexp_matches(line, '^[0-9]+[.] ') THEN substr(regexp_replace(line, '\s+', ' ', 'g'), 1, 80) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM lines),
c AS (SELECT doc_id, ord, coalesce(t, 'none') AS nearest_title, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS c FROM t)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, nearest_title, regexp_replace(regexp_replace(regexp_replace(c, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS context FROM c""")
def block_context(spark, sf_dir):
    blocks = S.lines(_reports(spark, sf_dir)).withColumnRenamed("line", "text")
    return B.with_context(B.with_nearest_title(blocks, "^[0-9]+[.] ", "none")).select("doc_id", "ord", "nearest_title", "context")


@_query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN trim(props) WHEN 1 THEN trim(props) WHEN 3 THEN trim(props) END AS object FROM events""")
def json_replies(spark, sf_dir):
    k, p = F.col("event_id") % 4, F.col("props")
    fence = lambda tag: F.concat(F.lit(f"Sure.\n```{tag}\n"), p, F.lit("\n```"))
    reply = F.when(k == 0, fence("json")).when(k == 1, fence("")).when(k == 2, F.concat(F.lit("It is "), p, F.lit(" and "), p, F.lit("."))).otherwise(F.concat(F.lit("It is\n"), p, F.lit(" - so.")))
    return _read(spark, sf_dir, "events").select("event_id", T.json_object(reply).alias("object"))


# Streams of bytes made from line items, decoded again; every seventh part has its size in a word of its own.
@_query("""WITH base AS (SELECT l_orderkey AS file, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), r AS (SELECT file, row_number() OVER w - 1 AS ord, 16 + p % 90 AS tag, p % 5 AS level, p % 9 AS size, sum(CASE WHEN p % 7 = 0 THEN 8 ELSE 4 END + p % 9) OVER w - CASE WHEN p % 7 = 0 THEN 8 ELSE 4 END - p % 9 AS off FROM base WINDOW w AS (PARTITION BY file ORDER BY n))
SELECT CAST(file AS VARCHAR) AS file, CAST(ord AS INTEGER) AS ord, CAST(off AS BIGINT) AS "offset", CAST(tag AS INTEGER) AS tag, CAST(level AS INTEGER) AS level, CAST(size AS BIGINT) AS size, repeat('AB', CAST(size AS INTEGER)) AS data FROM r""")
def decoded_records(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    p, size = F.col("p"), F.col("p") % 9
    word = lambda v: F.concat(*[F.lpad(F.hex(F.shiftright(v, k).bitwiseAND(F.lit(255))), 2, "0") for k in (0, 8, 16, 24)])
    head = lambda n: word(16 + p % 90 + p % 5 * 1024 + n.cast("long") * 1048576)
    raw = F.concat(F.when(p % 7 == 0, F.concat(head(F.lit(0xFFF)), word(size.cast("long")))).otherwise(head(size)), F.repeat(F.lit("AB"), size.cast("int")))
    streams = li.select("file", F.struct("n", raw.alias("raw")).alias("x")).groupBy(F.col("file").cast("string").alias("file")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["raw"]), "")).alias("content"))
    return decode_records(streams).withColumn("data", F.hex("data"))


@_query(f"""WITH {_RECORDS}, d AS (SELECT DISTINCT file, t AS tag, file % 3 AS declared FROM rec, (VALUES (50), (51)) v(t)), n AS (SELECT d.*, (SELECT count(*) FROM rec r WHERE r.file = d.file AND r.tag = d.tag) AS actual FROM d)
SELECT file, CAST(tag AS INTEGER) AS tag, declared, actual FROM n WHERE declared <> actual""")
def declared_counts(spark, sf_dir):
    records = _records(spark, sf_dir)
    declared = records.select("file").distinct().select("file", F.explode(F.array(F.lit(50), F.lit(51))).alias("tag"), (F.col("file") % 3).alias("declared"))
    return R.declared_and_actual(records, declared)


# Prompts are whole turns, each asked twice, and answered once each; the answer goes back to all turns with the prompt.
@_query("WITH c AS (SELECT conv_id, turn * 2 + k AS turn, role || ' ' || text AS prompt FROM conversations, (VALUES (0), (1)) v(k)) SELECT conv_id, turn, c.prompt, 'made for ' || first AS answer FROM c JOIN (SELECT prompt, min(conv_id) AS first FROM c GROUP BY prompt) p ON p.prompt IS NOT DISTINCT FROM c.prompt")
def prompt_answers(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"turn": F.col("turn") * 2 + F.col("k"), "prompt": F.concat("role", F.lit(" "), "text")})
    made = c.groupBy("prompt").agg(F.concat(F.lit("made for "), F.min("conv_id")).alias("image"))
    return slots.with_images(c.select("conv_id", "turn", "prompt"), made).withColumnRenamed("image", "answer")


# Turns as sections; the odd ones are lines of a pipe table.
@_query(r"""WITH c AS (SELECT conv_id AS doc_id, turn, trim(CASE WHEN turn % 2 = 1 THEN '| ' || text || ' |' ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations),
f AS (SELECT *, regexp_matches(t, '(?m)^[|].*[|]$') AS has_table, least(1e0, len(regexp_extract_all(t, '\d+')) / greatest(len(regexp_extract_all(t, '\S+')), 1) * 0.4e0 + len(regexp_extract_all(t, '(?i)the|que')) * 0.2e0) AS x FROM c)
SELECT doc_id, turn, has_table, round(x * CASE WHEN has_table THEN 0.3e0 ELSE 1e0 END, 6) AS t2 FROM f""")
def section_tables(spark, sf_dir):
    text = T.strip(F.when(F.col("turn") % 2 == 1, F.concat(F.lit("| "), "text", F.lit(" |"))).otherwise(F.col("text")))
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", text.alias("text"), F.lit(0).alias("ord"), F.lit(1).alias("depth"))
    return S.scores(S.features(c, config.PROSE), config.PROSE).select("doc_id", "turn", "has_table", F.round("t2", 6).alias("t2"))
