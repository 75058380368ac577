"""Queries over section markup.

Each document is a section: its lines are paragraphs, every fifth one a table of its first words (some with merged cells, some with
a table in a cell), some hold an image. One document in three has no prefixes, one in three other ones; of every tenth the end is
cut off. The SQL states what must come out from the lines, without any markup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import markup as M
from quire.plans.base import _query, _read


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(F.lit("hp:"), F.lit(""), F.lit("x:")), (F.col("doc_id") % 3 + 1).cast("int"))

    def tag(name, body=None, attrs=""):
        head = F.concat(F.lit("<"), q, F.lit(f"{name}{attrs}" if isinstance(attrs, str) else name), F.lit("") if isinstance(attrs, str) else attrs)
        return F.concat(head, F.lit("/>")) if body is None else F.concat(head, F.lit(">"), body, F.lit("</"), q, F.lit(f"{name}>"))

    def line(x, i):
        w = F.split(x, " ")
        word = lambda k: T.escape_html(F.coalesce(F.get(w, F.lit(k)), F.lit("")))
        para = lambda body: tag("p", tag("run", body, ' charPrIDRef="3"'), ' id="0" paraPrIDRef="2"')
        span = F.when(i % 10 == 3, '" rowSpan="1" colSpan="2"').otherwise('" rowSpan="1" colSpan="1"')
        cell = lambda r, c, body, span=F.lit('"'): tag("tc", F.concat(tag("cellAddr", None, f' colAddr="{c}" rowAddr="{r}"'), tag("cellSpan", None, F.concat(F.lit(' x="'), span)), tag("subList", body), tag("cellSz", None, ' width="70" height="9"')))
        inner = tag("tbl", tag("tr", tag("tc", para(tag("t", word(1))))))
        first = F.concat(para(tag("t", word(0))), F.when(i % 25 == 8, para(inner)).otherwise(F.lit("")))
        table = tag("tbl", F.concat(tag("sz", None, ' width="90" height="20"'), tag("tr", F.concat(cell(0, 0, first, span), cell(0, 1, para(tag("t", word(1)))))), tag("tr", F.concat(cell(1, 0, para(tag("t", word(2)))), cell(1, 1, tag("p"))))))
        text = F.concat(tag("run", tag("t", T.escape_html(x)), F.lit(' charPrIDRef="3"')))
        image = tag("run", tag("pic", tag("img", None, F.concat(F.lit(' binaryItemIDRef="BIN'), (i % 4).cast("string"), F.lit('"')))))
        return F.when(i % 5 == 3, tag("p", tag("run", table, ' charPrIDRef="1"'))).otherwise(tag("p", F.concat(text, F.when(i % 11 == 7, F.concat(image, image)).otherwise("")), ' id="0" paraPrIDRef="2"'))

    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n")
    xml = F.concat(F.lit('<?xml version="1.0"?><!-- one <p> -->'), tag("sec", body))
    xml = F.when(F.col("doc_id") % 10 == 9, F.substring(xml, F.lit(1), F.length(xml) - 4)).otherwise(xml)
    return _read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("section_index"), xml.alias("xml"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.read(_sections(spark, sf_dir))[0]


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LINES = f"""ln AS (SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS section_index, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
lw AS (SELECT *, {_TRIM.format("line")} AS bare, i % 5 = 3 AS is_table, i % 25 = 8 AS deep, i % 10 = 3 AS wide, coalesce(string_split(line, ' ')[1], '') AS w1, coalesce(string_split(line, ' ')[2], '') AS w2, coalesce(string_split(line, ' ')[3], '') AS w3 FROM ln),
wd AS (SELECT doc_id, section_index, i, bare, is_table, deep, wide, {_TRIM.format("w1")} AS w1, {_TRIM.format("w2")} AS w2, {_TRIM.format("w3")} AS w3 FROM lw),
ok AS (SELECT * FROM wd WHERE doc_id % 10 <> 9)"""
_C1 = "CASE WHEN deep THEN trim(w1 || ' ' || w2) ELSE w1 END"
_ROW1 = f"CASE WHEN wide THEN {_C1} ELSE {_C1} || chr(9) || w2 END"


@_query(f"""WITH {_LINES}, b AS (SELECT doc_id, section_index, i, 0 AS part, 'text' AS kind, bare AS text, NULL AS rows, NULL AS bin_ref, '2' AS para_ref, '3' AS char_ref FROM ok WHERE NOT is_table AND bare <> ''
  UNION ALL SELECT doc_id, section_index, i, 1, 'image', NULL, NULL, 'BIN' || i % 4, NULL, NULL FROM ok WHERE NOT is_table AND i % 11 = 7
  UNION ALL SELECT doc_id, section_index, i, 0, 'table', NULL, concat_ws(chr(10), CASE WHEN w1 <> '' OR w2 <> '' AND (NOT wide OR deep) THEN {_ROW1} END, CASE WHEN w3 <> '' THEN w3 || chr(9) END), NULL, NULL, NULL FROM ok WHERE is_table)
SELECT doc_id, section_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS INTEGER) AS ord, kind, text, rows, bin_ref, para_ref, char_ref FROM b""")
def markup_blocks(spark, sf_dir):
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")
    return M.blocks(_rows(spark, sf_dir)).select("doc_id", "section_index", "ord", "kind", "text", F.when(F.col("kind") == "table", rows).alias("rows"), "bin_ref", "para_ref", "char_ref")


@_query(f"""WITH {_LINES}, b AS (SELECT doc_id, section_index, i, 'text' AS kind, bare AS text, '2' AS para_ref, NULL AS width, NULL AS height, NULL AS cells FROM ok WHERE NOT is_table AND bare <> ''
  UNION ALL SELECT doc_id, section_index, i, 'table', NULL, NULL, 90, 20, CASE WHEN wide THEN c1 || ':70:9:1:2' ELSE c1 || ':70:9:1:1' || chr(9) || w2 || ':70:9:1:1' END || chr(10) || w3 || ':70:9:1:1' || chr(9) || ':70:9:1:1'
    FROM (SELECT *, CASE WHEN deep THEN trim(w1 || chr(10) || w2, chr(10)) ELSE w1 END AS c1 FROM ok WHERE is_table))
SELECT doc_id, section_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS ord, kind, text, para_ref, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, cells FROM b""")
def markup_paragraphs(spark, sf_dir):
    cell = lambda c: F.concat_ws(":", c["text"], *[c[k].cast("string") for k in ("width", "height", "rowspan", "colspan")])
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(F.transform(r, cell), "\t")), "\n")
    return M.paragraph_blocks(_rows(spark, sf_dir)).withColumn("cells", cells)


@_query(f"""WITH {_LINES}, r AS (SELECT doc_id, i, CASE WHEN is_table THEN CASE WHEN deep THEN trim(concat_ws(' ', nullif(w1, ''), nullif(w2, ''), nullif(w2, ''))) ELSE w1 END || ' | ' || w2 || chr(10) || w3 || ' | ' || CASE WHEN deep THEN chr(10) || w2 ELSE '' END WHEN bare <> '' THEN line END AS s
  FROM (SELECT ok.*, l.line FROM ok JOIN ln l USING (doc_id, i)))
SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY i), '') AS plain FROM r WHERE s IS NOT NULL GROUP BY doc_id""")
def markup_text(spark, sf_dir):
    return M.reader_text(M.reader_blocks(_rows(spark, sf_dir)))


# Sections that can't be read: the reason, and what a pattern finds in them; of prefixes it knows one.
@_query(r"""WITH d AS (SELECT doc_id, doc_id % 3 AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents WHERE doc_id % 10 = 9),
e AS (SELECT *, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS y FROM (SELECT *, unnest(CASE WHEN i % 5 = 3 THEN
    CASE WHEN i % 25 = 8 THEN [coalesce(string_split(line, ' ')[1], ''), coalesce(string_split(line, ' ')[2], ''), coalesce(string_split(line, ' ')[2], ''), coalesce(string_split(line, ' ')[3], '')] ELSE [coalesce(string_split(line, ' ')[1], ''), coalesce(string_split(line, ' ')[2], ''), coalesce(string_split(line, ' ')[3], '')] END ELSE [line] END) AS x,
  generate_subscripts(CASE WHEN i % 5 = 3 THEN CASE WHEN i % 25 = 8 THEN [1, 2, 3, 4] ELSE [1, 2, 3] END ELSE [1] END, 1) AS part FROM d)),
f AS (SELECT doc_id, k, i, part, trim(regexp_replace(regexp_replace(y, '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g')) AS z FROM e),
g AS (SELECT doc_id, k, i, part, CASE WHEN length(z) <= 40 THEN '<h2>' || replace(replace(z, '&', '&amp;'), '''', '&#39;') || '</h2>' ELSE '<p>' || replace(replace(z, '&', '&amp;'), '''', '&#39;') || '</p>' END AS h FROM f WHERE z <> ''),
n AS (SELECT DISTINCT doc_id, k FROM d)
SELECT n.doc_id, 'markup' AS stage, 'stray sign' AS reason, CASE WHEN n.k = 2 THEN '' ELSE coalesce(string_agg(h, chr(10) ORDER BY i, part), '') END AS shown FROM n LEFT JOIN g USING (doc_id) GROUP BY n.doc_id, n.k""")
def markup_errors(spark, sf_dir):
    sections = _sections(spark, sf_dir)
    return M.errors(M.tokens(sections)).join(sections, ["doc_id", "section_index"]).select("doc_id", "stage", "reason", M.plain_paragraphs(F.col("xml")).alias("shown"))
