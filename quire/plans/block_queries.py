"""Queries over blocks, tables, elements, packages and file names.

The lines of reports are blocks: every fifth is a table of its first words, some are images. Line items are cells of tables and
elements of sections, parts and orders are files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import config
from quire.functions import files as N
from quire.functions import settings as V
from quire.functions import text as T
from quire.operators import audits as A
from quire.operators import blocks as B
from quire.operators import intake as K
from quire.operators import pages as H
from quire.operators import sections as S
from quire.plans.base import _query, _read
from quire.plans.views import _LINES, _reports


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, w = F.col("ord"), F.split("line", " ")
    word = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    kind = F.when(i % 5 == 3, "table").when(i % 11 == 7, "image").otherwise("text")
    lines = S.lines(_reports(spark, sf_dir))
    rows = lines.select("doc_id", "ord", F.floor(i / 7).cast("int").alias("section_index"), kind.alias("kind"), F.col("line").alias("text"), F.array(F.array(word(0), word(1)), F.array(F.concat(word(2), F.lit("|")))).alias("rows"))
    return rows.withColumn("rows", F.when(F.col("kind") == "table", F.col("rows")).otherwise(F.array().cast("array<array<string>>")))


_BLOCKS = _LINES + """, blk AS (SELECT doc_id, CAST(ord AS INTEGER) AS ord, CAST(ord // 7 AS INTEGER) AS section_index, CASE WHEN ord % 5 = 3 THEN 'table' WHEN ord % 11 = 7 THEN 'image' ELSE 'text' END AS kind, line AS text,
  coalesce(string_split(line, ' ')[1], '') AS w1, coalesce(string_split(line, ' ')[2], '') AS w2, coalesce(string_split(line, ' ')[3], '') || '|' AS w3 FROM lines),
cl AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, trim(text, ' ' || chr(9) || chr(13)) AS bare FROM blk)"""


@_query(f"""WITH {_BLOCKS}, p AS (SELECT doc_id, ord, CASE WHEN kind = 'text' AND flat <> '' THEN flat || chr(10) WHEN kind = 'table' THEN '| ' || trim(w1) || ' | ' || trim(w2) || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(w3) || ' |  |' || chr(10) END AS s FROM cl)
SELECT doc_id, regexp_replace(coalesce(string_agg(s, chr(10) ORDER BY ord), ''), '^\\s+|\\s+$', '', 'g') AS md FROM p GROUP BY doc_id""")
def block_markdown(spark, sf_dir):
    return B.to_markdown(_blocks(spark, sf_dir))


@_query(f"""WITH {_BLOCKS}, p AS (SELECT doc_id, ord, CASE WHEN kind = 'text' AND bare <> '' THEN bare WHEN kind = 'table' THEN CASE WHEN trim(w1) <> '' OR trim(w2) <> '' THEN trim(w1) || chr(9) || trim(w2) || chr(10) ELSE '' END || trim(w3) END AS s FROM cl)
SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY ord), '') AS plain FROM p GROUP BY doc_id""")
def block_text(spark, sf_dir):
    return B.to_plain_text(_blocks(spark, sf_dir))


@_query(f"""WITH {_BLOCKS}, f AS (SELECT *, min(CASE WHEN kind = 'text' AND length(bare) > 6 THEN ord END) OVER (PARTITION BY doc_id) AS first FROM cl),
p AS (SELECT doc_id, ord, CASE WHEN kind = 'text' AND bare <> '' THEN CASE WHEN ord = first THEN '# ' || bare WHEN regexp_matches(bare, '^([0-9]+[.]\\s|[가-힣][.]\\s|붙임|【|<)') THEN '## ' || bare WHEN regexp_matches(bare, '^[-□◈▪▶●◦❍∘·*]\\s?') THEN '- ' || regexp_replace(bare, '^[-□◈▪▶●◦❍∘·*]\\s?', '') ELSE bare END
  WHEN kind = 'table' THEN '| ' || replace(trim(w1), '|', '\\|') || ' | ' || replace(trim(w2), '|', '\\|') || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(trim(w3), '|', '\\|') || ' |  |' END AS s FROM f)
SELECT doc_id, coalesce(string_agg(s, chr(10) || chr(10) ORDER BY ord), '') AS md FROM p GROUP BY doc_id""")
def block_display(spark, sf_dir):
    return B.to_display_markdown(_blocks(spark, sf_dir))


@_query(f"""WITH {_BLOCKS} SELECT doc_id, count(DISTINCT section_index) AS section_count, CAST(count_if(kind = 'text') AS BIGINT) AS paragraph_count, CAST(count_if(kind = 'table') AS BIGINT) AS table_count,
  CAST(sum(CASE kind WHEN 'text' THEN length(text) WHEN 'table' THEN length(w1) + length(w2) + length(w3) ELSE 0 END) AS BIGINT) AS total_chars FROM blk GROUP BY doc_id""")
def block_statistics(spark, sf_dir):
    return B.statistics(_blocks(spark, sf_dir))


_CASES = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for p, n in config.LINE_CLASSES)


@_query(f"""WITH {_BLOCKS}, m AS (SELECT *, CASE ord % 9 WHEN 1 THEN '□' WHEN 3 THEN '○' WHEN 4 THEN '▪' WHEN 5 THEN '※' WHEN 6 THEN '붙임' ELSE '' END || text AS t FROM blk), f AS (SELECT doc_id, ord, kind, t AS text,
  min(CASE WHEN kind = 'text' AND length(t) > 8 AND NOT regexp_matches(t, '{config.NO_TITLE}') THEN ord END) OVER (PARTITION BY doc_id) AS first FROM m) SELECT doc_id, ord, CASE WHEN ord = first THEN 'doc-title' {_CASES} ELSE 'line' END AS class FROM f WHERE kind = 'text'""")
def line_classes(spark, sf_dir):
    mark, i = F.lit(""), F.col("ord") % 9
    for k, m in ((1, "□"), (3, "○"), (4, "▪"), (5, "※"), (6, "붙임")):
        mark = F.when(i == k, m).otherwise(mark)
    b = _blocks(spark, sf_dir).withColumn("text", F.concat(mark, "text"))
    return B.with_line_class(b).filter("kind = 'text'").select("doc_id", "ord", "class")


@_query(f"""WITH {_BLOCKS}, x AS (SELECT doc_id, ord, w1, w2, doc_id % 3 AS k FROM blk WHERE kind = 'table')
SELECT doc_id, ord, CASE WHEN k = 0 AND w1 <> '' AND length(w1) <= 80 THEN 'title' WHEN k = 1 THEN 'restoration' END AS class FROM x""")
def table_classes(spark, sf_dir):
    k, first = F.col("doc_id") % 3, F.get(F.get("rows", F.lit(0)), F.lit(0))
    rows = F.when(k == 0, F.array(F.array(first))).when(k == 1, F.array(F.array(first, F.lit("복원  전")), F.array(first))).otherwise(F.col("rows"))
    return _blocks(spark, sf_dir).filter("kind = 'table'").select("doc_id", "ord", B.table_class(rows).alias("class"))


# Each line item refers to one of three images; a paragraph is two of them.
@_query("""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linenumber // 2 AS paragraph, min(l_partkey) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, ['BIN1', 'BIN2', ''][p % 3 + 1] AS bin_ref FROM i)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, CAST(min(ord) AS INTEGER) AS ord, bin_ref FROM r WHERE bin_ref <> '' GROUP BY doc_id, paragraph, bin_ref""")
def image_references(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"))
    rows = li.select("doc_id", "ord", F.floor(F.col("ord") / 2).cast("int").alias("paragraph"), F.element_at(F.array(F.lit("BIN1"), F.lit("BIN2"), F.lit("")), (F.col("p") % 3 + 1).cast("int")).alias("bin_ref"))
    return B.distinct_images(rows).select("doc_id", "paragraph", "ord", "bin_ref")


# Nations are documents with styles, customers their paragraphs; some refer to a style that is not there.
@_query("""WITH st AS (SELECT n_nationkey AS doc_id, CAST(k AS VARCHAR) AS id, n_name || k AS font, k * 2 AS size FROM nation, (VALUES (0), (1), (2)) v(k) WHERE NOT (n_nationkey % 5 = 0 AND k = 0)),
p AS (SELECT c_custkey, c_nationkey AS doc_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS VARCHAR) END AS ref FROM customer)
SELECT c_custkey, coalesce(a.font, z.font) AS char_font, coalesce(a.size, z.size) AS char_size FROM p LEFT JOIN st a ON a.doc_id = p.doc_id AND a.id = coalesce(p.ref, '0') LEFT JOIN st z ON z.doc_id = p.doc_id AND z.id = '0'""")
def paragraph_styles(spark, sf_dir):
    k = F.col("k")
    st = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).filter(~((F.col("n_nationkey") % 5 == 0) & (k == 0)))
    st = st.select(F.col("n_nationkey").alias("doc_id"), k.cast("string").alias("id"), F.concat("n_name", k).alias("font"), (k * 2).alias("size"))
    p = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("doc_id"), F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 5).cast("string")).alias("ref"))
    return B.with_styles(p, st, "ref", "char_").select("c_custkey", "char_font", "char_size")


# Line items as cells: an order is a document, its status flags are tables.
def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    p = F.col("p")
    cells = li.select("doc_id", (p % 2).cast("int").alias("table_ord"), F.floor(F.col("n") / 3).cast("int").alias("r"), (F.col("n") % 3 % 2).cast("int").alias("c"), (p % 4 * 100).cast("long").alias("width"), "p")
    tables = cells.groupBy("doc_id", "table_ord").agg(F.min("p").alias("p"), F.count("*").alias("k")).select(
        "doc_id", "table_ord", (p % 3).cast("string").alias("table_id"), F.when(p % 5 != 0, p % 4 * 100).alias("width"), (p % 6 != 0).alias("inline"))
    segments = li.select("doc_id", (p % 3 % 2).cast("int").alias("children"))
    return tables, cells.drop("p"), segments


_TABLES = """li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
cells AS (SELECT doc_id, p % 2 AS table_ord, n // 3 AS r, n % 3 % 2 AS c, p % 4 * 100 AS width, p FROM li),
tabs AS (SELECT doc_id, table_ord, CAST(min(p) % 3 AS VARCHAR) AS table_id, CASE WHEN min(p) % 5 <> 0 THEN min(p) % 4 * 100 END AS width, min(p) % 6 <> 0 AS inline FROM cells GROUP BY ALL),
twice AS (SELECT doc_id, table_id FROM tabs GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT c.doc_id, c.table_ord, sum(c.width) AS s, any_value(t.width) AS t FROM cells c JOIN tabs t USING (doc_id, table_ord) WHERE t.width IS NOT NULL AND c.r = (SELECT min(r) FROM cells x WHERE x.doc_id = c.doc_id AND x.table_ord = c.table_ord) GROUP BY ALL),
damage AS (SELECT doc_id, 'repeated id' AS rule, string_agg(table_id, ',' ORDER BY table_id) AS detail FROM twice GROUP BY doc_id UNION ALL SELECT doc_id, 'origins', table_ord || ':' || count(*) FROM cells WHERE r = 0 AND c = 0 GROUP BY doc_id, table_ord HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'width', table_ord || ':' || s || ':' || t FROM w WHERE s <> 0 AND s <> t)"""


@_query(f"WITH {_TABLES} SELECT * FROM damage")
def table_damage(spark, sf_dir):
    return A.validate(*_tables(spark, sf_dir), pre_bake=False)


@_query(f"WITH {_TABLES} SELECT * FROM damage UNION ALL SELECT doc_id, 'line segments', CAST(count(*) AS VARCHAR) FROM li WHERE p % 3 % 2 > 0 GROUP BY doc_id UNION ALL SELECT doc_id, 'floating', CAST(count(*) AS VARCHAR) FROM tabs WHERE NOT inline GROUP BY doc_id")
def validate_tables(spark, sf_dir):
    return A.validate(*_tables(spark, sf_dir))


# Line items as entries of a package.
_ENTRY = ["mimetype", "META-INF/container.xml", "META-INF/manifest.xml", "version.xml", "settings.xml", "Contents/header.xml", "Contents/content.hpf", "Contents/section0.xml", "Contents/Section1.XML", "other"]


@_query(f"""WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY ALL), n AS (SELECT *, CASE WHEN ord = 1 AND p % 3 <> 0 THEN 'mimetype' ELSE {_ENTRY}[p % 10 + 1] END AS name, p % 4 % 3 AS method FROM e),
d AS (SELECT doc_id, list(DISTINCT name) AS has, arg_min(name, ord) AS first, min(method) FILTER (WHERE name = 'mimetype') AS method, count(*) FILTER (WHERE regexp_matches(name, '(?i)^Contents/section\\d+\\.xml$')) AS s FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN list_contains(has, q) THEN 'ok' ELSE 'warn' END AS level, q AS title, '' AS detail FROM d, (SELECT unnest({list(config.REQUIRED_ENTRIES)}) AS q)
UNION ALL SELECT doc_id, CASE WHEN first = 'mimetype' AND method = 0 THEN 'ok' ELSE 'warn' END, 'packaging', '' FROM d WHERE list_contains(has, 'mimetype') UNION ALL SELECT doc_id, CASE WHEN s > 0 THEN 'ok' ELSE 'warn' END, 'sections', CAST(s AS VARCHAR) FROM d""")
def package_audit(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"))
    p = F.col("p")
    name = F.when((F.col("ord") == 1) & (p % 3 != 0), "mimetype").otherwise(F.element_at(F.array(*map(F.lit, _ENTRY)), (p % 10 + 1).cast("int")))
    return A.audit_package(li.select("doc_id", "ord", name.alias("name"), (p % 4 % 3).cast("int").alias("method")))


# Line items as elements of sections and of style groups.
_ELEMENT = ["p", "tbl", "ctrl", "linesegarray", "textBox", "run", "t", "t", "charPr", "paraPr", "borderFill", "p"]


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).alias("doc_id"), (F.col("l_orderkey") % 2).cast("int").alias("section"), "l_partkey")
    p = F.col("l_partkey")
    name = F.element_at(F.array(*map(F.lit, _ELEMENT)), (p % 12 + 1).cast("int"))
    group = F.when(name == "charPr", "charProperties").when(name == "paraPr", "paraProperties").when((name == "borderFill") & (p % 5 != 0), "borderFills")
    return li.select("doc_id", "section", name.alias("name"), (p % 7 == 0).alias("container"), F.when(p % 24 == 0, "- ").otherwise("x").alias("text"), group.alias("group"))


_ELEMENTS = f"""el AS (SELECT l_orderkey // 4 AS doc_id, CAST(l_orderkey % 2 AS INTEGER) AS section, {_ELEMENT}[l_partkey % 12 + 1] AS name, l_partkey % 7 = 0 AS container, CASE WHEN l_partkey % 24 = 0 THEN '- ' ELSE 'x' END AS text, l_partkey AS p FROM lineitem),
gp AS (SELECT *, CASE WHEN name = 'charPr' THEN 'charProperties' WHEN name = 'paraPr' THEN 'paraProperties' WHEN name = 'borderFill' AND p % 5 <> 0 THEN 'borderFills' END AS grp FROM el),
sc AS (SELECT doc_id, section, count(*) FILTER (WHERE name = 'p') AS paragraphs, count(*) FILTER (WHERE name = 'tbl') AS tables, count(*) FILTER (WHERE name = 'ctrl') AS controls, count(*) FILTER (WHERE name = 'linesegarray') AS line_segments, count(*) FILTER (WHERE name = 'textBox') AS text_boxes,
  count(*) FILTER (WHERE name = 'run') AS runs, count(*) FILTER (WHERE name = 't') AS texts, count(*) FILTER (WHERE name = 'p' AND container) AS containers, count(*) FILTER (WHERE name = 'p' AND text = '- ') AS empty_bullets FROM el GROUP BY ALL)"""


@_query(f"WITH {_ELEMENTS} SELECT * FROM sc")
def section_structure(spark, sf_dir):
    return A.structure_counts(_elements(spark, sf_dir))


_AUDIT = """SELECT doc_id, section, 'ok' AS level, 'leaf paragraphs' AS title, CAST(containers AS VARCHAR) AS detail FROM sc WHERE containers > 0 UNION ALL SELECT doc_id, section, 'info', 'tables', CAST(tables AS VARCHAR) FROM sc WHERE tables > 0
UNION ALL SELECT doc_id, section, 'warn', 'fixed objects', CAST(controls + text_boxes AS VARCHAR) FROM sc WHERE controls + text_boxes > 0 UNION ALL SELECT doc_id, section, 'info', 'line segments', CAST(line_segments AS VARCHAR) FROM sc WHERE line_segments > 0
UNION ALL SELECT doc_id, section, 'info', 'empty bullets', CAST(empty_bullets AS VARCHAR) FROM sc WHERE empty_bullets > 0 UNION ALL SELECT doc_id, section, 'info', 'split runs', CAST(texts AS VARCHAR) FROM sc WHERE runs > 0 AND texts / runs > 1.8"""


@_query(f"WITH {_ELEMENTS} {_AUDIT}")
def section_audit(spark, sf_dir):
    return A.audit_sections(_elements(spark, sf_dir))


@_query(f"WITH {_ELEMENTS}, au AS ({_AUDIT}) SELECT doc_id, count(*) FILTER (WHERE level = 'warn') AS warnings FROM au GROUP BY doc_id")
def audit_warnings(spark, sf_dir):
    return A.warnings(A.audit_sections(_elements(spark, sf_dir)))


@_query("WITH " + _ELEMENTS + ' SELECT doc_id, count(*) FILTER (WHERE name = \'charPr\') AS "charPr", count(*) FILTER (WHERE name = \'paraPr\') AS "paraPr", count(*) FILTER (WHERE name = \'borderFill\') AS "borderFill" FROM el GROUP BY doc_id')
def style_counts(spark, sf_dir):
    return A.style_counts(_elements(spark, sf_dir))


@_query(f"""WITH {_ELEMENTS}, g AS (SELECT doc_id, name, child, CASE WHEN doc_id % 3 = 0 AND name = 'borderFills' THEN NULL ELSE doc_id % 4 END AS declared FROM (SELECT DISTINCT doc_id FROM el), (VALUES ('charProperties', 'charPr'), ('paraProperties', 'paraPr'), ('borderFills', 'borderFill')) v(name, child))
SELECT doc_id, CASE WHEN declared = n THEN 'ok' ELSE 'warn' END AS level, name || ' itemCnt' AS title, declared || ':' || n AS detail FROM (SELECT g.*, (SELECT count(*) FROM gp WHERE gp.doc_id = g.doc_id AND gp.grp = g.name) AS n FROM g WHERE declared IS NOT NULL)""")
def style_group_audit(spark, sf_dir):
    e = _elements(spark, sf_dir)
    names = F.explode(F.array(*map(F.lit, config.STYLE_GROUPS))).alias("name")
    groups = e.select("doc_id").distinct().select("doc_id", names).withColumn("declared", F.when(~((F.col("doc_id") % 3 == 0) & (F.col("name") == "borderFills")), F.col("doc_id") % 4))
    return A.audit_groups(groups, e)


@_query(f"""WITH {_ELEMENTS}, n AS (SELECT doc_id, count(*) FILTER (WHERE name = 'charPr') AS a, count(*) FILTER (WHERE name = 'paraPr') AS b, count(*) FILTER (WHERE name = 'borderFill') AS c FROM el GROUP BY doc_id)
SELECT doc_id, 'ok' AS level, 'header styles' AS title, a || ':' || b || ':' || c AS detail FROM n UNION ALL SELECT doc_id, 'info', 'style references', '' FROM n""")
def header_audit(spark, sf_dir):
    return A.audit_header(_elements(spark, sf_dir))


# Names and bytes of files, from parts and documents.
_PATHS = "paths AS (SELECT p_partkey, '/in/' || p_name || ['.hwpx', '.HWP', '.docx', '.pdf', '.md', '.TXT', '.doc', '', '.bak'][p_partkey % 9 + 1] AS path FROM part)"
_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".hwpx", ".HWP", ".docx", ".pdf", ".md", ".TXT", ".doc", "", ".bak"))), (F.col("p_partkey") % 9 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/"), "p_name", ext).alias("path"))


@_query(f"""WITH {_PATHS} SELECT p_partkey, CASE WHEN {_EXT} IN ('hwpx', 'hwp', 'docx', 'pdf', 'md', 'txt') THEN {_EXT} ELSE 'txt' END AS format, CASE WHEN {_EXT} IN ('hwpx', 'hwp', 'docx', 'pdf', 'md', 'txt') THEN {_EXT} END AS upload,
  CASE WHEN {_EXT} IN ('docx', 'doc', 'hwpx', 'hwp', 'pdf') THEN {_EXT} END AS preview, CASE p_partkey % 4 WHEN 0 THEN 'hwpx' WHEN 1 THEN 'hwp' ELSE CASE WHEN {_EXT} = 'hwpx' THEN 'hwpx' ELSE 'hwp' END END AS magic FROM paths""")
def file_formats(spark, sf_dir):
    k, path = F.col("p_partkey") % 4, F.col("path")
    content = F.when(k == 0, F.unhex(F.lit("504B0304"))).when(k == 1, F.unhex(F.lit("D0CF11E0A1"))).otherwise(F.unhex(F.lit("00")))
    return _paths(spark, sf_dir).select("p_partkey", N.format_of(path).alias("format"), N.upload_format(path).alias("upload"), N.upload_format(path, True).alias("preview"), N.format_by_magic(content, path).alias("magic"))


_HEADS = [("EFBBBF41", "utf-8"), ("FFFE4100", "utf-16le"), ("FEFF0041", "utf-16be"), ("3C003F0078006D00", "utf-16le"), ("003C003F0078006D", "utf-16be"), ("41", "utf-8")]
_DECLARED = {"UTF_8": "utf-8", "cp949": "euc-kr", "ks_c_5601-1987": "euc-kr", "UTF16": "utf-16le", "Big5": "big5"}
_SNIFFED = [*_HEADS, *((f'<?xml version="1.0" encoding="{k}"?>'.encode().hex(), v) for k, v in _DECLARED.items())]


# Documents as bytes: with marks, in two bytes a character without a mark, plain, or after a declaration.
@_query(f"SELECT doc_id, {[v for _, v in _SNIFFED]}[doc_id % {len(_SNIFFED)} + 1] AS encoding FROM documents")
def encodings(spark, sf_dir):
    k = F.col("doc_id") % len(_SNIFFED)
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h, _ in _SNIFFED]), (k + 1).cast("int")))
    text = F.coalesce("text", F.lit(""))
    body = F.when(k.isin(1, 3), F.encode(text, "UTF-16LE")).when(k.isin(2, 4), F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8"))
    return _read(spark, sf_dir, "documents").select("doc_id", N.sniff_encoding(F.concat(head, body)).alias("encoding"))


@_query("SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS md FROM documents")
def plain_files(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 == 0, "a.MD").when(F.col("doc_id") % 3 == 1, "b.txt").otherwise("note")
    return _read(spark, sf_dir, "documents").select("doc_id", N.plain_text(F.encode("text", "UTF-8"), path).alias("md"))


@_query("SELECT event_id, event_type || chr(9) || 'x' || chr(10) || event_type AS text FROM events")
def paragraph_payloads(spark, sf_dir):
    u = lambda c: F.encode(c, "UTF-16LE")
    unit = lambda *codes: F.unhex(F.lit("".join(c.to_bytes(2, "little").hex() for c in codes)))
    payload = F.concat(unit(11, 5, 5, 5, 5, 5, 5, 11), u(F.col("event_type")), unit(9, 0, 0, 0, 0, 0, 0, 9), unit(24), u(F.lit("x")), unit(13), u(F.col("event_type")))
    return _read(spark, sf_dir, "events").select("event_id", N.paragraph_text(payload).alias("text"))


_PAGES = "pg AS (SELECT page_id, html FROM pages)"


@_query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS short,
  substr(regexp_replace(regexp_replace(url, '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', '_', 'g'), 1, 90) AS name, regexp_replace(url, '[^\\pL\\pN._-]', '_', 'g') AS plain, CAST((length(html) - length(replace(html, '<p', ''))) // 2 AS BIGINT) AS paragraphs FROM pages""")
def page_names(spark, sf_dir):
    html, url = F.col("html"), F.col("url")
    return _read(spark, sf_dir, "pages").select("page_id", T.escape_html(html).alias("escaped"), T.escape_html(html, False).alias("short"), T.safe_name(url).alias("name"), T.plain_name(url).alias("plain"), T.count_of(html, "<p").alias("paragraphs"))


@_query("""WITH d AS (SELECT doc_id, regexp_replace(text, '[&<>]', '', 'g') AS t FROM documents)
SELECT doc_id, '<b> & ' || trim(regexp_replace(t, '\\s+', ' ', 'g')) AS line FROM d WHERE trim(t) <> ''""")
def clean_lines(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[&<>]", "").alias("t")).filter(F.trim("t") != "")
    return d.select("doc_id", T.clean(F.concat(F.lit(" &lt;b&gt;&nbsp;&#38; \t\n"), "t")).alias("line"))


@_query("""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(array_to_string([regexp_replace(x, '\\s+$', '') for x in l], chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS reply FROM d""")
def clean_replies(spark, sf_dir):
    noisy = F.array_join(F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: F.concat(F.lit("Reading: a\n"), x)), "\nOutput: b\n")
    return _read(spark, sf_dir, "documents").select("doc_id", T.clean_reply(noisy, config.STATUS_PREFIXES).alias("reply"))


# Every line of every document, behind one of five marks; the sentences of a line are lines too, as whole lines are mostly too long.
@_query("""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.]\\s|\\n')) AS t, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[.]\\s|\\n'), 1) - 1 AS i FROM documents),
h AS (SELECT doc_id, i, ['1. ', '가. ', '□', '[a] ', 'x'][(doc_id + i) % 5 + 1] || t AS t FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS i, length(t) <= 40 AND (regexp_matches(t, '^(\\s*(\\d+\\.|[가-힣]\\.|[ⅠⅡⅢⅣⅤ]+\\.|[【\\[].+[】\\]])\\s*)\\S') OR regexp_matches(t, '^[□■▣]')) AS heading FROM h""")
def headings(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.]\\s|\n")).alias("i", "t"))
    mark = F.element_at(F.array(*map(F.lit, ("1. ", "가. ", "□", "[a] ", "x"))), ((F.col("doc_id") + F.col("i")) % 5 + 1).cast("int"))
    return lines.select("doc_id", "i", T.looks_like_heading(F.concat(mark, "t")).alias("heading"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN false ELSE (p_partkey * 7 % 256) * 0.299e0 + (p_partkey * 5 % 256) * 0.587e0 + (p_partkey * 3 % 256) * 0.114e0 < 100 END AS dark, CAST(round(p_size * 283.465e0) AS BIGINT) AS units,
  CASE WHEN p_size % 4 = 0 THEN 144000 ELSE p_size * 75 END AS org_w, CASE WHEN p_size % 4 = 0 THEN 81000 ELSE CAST((p_partkey % 50 + 1) * 75 AS BIGINT) END AS org_h, CAST(42520 AS BIGINT) AS disp_w,
  CASE WHEN p_size % 4 = 0 THEN 42520 * 81000 // 144000 ELSE CAST(42520 * (p_partkey % 50 + 1) * 75 // (p_size * 75) AS BIGINT) END AS disp_h FROM part""".replace("THEN 144000 ELSE p_size * 75 END", "THEN CAST(144000 AS BIGINT) ELSE CAST(p_size * 75 AS BIGINT) END").replace("THEN 81000 ELSE", "THEN CAST(81000 AS BIGINT) ELSE").replace("THEN 42520 * 81000 // 144000 ELSE", "THEN CAST(23917 AS BIGINT) ELSE"))
def colours_and_sizes(spark, sf_dir):
    k = F.col("p_partkey")
    hex2 = lambda f: F.lpad(F.hex(k * f % 256), 2, "0")
    colour = F.when(k % 9 == 0, "red").otherwise(F.concat(F.lit("#"), hex2(7), hex2(5), hex2(3)))
    size = T.size_on_page(F.when(F.col("p_size") % 4 != 0, F.col("p_size")).otherwise(0), (k % 50 + 1))
    return _read(spark, sf_dir, "part").select("p_partkey", T.is_dark(colour).alias("dark"), T.hwp_units(F.col("p_size")).alias("units"), size.alias("s")).select("p_partkey", "dark", "units", "s.*")


# Line items as entries again, with names of sections in other places.
_PLACES = ["Contents/section{}.xml", "other/Section{}.xml", "my_section{}a.xml", "Contents/header{}.xml", "section{}.xml"]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_partkey").alias("p"))
    place = F.element_at(F.array(*map(F.lit, _PLACES)), F.when(F.col("doc_id") % 4 == 0, F.col("p") % 2 + 2).otherwise(F.col("p") % 5).cast("int") + 1)
    return li.select("doc_id", F.replace(place, F.lit("{}"), (F.col("ord") * 5).cast("string")).alias("name"))


_NAMES = f"""nm AS (SELECT doc_id, replace({_PLACES}[CASE WHEN doc_id % 4 = 0 THEN p % 2 + 2 ELSE p % 5 END + 1], '{{}}', CAST(ord * 5 AS VARCHAR)) AS name FROM (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY ALL))"""


@_query(f"""WITH {_NAMES}, t AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)^contents/section\\d+\\.xml') THEN 1 WHEN regexp_matches(split_part(name, '/', -1), '(?i)^section\\d+\\.xml') THEN 2 WHEN ends_with(name, '.xml') AND contains(lower(name), 'section') THEN 3 END AS tier FROM nm),
m AS (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS least FROM t WHERE tier IS NOT NULL) SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY name) AS INTEGER) AS rank FROM m WHERE tier = least""")
def section_entries(spark, sf_dir):
    return A.section_entries(_entries(spark, sf_dir))


@_query(f"""WITH {_NAMES}, t AS (SELECT *, regexp_extract(name, '(?i)(^|/)section(\\d+)\\.xml$', 2) AS number FROM nm)
SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CAST(number AS BIGINT), name) - 1 AS INTEGER) AS section_index FROM t WHERE number <> ''""")
def numbered_sections(spark, sf_dir):
    return A.numbered_sections(_entries(spark, sf_dir))


# Documents and pages as files that arrive: names of many kinds, contents that fit them or don't, some in a Korean encoding.
_NAMED = ["a.md", "b.TXT", "c.docx", "d.pdf", "e.exe", "", "f.hwp", "g", "h.hwpx", "i.txt"]


@_query(f"""WITH f AS (SELECT doc_id, doc_id % 10 AS k, doc_id // 10 % 3 AS v, coalesce(text, '') AS t FROM documents)
SELECT doc_id, {_NAMED!r}[k + 1] AS path, CASE WHEN k IN (0, 1, 9) AND v < 2 THEN sha256(CASE WHEN v = 1 THEN '가나 다' ELSE regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') END) END AS text_sha256,
  CASE WHEN k IN (4, 5, 7) THEN 'upload' WHEN v = 2 OR k IN (2, 3, 6, 8) THEN 'read' END AS stage,
  CASE k WHEN 5 THEN 'no name' WHEN 4 THEN 'unknown format: e.exe' WHEN 7 THEN 'unknown format: g' ELSE CASE WHEN v = 2 THEN 'no content' WHEN k IN (2, 3, 6, 8) THEN CASE WHEN v = 0 THEN 'not a ' ELSE 'no reader of ' END || ['docx', 'pdf', '', '', 'hwp', '', 'hwpx'][k - 1] END END AS reason FROM f""")
def arrived_files(spark, sf_dir):
    k, v = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10) % 3
    head = F.when(k.isin(2, 8), "504B0304").when(k == 6, "D0CF11E0").when(k == 3, "25504446").otherwise("B0A1B3AA20B4D9")  # the last in EUC-KR
    content = F.when(v == 0, F.encode(F.coalesce("text", F.lit("")), "UTF-8")).when(v == 1, F.unhex(head))
    path = F.element_at(F.array(*map(F.lit, _NAMED)), (k + 1).cast("int"))
    files = _read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), content.alias("content"))
    return K.judged(files).select("doc_id", "path", F.sha2("text", 256).alias("text_sha256"), "stage", "reason")


_GUIDES = {"map": "A flat map.", "chart": "Bars only."}
_RULES = " || chr(10) || ".join("'" + r + "'" for r in config.PromptParts().rules)


# Turns as requests for images: labelled ones of known and unknown types, plain ones, empty ones.
@_query(f"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[\\[\\]]', '', 'g') AS t, (conv_id + turn) % 4 AS k FROM conversations), d AS (SELECT *, {"trim(t, ' ' || chr(9) || chr(10) || chr(13))"} AS b FROM c)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'A flat map.' || chr(10) || 'Visual purpose: ' || b || chr(10) WHEN 1 THEN 'go' || chr(10) || 'Content to depict: ' || b || chr(10) || 'Document context: topic' || chr(10) WHEN 2 THEN b || chr(10) || 'said' || chr(10) || 'Figure type: ' || role || chr(10) ELSE 'said' || chr(10) || 'Figure type: ' || role || chr(10) END || {_RULES} AS prompt FROM d""")
def image_prompts(spark, sf_dir):
    k, t, p = (F.col("conv_id") + F.col("turn")) % 4, F.regexp_replace("text", r"[\[\]]", ""), config.PromptParts()
    seed = F.when(k == 0, F.concat(F.lit(f"[{p.type}] chart [{p.type}]map\n[{p.purpose}]  "), t)).when(k == 1, F.concat(F.lit(f" [{p.direction}] go [{p.content}] "), t, F.lit(f" [{p.topic}] topic [{p.type}] other"))).when(k == 2, t)
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", V.image_prompt(seed, F.lit("said"), F.col("role"), _GUIDES).alias("prompt"))


# Pages as settings: a session's own, then those of two files, one of them with placeholders, comments and quotes.
@_query("""WITH p AS (SELECT page_id, page_id % 5 AS k, 'https://h' || page_id || '/x' AS u FROM pages)
SELECT page_id, CASE WHEN k = 0 THEN 'own' WHEN k = 4 THEN NULL ELSE u END AS url, CASE WHEN k = 2 THEN 'b' WHEN k = 4 THEN NULL ELSE 'c' END AS mode FROM p""")
def layered_settings(spark, sf_dir):
    k = F.col("page_id") % 5
    url = F.concat(F.lit("https://h"), "page_id", F.lit("/x//"))
    own = F.when(k == 0, F.map_from_arrays(F.array(F.lit("URL"), F.lit("MODE")), F.array(F.lit("own/"), F.lit(""))))
    one = F.when(k < 4, F.concat(F.lit("# URL=no\nURL={host}\r\n BASE = '"), url, F.lit("'\nMODE="), F.when(k == 2, "\"b\"").otherwise("")))
    two = F.when(k < 4, F.lit("MODE=c\nMODE=d\nnothing\n=x"))
    rows = _read(spark, sf_dir, "pages").select("page_id", V.layered(own, V.parsed(one), V.parsed(two)).alias("s"))
    return rows.select("page_id", V.setting(F.col("s"), "URL", "BASE").alias("url"), V.setting(F.col("s"), "MODE").alias("mode"))


_CHARS = [("0", 10.0, False, False, ""), ("1", 30.5, True, False, "#ff0000"), ("2", 5.0, False, True, "red")]
_PARAS = [("0", "center", 0.0, 0.0), ("1", "justify", 12.5, 40.0)]
_HTML_LINE = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')".format


# The blocks of documents as pages: styles by the line's number, every third image is missing, one section more than has blocks.
@_query(f"""WITH {_BLOCKS}, b AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'font-size:10.0pt' WHEN 1 THEN 'font-size:28pt;font-weight:700;color:#ff0000' ELSE 'font-size:7pt;font-style:italic' END || CASE ord % 2 WHEN 0 THEN ';text-align:center' ELSE ';margin-top:12.5pt;margin-bottom:30pt' END AS css,
  CASE WHEN length(bare) <= 40 AND regexp_matches(bare, '^(\\s*(\\d+\\.|[가-힣]\\.|[ⅠⅡⅢⅣⅤ]+\\.|[【\\[].+[】\\]])\\s*)\\S') THEN 'h3' ELSE 'p' END AS tag FROM cl),
p AS (SELECT doc_id, section_index, ord, CASE kind WHEN 'image' THEN CASE WHEN ord % 3 <> 0 THEN '{H.IMAGE[0]}x' || ord || '{H.IMAGE[1]}' END WHEN 'table' THEN '<table><tr><th>' || {_HTML_LINE("w1")} || '</th><th>' || {_HTML_LINE("w2")} || '</th></tr><tr><td>' || {_HTML_LINE("w3")} || '</td></tr></table>'
  ELSE CASE WHEN bare <> '' THEN '<' || tag || ' style="' || css || '">' || {_HTML_LINE("bare")} || '</' || tag || '>' END END AS s FROM b
  UNION ALL SELECT DISTINCT doc_id, section_index, -1, '{H.BREAK}' FROM blk WHERE section_index > 0 UNION ALL SELECT doc_id, max(section_index) + 1, -1, '{H.BREAK}' FROM blk GROUP BY doc_id)
SELECT doc_id, sha256('<!DOCTYPE html><html lang="ko"><head><meta charset="utf-8"><style>p{{margin:0}}</style></head><body>' || string_agg(s, '' ORDER BY section_index, ord) || '</body></html>') AS html_sha256 FROM p WHERE s IS NOT NULL GROUP BY doc_id""")
def section_pages(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    table = lambda rows, names: docs.select("doc_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])).alias("s")).select("doc_id", "s.*")
    styled = B.with_styles(blocks.withColumns({"char": (F.col("ord") % 3).cast("string"), "para": (F.col("ord") % 2).cast("string")}), table(_CHARS, ("id", "font_size", "bold", "italic", "color")), "char", "char_")
    styled = B.with_styles(styled, table(_PARAS, ("id", "align", "margin_top", "margin_bottom")), "para", "para_")
    rows = styled.withColumns({"style": H.style_attribute(), "src": F.when(F.col("ord") % 3 != 0, F.concat(F.lit("x"), "ord"))})
    last = blocks.groupBy("doc_id").agg((F.max("section_index") + 1).alias("section_index"))
    return H.to_html(rows, blocks.select("doc_id", "section_index").unionByName(last), "p{margin:0}").select("doc_id", F.sha2("html", 256).alias("html_sha256"))
