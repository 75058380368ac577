"""Queries over files of record streams.

An order is a stream, eight neighbouring order keys a file; its line items are the records. The data of a record is made from
the part as hex digits, the same in both engines; some streams are missing, empty, or have an unusual first record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import config
from quire.operators import streams as S
from quire.plans.base import _query, _read

NAMES = ("DocInfo", "BodyText/Section0", "BodyText/Section1", "BodyText/Section10", "BodyText/Section2", "MasterPage/MasterPage0", "FileHeader", "BodyText/Section3")
CONTROLS = ("secd", "cold", "hdr ", "ftr ", "tbl ", "zzzz", "revt", "qqqq")


def _files(spark: SparkSession, sf_dir: str, other: bool = False) -> tuple[DataFrame, DataFrame]:
    """(streams, records) of all files, or of a changed version of them."""
    skip = 13 if other else 11
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    key = lambda c: [F.floor(F.col(c) / 8).alias("file"), pick(NAMES, F.col(c) % 8).alias("stream")]
    streams = _read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % skip != 0).select(*key("o_orderkey"))
    li = _read(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % skip != 0).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = li.select(*key("l_orderkey"), F.col("l_linenumber").alias("ord"), "p").withColumn("i", F.row_number().over(Window.partitionBy("file", "stream").orderBy("ord")) - 1)
    p, i, doc = F.col("p"), F.col("i"), F.col("stream") == "DocInfo"
    tag = F.when(doc, F.when((i == 0) & (p % 5 != 0), 16).when((i == 1) & (p % 7 != 0), 17).otherwise(18 + p % 13)).otherwise(F.when((i == 0) & (p % 6 != 0), 50).otherwise(pick((50, 51, 54, 54, 58, 69), p % 6)))
    level = F.when(doc, F.when(p % 9 == 0, 1).otherwise(0)).otherwise(p % 7 % 4)
    rows = rows.withColumns({"tag": tag.cast("int"), "level": level.cast("int")})
    part = lambda k: F.concat(F.lit("0"), (F.floor(p / (k + 1)) % 3).cast("string"), F.lit("000000"))
    text = lambda c: F.lower(F.hex(F.encode(c, "UTF-8")))
    data = (
        F.when(F.col("tag") == 17, F.concat(*[part(k) for k in range(7)], F.when(p % 3 == 0, "").otherwise(part(7))))
        .when(F.col("tag") == 54, F.when(p % 10 == 0, "0100").otherwise(F.concat(text(pick(CONTROLS, F.floor(p / 7) % 8)), F.lit("0"), (p % 7).cast("string"))))
        .when(F.col("tag") == 69, F.when(p % 11 == 0, "01").otherwise(F.concat(F.lit("0"), (F.floor(p / 5) % 3).cast("string"), F.lit("00"))))
        .otherwise(text(p.cast("string")))
    )
    rows = rows.withColumn("d", data)
    if other:
        d = F.when(p % 19 == 0, F.concat("d", F.lit("ff"))).when(p % 5 == 1, F.concat(F.substr("d", F.lit(1), F.length("d") - 2), F.lit("ee"))).otherwise(F.col("d"))
        rows = rows.filter(p % 13 != 0).withColumns({"tag": F.when(p % 17 == 0, 0x99).otherwise(F.col("tag")), "level": F.col("level") + F.when(p % 23 == 0, 1).otherwise(0), "d": d})
    return streams, rows.select("file", "stream", "ord", "tag", "level", F.unhex("d").alias("data"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _view(skip: int, s: str) -> str:
    return f"""streams{s} AS (SELECT o_orderkey // 8 AS file, {_list(NAMES)}[o_orderkey % 8 + 1] AS stream FROM orders WHERE o_orderkey % {skip} <> 0),
base{s} AS (SELECT l_orderkey // 8 AS file, {_list(NAMES)}[l_orderkey % 8 + 1] AS stream, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem WHERE l_orderkey % {skip} <> 0 GROUP BY ALL),
num{s} AS (SELECT *, row_number() OVER (PARTITION BY file, stream ORDER BY ord) - 1 AS i FROM base{s}),
tag{s} AS (SELECT *, CASE WHEN stream = 'DocInfo' THEN CASE WHEN i = 0 AND p % 5 <> 0 THEN 16 WHEN i = 1 AND p % 7 <> 0 THEN 17 ELSE 18 + p % 13 END WHEN i = 0 AND p % 6 <> 0 THEN 50 ELSE [50, 51, 54, 54, 58, 69][p % 6 + 1] END AS tag,
  CASE WHEN stream = 'DocInfo' THEN CASE WHEN p % 9 = 0 THEN 1 ELSE 0 END ELSE p % 7 % 4 END AS level FROM num{s}),
made{s} AS (SELECT *, CASE WHEN tag = 17 THEN array_to_string(['0' || (p // (k + 1)) % 3 || '000000' for k in range(CASE WHEN p % 3 = 0 THEN 7 ELSE 8 END)], '')
  WHEN tag = 54 THEN CASE WHEN p % 10 = 0 THEN '0100' ELSE lower(hex(encode({_list(CONTROLS)}[p // 7 % 8 + 1]))) || '0' || p % 7 END
  WHEN tag = 69 THEN CASE WHEN p % 11 = 0 THEN '01' ELSE '0' || p // 5 % 3 || '00' END ELSE lower(hex(encode(CAST(p AS VARCHAR)))) END AS d FROM tag{s})"""


_NAME = "CASE tag " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in config.TAG_NAMES.items()) + " ELSE printf('TAG_0x%03x', tag) END"
_CTRL = "CASE ctrl " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.CONTROL_NAMES.items()) + " ELSE ctrl END"
_RECORDS = _view(11, "") + f""", rec AS (SELECT file, stream, ord, i, tag, level, d, length(d) // 2 AS size, CASE WHEN tag = 54 AND length(d) >= 8 THEN {_list(CONTROLS)}[p // 7 % 8 + 1] END AS ctrl,
  lag(tag) OVER w AS pt, lag(level) OVER w AS pl, sum(4 + length(d) // 2) OVER w - 4 - length(d) // 2 AS offset FROM made WINDOW w AS (PARTITION BY file, stream ORDER BY ord)),
body AS (SELECT * FROM rec WHERE starts_with(stream, 'BodyText/Section')), doc AS (SELECT * FROM rec WHERE stream = 'DocInfo'), mp AS (SELECT * FROM rec WHERE starts_with(stream, 'MasterPage')),
empty AS (SELECT * FROM streams s WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.file = s.file AND r.stream = s.stream))"""
_ROW = "SELECT file, stream, CAST({o} AS BIGINT) AS \"offset\", {n} AS name, '{r}' AS rule, '{s}' AS severity, CAST({d} AS VARCHAR) AS detail FROM {f}"


def _row(source: str, rule: str, severity: str, name: str = _NAME, offset: str = '"offset"', detail: str = "NULL") -> str:
    return _ROW.format(o=offset, n=name, r=rule, s=severity, d=detail, f=source)


# The state of the look-ahead: the first record that ends it decides.
_STATE = """(SELECT arg_min(CASE WHEN n.level <= b.level AND n.tag <> 58 THEN 0 ELSE 1 END, n.i) FROM body n WHERE n.file = b.file AND n.stream = b.stream AND n.i > b.i AND n.i <= b.i + 5 AND (n.level <= b.level AND n.tag <> 58 OR n.tag = 69 AND n.level = b.level + 1))"""
_CONTRACT = " UNION ALL ".join([
    _row("(SELECT file, 'DocInfo' AS stream FROM streams GROUP BY file HAVING NOT bool_or(stream = 'DocInfo'))", "R-010", "CRITICAL", "'STREAM'", "-1"),
    _row("empty WHERE stream = 'DocInfo'", "R-011", "CRITICAL", "'STREAM'", "-1"),
    _row("doc WHERE i = 0 AND tag <> 16 OR i = 1 AND tag <> 17", "R-012", "CRITICAL"),
    _row("(SELECT file, stream FROM doc GROUP BY ALL HAVING count(*) = 1)", "R-012", "CRITICAL", "'TAG_0x011'", "-1"),
    _row("(SELECT file, stream FROM doc GROUP BY ALL HAVING count_if(tag = 30) = 0)", "R-013", "HIGH", "'TAG_0x01e'", "-1"),
    _row("doc WHERE i = 1 AND tag = 17 AND size < 32", "R-014", "HIGH", detail="'too short'"),
    _row("""(SELECT m.file, m.stream, m.offset, m.t AS tag, m.declared, (SELECT count(*) FROM doc x WHERE x.file = m.file AND x.i >= 2 AND x.tag = m.t) AS actual
      FROM (SELECT file, stream, "offset", unnest([18, 19, 20, 21, 22, 23, 24, 26]) AS t, unnest([CAST(substr(d, 8 * k + 2, 1) AS INTEGER) for k in range(8)]) AS declared FROM doc WHERE i = 1 AND tag = 17 AND size >= 32) m) WHERE declared <> actual""",
         "R-014", "HIGH", "'ID_MAPPINGS'", detail=f"{_NAME} || ':' || declared || ':' || actual"),
    _row("doc WHERE level <> 0", "R-015", "MEDIUM"),
    _row("empty WHERE starts_with(stream, 'BodyText/Section')", "R-030", "CRITICAL", "'STREAM'", "-1"),
    _row("body WHERE i = 0 AND tag <> 50", "R-031", "CRITICAL"),
    _row("body WHERE level - pl > 1", "R-040", "HIGH"),
    _row(f"body b WHERE tag = 54 AND coalesce({_STATE}, 0) = 0", "R-041", "HIGH", detail=_CTRL),
    _row("body WHERE tag = 51 AND pt IS DISTINCT FROM 50", "R-042", "MEDIUM"),
    _row("mp WHERE i = 0 AND tag <> 50", "R-070", "MEDIUM"),
])
_FOUND = f"{_RECORDS}, found AS ({_CONTRACT})"


@_query(f"WITH {_FOUND} SELECT * FROM found")
def contract_findings(spark, sf_dir):
    return S.contract(*_files(spark, sf_dir))


def _report(severities, bad) -> str:
    n = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s.lower()}" for s in severities)
    return f"SELECT s.file AS file, {n}, count(*) FILTER (WHERE severity IN ({bad})) = 0 AS passed, CASE WHEN count(*) FILTER (WHERE severity IN ({bad})) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT file FROM streams) s LEFT JOIN found USING (file) GROUP BY s.file"


@_query(f"WITH {_FOUND} {_report(('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'), chr(39) + 'CRITICAL' + chr(39) + ', ' + chr(39) + 'HIGH' + chr(39))}")
def contract_report(spark, sf_dir):
    streams, records = _files(spark, sf_dir)
    return S.report(streams, S.contract(streams, records))


@_query(f"WITH {_FOUND} SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY severity, stream, \"offset\", rule, detail NULLS FIRST) AS INTEGER) AS rank, severity, rule FROM found")
def contract_listing(spark, sf_dir):
    return S.listing(S.contract(*_files(spark, sf_dir))).select("file", "rank", "severity", "rule")


@_query(f"""WITH {_FOUND}, first AS (SELECT file, stream FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY stream) AS k FROM streams WHERE starts_with(stream, 'BodyText/Section')) WHERE k = 1)
SELECT file, stream, rule FROM found WHERE NOT starts_with(stream, 'BodyText/Section') OR (file, stream) IN (SELECT (file, stream) FROM first)""")
def contract_first_section(spark, sf_dir):
    return S.contract(*_files(spark, sf_dir), max_sections=1).select("file", "stream", "rule")


_MULTICOL = " UNION ALL ".join([
    _row("body b WHERE ctrl = 'secd' AND NOT EXISTS (SELECT 1 FROM body c WHERE c.file = b.file AND c.stream = b.stream AND c.i > b.i AND c.level > b.level AND c.ctrl = 'cold')", "multicol", "INFO", "'CTRL_HEADER(secd)'"),
    _row("""(SELECT b.file, b.stream, b.offset, count(*) AS k FROM body b JOIN body s ON s.file = b.file AND s.stream = b.stream AND s.i < b.i AND s.level < b.level AND s.ctrl = 'secd'
      WHERE b.ctrl = 'cold' AND CAST('0x' || substr(b.d, 3, 2) || substr(b.d, 1, 2) AS INTEGER) NOT BETWEEN 1 AND 20 GROUP BY ALL)""", "multicol", "ERROR", "'CTRL_HEADER(cold)'", detail="k"),
])
_MASTER = " UNION ALL ".join([
    _row("(SELECT DISTINCT file, 'MasterPage' AS stream FROM body b WHERE ctrl IN ('hdr ', 'ftr ') AND NOT EXISTS (SELECT 1 FROM streams s WHERE s.file = b.file AND starts_with(s.stream, 'MasterPage')))", "masterpage", "WARN", "'STREAM'", "-1"),
    _row("empty WHERE starts_with(stream, 'MasterPage')", "masterpage", "ERROR", "'STREAM'", "-1"), _row("mp WHERE i = 0 AND tag <> 50", "masterpage", "ERROR"),
    _row("mp WHERE level > pl AND pt NOT IN (69, 54)", "masterpage", "WARN"),
])
_KNOWN = ", ".join(f"'{k}'" for k in config.CONTROL_NAMES)
_CONTROLS = " UNION ALL ".join([
    _row(f"body WHERE ctrl NOT IN ({_KNOWN})", "controls", "ERROR", detail="'unknown'"),
    _row(f"body b WHERE ctrl NOT IN ({_KNOWN}) AND NOT EXISTS (SELECT 1 FROM body n WHERE n.file = b.file AND n.stream = b.stream AND n.i BETWEEN b.i + 1 AND b.i + 4 AND n.tag = 58 AND n.level = b.level)", "controls", "ERROR", detail="'no data'"),
    _row("body WHERE ctrl IN ('revt', 'mequ', 'idot')", "controls", "WARN", detail=_CTRL),
])
_STRUCTURE = " UNION ALL ".join([
    _row("own WHERE level > coalesce(pl, 0) + 1", "S-001", "ERROR"), _row("own WHERE tag = 69 AND size < 2", "S-002", "ERROR", detail="'too short'"),
    _row("""(SELECT *, CAST('0x' || substr(d, 3, 2) || substr(d, 1, 2) AS INTEGER) AS declared, (SELECT count(*) FROM own c WHERE c.file = l.file AND c.stream = l.stream AND c.i > l.i AND c.tag = 50 AND c.level = l.level + 1
      AND NOT EXISTS (SELECT 1 FROM own x WHERE x.file = l.file AND x.stream = l.stream AND x.i > l.i AND x.i < c.i AND x.level <= l.level)) AS actual FROM own l WHERE tag = 69 AND size >= 2) WHERE declared <> actual""", "S-002", "WARN", detail="declared || ':' || actual"),
])
_OWN = f"{_RECORDS}, own AS (SELECT * FROM doc UNION ALL SELECT * FROM body UNION ALL SELECT * FROM mp)"


@_query(f"WITH {_RECORDS} {_MULTICOL}")
def verify_multicol(spark, sf_dir):
    return S.column_checks(_files(spark, sf_dir)[1])


@_query(f"WITH {_RECORDS} {_MASTER}")
def verify_masterpage(spark, sf_dir):
    return S.master_checks(*_files(spark, sf_dir))


@_query(f"WITH {_RECORDS} {_CONTROLS}")
def verify_controls(spark, sf_dir):
    return S.control_checks(_files(spark, sf_dir)[1])


@_query(f"WITH {_OWN} {_STRUCTURE}")
def verify_structure(spark, sf_dir):
    return S.structure_checks(_files(spark, sf_dir)[1])


@_query(f"WITH {_OWN} SELECT *, 'controls' AS feature FROM ({_CONTROLS}) UNION ALL SELECT *, 'masterpage' FROM ({_MASTER})")
def verify_selected(spark, sf_dir):
    return S.verify(*_files(spark, sf_dir), features=("controls", "masterpage"))


@_query(f"WITH {_OWN}, found AS ({_MULTICOL} UNION ALL {_MASTER} UNION ALL {_CONTROLS} UNION ALL {_STRUCTURE}) {_report(('ERROR', 'WARN', 'INFO'), chr(39) + 'ERROR' + chr(39))}")
def verify_report(spark, sf_dir):
    streams, records = _files(spark, sf_dir)
    return S.report(streams, S.verify(streams, records), ("ERROR", "WARN", "INFO"))


@_query(f"""WITH {_RECORDS} SELECT file, stream, ord, {_NAME} AS name, {_CTRL} AS control, repeat('  ', CAST(level AS INTEGER)) || printf('[0x%08x] L%02d ', CAST("offset" AS BIGINT), level) || {_NAME}
  || CASE WHEN ctrl IS NULL THEN '' ELSE ' ctrl=''' || {_CTRL} || '''' END || ' sz=' || size || CASE WHEN size > 0 THEN ' ' || substr(d, 1, 32) ELSE '' END AS line FROM rec""")
def record_lines(spark, sf_dir):
    return S.display(_files(spark, sf_dir)[1]).select("file", "stream", "ord", "name", "control", "line")


_DIFF = _view(11, "") + ", " + _view(13, "2") + """, own AS (SELECT file, stream, i, tag, level, d FROM made),
changed AS (SELECT file, stream, row_number() OVER (PARTITION BY file, stream ORDER BY ord) - 1 AS i, CASE WHEN p % 17 = 0 THEN 153 ELSE tag END AS tag, level + CASE WHEN p % 23 = 0 THEN 1 ELSE 0 END AS level,
  CASE WHEN p % 19 = 0 THEN d || 'ff' WHEN p % 5 = 1 THEN substr(d, 1, length(d) - 2) || 'ee' ELSE d END AS d FROM made2 WHERE p % 13 <> 0),
names AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.stream, b.stream) AS stream, a.file IS NOT NULL AS ina, b.file IS NOT NULL AS inb FROM streams a FULL JOIN streams2 b ON a.file = b.file AND a.stream = b.stream),
j AS (SELECT coalesce(a.file, b.file) AS file, coalesce(a.stream, b.stream) AS stream, coalesce(a.i, b.i) AS i, a.tag AS ta, b.tag AS tb, a.level AS la, b.level AS lb, a.d AS da, b.d AS db FROM own a FULL JOIN changed b ON a.file = b.file AND a.stream = b.stream AND a.i = b.i),
k AS (SELECT j.*, least(length(da), length(db)) AS n FROM j JOIN names USING (file, stream) WHERE ina AND inb),
diffs AS (SELECT file, stream, NULL AS i, 'MISSING' AS kind, 'CRITICAL' AS severity, NULL AS differs_at FROM names WHERE NOT inb UNION ALL SELECT file, stream, NULL, 'EXTRA', 'LOW', NULL FROM names WHERE NOT ina
  UNION ALL SELECT file, stream, i, 'MISSING', 'CRITICAL', NULL FROM k WHERE tb IS NULL UNION ALL SELECT file, stream, i, 'EXTRA', 'HIGH', NULL FROM k WHERE ta IS NULL UNION ALL SELECT file, stream, i, 'TAG', 'HIGH', NULL FROM k WHERE ta <> tb
  UNION ALL SELECT file, stream, i, 'LEVEL', 'HIGH', NULL FROM k WHERE ta = tb AND la <> lb UNION ALL SELECT file, stream, i, 'SIZE', 'HIGH', NULL FROM k WHERE ta = tb AND length(da) <> length(db)
  UNION ALL SELECT file, stream, i, 'DATA', CASE WHEN stream = 'DocInfo' THEN 'HIGH' ELSE 'MEDIUM' END, list_filter(range(n // 2), lambda b: substr(da, 2 * b + 1, 2) <> substr(db, 2 * b + 1, 2))[1] FROM k WHERE ta = tb AND substr(da, 1, n) <> substr(db, 1, n)),
typed AS (SELECT file, stream, CAST(i AS INTEGER) AS i, kind, severity, CAST(differs_at AS INTEGER) AS differs_at FROM diffs)"""


@_query(f"WITH {_DIFF} SELECT * FROM typed")
def stream_diff(spark, sf_dir):
    return S.compare(_files(spark, sf_dir), _files(spark, sf_dir, True))


@_query(f"""WITH {_DIFF}, n AS (SELECT s.file AS file, {", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))} FROM (SELECT DISTINCT file FROM names) s LEFT JOIN typed USING (file) GROUP BY s.file)
SELECT *, CASE WHEN n_critical + n_high > 0 THEN 'FAIL' WHEN n_medium + n_low > 0 THEN 'WARN' ELSE 'IDENTICAL' END AS status FROM n""")
def diff_report(spark, sf_dir):
    a, b = _files(spark, sf_dir), _files(spark, sf_dir, True)
    return S.diff_report(a[0].select("file").union(b[0].select("file")), S.compare(a, b))


def _rank(column: str, keys) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({column}, '{k}') THEN {i}" for i, k in enumerate(keys)) + " ELSE 99 END"


@_query(f"""WITH {_DIFF} SELECT file, stream, kind, severity, CAST(row_number() OVER (PARTITION BY file ORDER BY {_rank("severity", ("CRITICAL", "HIGH", "MEDIUM", "LOW"))}, {_rank("stream", ("FileHeader", "DocInfo", "BodyText/Section0"))},
  stream, i NULLS FIRST, {_rank("kind", ("MISSING", "EXTRA", "TAG", "LEVEL", "SIZE", "DATA"))}) AS INTEGER) AS priority FROM typed""")
def diff_priority(spark, sf_dir):
    return S.prioritised(S.compare(_files(spark, sf_dir), _files(spark, sf_dir, True))).select("file", "stream", "kind", "severity", "priority")


@_query(f"WITH {_view(11, '')}, {_view(13, '2')} SELECT file, stream FROM streams UNION SELECT file, stream FROM streams2")
def stream_names(spark, sf_dir):
    return S.stream_names(_files(spark, sf_dir)[0], _files(spark, sf_dir, True)[0])


@_query(f"WITH {_RECORDS} SELECT file, stream, {_NAME} AS name, count(*) AS n FROM rec GROUP BY ALL")
def tag_counts(spark, sf_dir):
    return S.tag_counts(_files(spark, sf_dir)[1])


# Every file has a header, but for some: of some it is cut, of some it has another signature or an old version; some can't be opened.
_HEADERS = """hd AS (SELECT DISTINCT file FROM streams WHERE file % 9 <> 4), fl AS (SELECT DISTINCT file, 'locked' AS reason FROM streams WHERE file % 10 = 7)"""
_HEAD_FOUND = """SELECT file, '<open>' AS stream, CAST(-1 AS BIGINT) AS "offset", 'FILE' AS name, 'R-000' AS rule, 'CRITICAL' AS severity, reason AS detail FROM fl
UNION ALL SELECT DISTINCT file, 'FileHeader', -1, 'FILE_SIGNATURE', 'R-001', 'CRITICAL', CASE WHEN file % 9 = 4 THEN 'missing' ELSE 'absent' END FROM streams WHERE file % 10 <> 7 AND (file % 9 = 4 OR file % 7 = 3)
UNION ALL SELECT DISTINCT file, 'FileHeader', -1, 'HWP_VERSION', 'R-002', 'HIGH', CASE WHEN file % 6 = 1 THEN '0.0.0.0' ELSE '4.3.2.1' END FROM streams WHERE file % 10 <> 7 AND file % 9 <> 4 AND file % 7 <> 3 AND (file % 6 = 1 OR file % 5 = 2)"""


def _headers(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    f = F.col("file")
    sign = F.when(f % 7 == 3, F.encode(F.lit("PK Document File "), "UTF-8")).otherwise(F.encode(F.lit(config.FILE_SIGNATURE), "UTF-8"))
    version = F.when(f % 5 == 2, F.unhex(F.lit("01020304"))).otherwise(F.unhex(F.lit("00000005")))
    flags = F.unhex(F.concat(F.lpad(F.hex(f % 256), 2, "0"), F.lpad(F.hex(F.floor(f / 256) % 256), 2, "0"), F.lit("0000")))
    whole = F.concat(sign, F.unhex(F.lit("00" * 15)), version, flags)
    files = streams.select("file").distinct()
    headers = files.filter(f % 9 != 4).select("file", F.when(f % 6 == 1, F.substring(whole, 1, 34)).otherwise(whole).alias("data"))
    return headers, files.filter(f % 10 == 7).select("file", F.lit("locked").alias("reason"))


@_query(f"WITH {_RECORDS}, {_HEADERS} {_HEAD_FOUND}")
def header_findings(spark, sf_dir):
    streams = _files(spark, sf_dir)[0]
    return S.header_rules(streams, *_headers(streams))


@_query(f"WITH {_RECORDS}, {_HEADERS} SELECT file, CASE WHEN file % 6 = 1 THEN '0.0.0.0' WHEN file % 5 = 2 THEN '4.3.2.1' ELSE '5.0.0.0' END AS version, CASE WHEN file % 6 <> 1 THEN file & 1 = 1 END AS compressed, CASE WHEN file % 6 <> 1 THEN file & 2048 = 2048 END AS track_changes FROM hd")
def file_headers(spark, sf_dir):
    flags = S.file_flags(F.col("data"))
    return _headers(_files(spark, sf_dir)[0])[0].select("file", S.file_version(F.col("data")).alias("version"), *[F.try_element_at(flags, F.lit(k)).alias(k) for k in ("compressed", "track_changes")])


@_query(f"WITH {_FOUND}, {_HEADERS} SELECT found.* FROM found WHERE file % 10 <> 7 UNION ALL {_HEAD_FOUND}")
def contract_of_files(spark, sf_dir):
    streams, records = _files(spark, sf_dir)
    return S.contract(streams, records, 0, *_headers(streams))


_FIRSTS = "fa AS (SELECT file, min(stream) AS s FROM streams WHERE starts_with(stream, 'BodyText/Section') GROUP BY file), fb AS (SELECT file, min(stream) AS s FROM streams2 WHERE starts_with(stream, 'BodyText/Section') GROUP BY file)"


@_query(f"""WITH {_DIFF}, {_FIRSTS}, c AS (SELECT t.*, starts_with(t.stream, 'BodyText/Section') AS section, coalesce(t.stream = fa.s, false) AS a, coalesce(t.stream = fb.s, false) AS b FROM typed t LEFT JOIN fa USING (file) LEFT JOIN fb USING (file)),
one AS (SELECT file, stream, i, kind, severity, differs_at FROM c WHERE NOT section OR a AND b),
solo AS (SELECT coalesce(fa.file, fb.file) AS file, fa.s AS x, fb.s AS y FROM fa FULL JOIN fb ON fa.file = fb.file WHERE fa.s IS DISTINCT FROM fb.s),
every AS (SELECT * FROM one UNION ALL SELECT file, x, NULL, 'MISSING', 'CRITICAL', NULL FROM solo WHERE x IS NOT NULL UNION ALL SELECT file, y, NULL, 'EXTRA', 'LOW', NULL FROM solo WHERE y IS NOT NULL)
SELECT * FROM every WHERE file % 10 <> 7 UNION ALL SELECT DISTINCT file, '<open>', CAST(NULL AS INTEGER), 'MISSING', 'CRITICAL', CAST(NULL AS INTEGER) FROM streams WHERE file % 10 = 7""")
def diff_first_section(spark, sf_dir):
    a, b = _files(spark, sf_dir), _files(spark, sf_dir, True)
    return S.compare(a, b, 1, _headers(a[0])[1])


@_query(f"""WITH {_RECORDS}, dp AS (SELECT *, row_number() OVER w + least(0, min(level + 1 - i - 1) OVER (PARTITION BY file, stream ORDER BY i)) AS depth FROM rec WINDOW w AS (PARTITION BY file, stream ORDER BY i)),
nx AS (SELECT *, coalesce(lead(depth) OVER (PARTITION BY file, stream ORDER BY i), 1) AS nd, lag(depth) OVER (PARTITION BY file, stream ORDER BY i) AS pd FROM dp),
pc AS (SELECT file, stream, i, CASE WHEN depth <= pd THEN ',' ELSE '' END || '{{"tag":' || tag || ',"tag_name":"' || {_NAME} || '","level":' || level || ',"size":' || size || ',"offset":' || CAST("offset" AS BIGINT) || ',"stream":"' || stream || '"' || CASE WHEN ctrl <> '' THEN ',"ctrl_id":"' || ctrl || '"' ELSE '' END
  || CASE WHEN size > 0 THEN ',"data_hex":"' || d || '"' ELSE '' END || CASE WHEN nd > depth THEN ',"children":[' ELSE '}}' || repeat(']}}', CAST(depth - nd AS INTEGER)) END AS s FROM nx)
SELECT file, stream, '[' || string_agg(s, '' ORDER BY i) || ']' AS tree FROM pc GROUP BY file, stream""")
def record_trees(spark, sf_dir):
    return S.trees(_files(spark, sf_dir)[1], with_data=True)
