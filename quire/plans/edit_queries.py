"""Queries over edits: lines of documents are paragraphs, line items cells, uses, files and items of a package, parts images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import images as I
from quire.operators import edits as E
from quire.operators import numbering as N
from quire.plans.base import _query, _read


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))


_LINES = "ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS INTEGER) AS ord FROM documents)"


# Six figures of each document: two with one anchor, one without any, one that doesn't occur, some without an image.
@_query(f"""WITH {_LINES}, f AS (SELECT doc_id, j AS pos, CASE WHEN j = 3 THEN 'zz zz' WHEN j = 5 THEN '' ELSE trim(substr(coalesce(text, ''), CAST(1 + j % 4 * 37 AS BIGINT), 9), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS a, CASE j % 3 WHEN 0 THEN 'after' WHEN 1 THEN 'before' END AS hint FROM documents, (VALUES (0), (1), (2), (3), (4), (5)) v(j) WHERE (doc_id + j) % 5 <> 0),
m AS (SELECT f.doc_id, f.pos, min(ln.ord) AS spot FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.ord % 6 <> 4 AND f.a <> '' AND contains(ln.text, f.a) GROUP BY ALL),
n AS (SELECT f.*, m.spot, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.pos) - 1 AS k FROM f LEFT JOIN m USING (doc_id, pos)),
u AS (SELECT doc_id, ord, NULL AS pos, ord AS spot, 0 AS side, 0 AS o, NULL AS para_id FROM ln UNION ALL SELECT doc_id, NULL, pos, spot, CASE WHEN spot IS NULL THEN 0 WHEN hint = 'before' THEN -1 ELSE 1 END, CASE WHEN spot IS NOT NULL AND coalesce(hint, '') <> 'before' THEN -pos ELSE pos END, 10000000 + doc_id + 1000 + 3 * k FROM n)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot NULLS LAST, side, o) - 1 AS INTEGER) AS place, ord, CAST(pos AS INTEGER) AS pos, CAST(para_id AS BIGINT) AS para_id FROM u""")
def inserted_figures(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    j = F.col("pos")
    figures = docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, range(6)))).alias("pos"))
    anchor = F.when(j == 3, "zz zz").when(j == 5, "").otherwise(F.substring(F.coalesce("text", F.lit("")), 1 + j % 4 * 37, F.lit(9)))
    figures = figures.select("doc_id", "pos", anchor.alias("anchor_text"), F.when(j % 3 == 0, "after").when(j % 3 == 1, "before").alias("position_hint"), ((F.col("doc_id") + j) % 5 != 0).alias("has_image"))
    children = _lines(spark, sf_dir).withColumn("is_paragraph", F.col("ord") % 6 != 4)
    marks = N.high_water(docs.select("doc_id", (F.col("doc_id") + E.ID_FLOOR).cast("string").alias("id")), E.ID_FLOOR)
    return E.inserted(children, figures, marks).select("doc_id", "place", "ord", "pos", "para_id")


_PAIRS = {"en": "<EN>", "er": "e", "e ": "er ", "th": "th"}


def _chain(text: str, pairs, condition: str = "true") -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')" if condition == "true" else f"CASE WHEN {condition.format(a=a)} THEN replace({text}, '{a}', '{b}') ELSE {text} END"
    return text


def _steps(pairs, first: str, condition: str = "true") -> str:
    """CTE columns t0, t1, ... of a chain and n, the sum of what each step replaced."""
    count = lambda t, a: f"(length({t}) - length(replace({t}, '{a}', ''))) // {len(a)}"
    cols, n = [f"{first} AS t0"], []
    for k, (a, b) in enumerate(pairs):
        on = condition.format(a=a)
        cols.append(f"CASE WHEN {on} THEN replace(t{k}, '{a}', '{b}') ELSE t{k} END AS t{k + 1}")
        n.append(f"CASE WHEN {on} THEN {count(f't{k}', a)} ELSE 0 END")
    return f"{', '.join(cols)}, {' + '.join(n)} AS n"


# Runs are pieces of seven characters of a line.
@_query(f"""WITH {_LINES}, r AS (SELECT doc_id, ord AS para, unnest(regexp_extract_all(text, '(?s).{{1,7}}')) AS text, CAST(generate_subscripts(regexp_extract_all(text, '(?s).{{1,7}}'), 1) - 1 AS INTEGER) AS ord FROM ln),
a AS (SELECT doc_id, para, ord, {_steps(_PAIRS.items(), "text")} FROM r),
j AS (SELECT doc_id, para, string_agg(t4, '' ORDER BY ord) AS joined, sum(n) AS n1 FROM a GROUP BY doc_id, para),
b AS (SELECT doc_id, para, joined, n1, {_steps(_PAIRS.items(), "joined", "contains(joined, '{a}')")}, {" OR ".join(f"contains(joined, '{a}')" for a in _PAIRS)} AS need FROM j)
SELECT a.doc_id, a.para, a.ord, CASE WHEN NOT need THEN a.t4 WHEN a.ord = 0 THEN b.t4 ELSE '' END AS text, CAST(n1 + CASE WHEN need THEN b.n ELSE 0 END AS BIGINT) AS n FROM a JOIN b USING (doc_id, para)""")
def replaced_runs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    runs = lines.select("doc_id", F.col("ord").alias("para"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,7}"), 0)).alias("ord", "text"))
    return E.replaced(runs, _PAIRS)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))


_ITEMS = "li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"
_CELLS = f"""{_ITEMS}, cells AS (SELECT doc_id, 0 AS table_id, n AS ord, n // 2 AS r, n % 2 AS c, CASE WHEN p % 7 > 1 THEN 'old' || p ELSE '' END AS text, CASE p % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'empty' ELSE 'text' END AS state FROM li),
ups AS (SELECT doc_id, n AS pos, CASE WHEN p % 5 = 0 THEN 'append' ELSE 'set' END AS op, CASE WHEN p % 11 = 0 THEN 1 ELSE 0 END AS table_id, p % 5 AS r, p % 2 AS c, 'new' || p AS text, 'v' || p AS v FROM li),
tb AS (SELECT doc_id, max(r) AS last FROM cells GROUP BY doc_id),
ap AS (SELECT ups.*, last, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM ups JOIN tb USING (doc_id) WHERE op = 'append' AND table_id = 0),
pt AS (SELECT cells.*, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM cells JOIN tb USING (doc_id) WHERE r = last),
ev AS (SELECT doc_id, r, c, text, state, -1 AS made FROM cells UNION ALL SELECT doc_id, ap.last + k, pt.c, CASE WHEN state = 'text' THEN CASE i WHEN 1 THEN v ELSE '' END ELSE pt.text END, state, pos FROM ap JOIN pt USING (doc_id)),
tr AS (SELECT u.doc_id, u.pos, u.r, u.c, u.text, ev.state, CASE WHEN u.table_id = 1 THEN 'no such table' WHEN ev.state IS NULL OR ev.made >= u.pos THEN 'no such cell' WHEN ev.state = 'none' THEN 'no paragraph' END AS reason FROM ups u LEFT JOIN ev ON ev.doc_id = u.doc_id AND ev.r = u.r AND ev.c = u.c AND u.table_id = 0 WHERE op = 'set')"""


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, n = F.col("p"), F.col("n")
    li = _items(spark, sf_dir)
    state = F.when(p % 7 == 0, "none").when(p % 7 == 1, "empty").otherwise("text")
    cells = li.select("doc_id", F.lit(0).alias("table_id"), n.alias("ord"), F.floor(n / 2).cast("int").alias("r"), (n % 2).cast("int").alias("c"), F.when(p % 7 > 1, F.concat(F.lit("old"), p)).otherwise("").alias("text"), state.alias("state"))
    updates = li.select(
        "doc_id", n.alias("pos"), F.when(p % 5 == 0, "append").otherwise("set").alias("op"), F.when(p % 11 == 0, 1).otherwise(0).alias("table_id"), (p % 5).cast("int").alias("r"), (p % 2).cast("int").alias("c"),
        F.concat(F.lit("new"), p).alias("text"), F.array(F.concat(F.lit("v"), p)).alias("values"),
    )
    return E.updated_cells(cells, updates)


@_query(f"WITH {_CELLS}, w AS (SELECT doc_id, r, c, arg_max(text, pos) AS t FROM tr WHERE reason IS NULL AND state = 'text' GROUP BY ALL) SELECT doc_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, coalesce(t, text) AS text FROM ev LEFT JOIN w USING (doc_id, r, c)")
def updated_cells(spark, sf_dir):
    return _edited(spark, sf_dir)[0].select("doc_id", "r", "c", "text")


@_query(f"WITH {_CELLS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, 'set' AS op, reason FROM tr WHERE reason IS NOT NULL UNION ALL SELECT doc_id, CAST(pos AS INTEGER), op, 'no such table' FROM ups WHERE op = 'append' AND table_id = 1")
def update_errors(spark, sf_dir):
    return _edited(spark, sf_dir)[1]


# Colours of line items: some are known, others get the next ids in order of first use.
@_query(f"""WITH {_ITEMS}, u AS (SELECT doc_id, n, CASE WHEN p % 9 <> 8 THEN 'c' || p % 9 END AS key FROM li), f AS (SELECT doc_id, key, min(n) AS first FROM u WHERE key IS NOT NULL AND NOT (key = 'c0' AND doc_id % 2 = 0) GROUP BY ALL),
k AS (SELECT doc_id, key, doc_id % 4 * 10 + row_number() OVER (PARTITION BY doc_id ORDER BY first, key) AS id FROM f)
SELECT doc_id, CAST(n AS INTEGER) AS pos, key, CAST(CASE WHEN key = 'c0' AND doc_id % 2 = 0 THEN 3 ELSE id END AS BIGINT) AS id FROM u LEFT JOIN k USING (doc_id, key)""")
def colour_ids(spark, sf_dir):
    li, p = _items(spark, sf_dir), F.col("p")
    docs = li.select("doc_id").distinct()
    known = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("c0").alias("key"), F.lit(3).cast("long").alias("id"))
    uses = li.select("doc_id", F.col("n").alias("pos"), F.when(p % 9 != 8, F.concat(F.lit("c"), p % 9)).alias("key"))
    return N.dense_ids(uses, docs.select("doc_id", (F.col("doc_id") % 4 * 10).alias("high")), known)


@_query("SELECT l_orderkey AS doc_id, CAST(greatest(50, coalesce(max(CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END), 50)) AS BIGINT) AS high FROM lineitem GROUP BY l_orderkey")
def element_ids(spark, sf_dir):
    p = F.col("l_partkey")
    ids = F.when(p % 4 == 0, F.concat(F.lit("id"), p)).when(p % 4 == 1, F.concat(F.lit(" "), p)).otherwise(p.cast("string"))
    return N.high_water(_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ids.alias("id")), 50)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


_FILES = ["BinData/BIN000#.jpg", "bindata\\#.PNG", "BinData/pic#.gif", "BinData/note#.txt", "Contents/BIN#.bmp"]


@_query(f"""WITH {_ITEMS}, f AS (SELECT doc_id, n, p, replace({_FILES!r}[p % 5 + 1], '#', CAST(p % 3 + 1 AS VARCHAR)) AS name FROM li WHERE p % 5 < 3),
a AS (SELECT doc_id, name, p, unnest(CASE p % 5 WHEN 0 THEN ['BIN000' || p % 3 + 1, CAST(p % 3 + 1 AS VARCHAR)] WHEN 1 THEN [CAST(p % 3 + 1 AS VARCHAR)] ELSE ['pic' || p % 3 + 1] END) AS alias, n FROM f),
b AS (SELECT doc_id, alias, arg_max(name, n) AS name, arg_max(p, n) % 5 AS k FROM a GROUP BY ALL),
q AS (SELECT doc_id, n, ['', 'BIN000', 'pic', 'x'][p % 4 + 1] || p % 3 + 1 AS bin_ref FROM li)
SELECT doc_id, CAST(n AS INTEGER) AS n, bin_ref, name, ['image/jpeg', 'image/png', 'image/gif'][k + 1] AS mime, name IS NULL AS missing FROM q LEFT JOIN b ON b.doc_id = q.doc_id AND b.alias = q.bin_ref""".replace("SELECT doc_id, CAST(n", "SELECT q.doc_id, CAST(n").replace("\\\\", "\\"))
def package_binaries(spark, sf_dir):
    li, p = _items(spark, sf_dir), F.col("p")
    number = (p % 3 + 1).cast("string")
    files = li.select("doc_id", F.col("n").alias("ord"), F.replace(_pick(_FILES, p % 5), F.lit("#"), number).alias("name"))
    refs = li.select("doc_id", "n", F.concat(_pick(["", "BIN000", "pic", "x"], p % 4), number).alias("bin_ref"))
    return E.with_binaries(refs, files)


@_query(f"""WITH {_ITEMS}, m AS (SELECT doc_id, n AS ord, CASE WHEN p % 2 = 0 THEN 'image' || p % 50 ELSE 'section' || p % 50 END AS id, 'h' || p % 8 AS href, 'old' AS type, CASE WHEN p % 2 = 0 THEN p % 50 END AS k FROM li WHERE n <= 3),
t AS (SELECT doc_id, coalesce(max(k), 0) AS high, max(ord) AS last FROM m GROUP BY doc_id),
i AS (SELECT li.doc_id, n, 'h' || p % 8 AS href, high, last, row_number() OVER (PARTITION BY li.doc_id ORDER BY n) AS k FROM li JOIN t USING (doc_id) WHERE n > 3 AND NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = li.doc_id AND m.href = 'h' || li.p % 8))
SELECT doc_id, CAST(ord AS INTEGER) AS ord, id, href, type FROM m UNION ALL SELECT doc_id, CAST(last + k AS INTEGER), 'image' || (high + k), href, 'new' FROM i""")
def manifest_items(spark, sf_dir):
    li, p = _items(spark, sf_dir), F.col("p")
    href = F.concat(F.lit("h"), p % 8).alias("href")
    manifest = li.filter("n <= 3").select("doc_id", F.col("n").alias("ord"), F.concat(F.when(p % 2 == 0, "image").otherwise("section"), p % 50).alias("id"), href, F.lit("old").alias("type"))
    return E.extended_manifest(manifest, li.filter("n > 3").select("doc_id", F.col("n").alias("pos"), href, F.lit("new").alias("type")))


# Parts as heads of images of their size and key, in base64; some are cut, some are no images.
@_query("""SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 AND p_partkey % 13 <> 0 THEN p_size END AS width, CASE WHEN p_partkey % 6 < 5 AND p_partkey % 13 <> 0 THEN CAST(CASE WHEN p_partkey % 6 = 2 THEN -(p_partkey % 60000) ELSE p_partkey % 60000 END AS INTEGER) END AS height FROM part""")
def image_sizes(spark, sf_dir):
    k = F.col("p_partkey") % 6
    w, h = F.col("p_size").cast("long"), F.col("p_partkey") % 60_000
    big = lambda v, n: F.lpad(F.hex(v), 2 * n, "0")
    pairs = lambda v, n: F.array_join(F.reverse(F.regexp_extract_all(big(v, n), F.lit(".."), 0)), "")
    frame = lambda mark: F.concat(F.lit(f"{mark}001108"), big(h, 2), big(w, 2), F.lit("03" + "00" * 9))
    raw = (
        F.when(k == 0, F.concat(F.lit(I.PNG + "0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806"))).when(k == 1, F.concat(F.lit("474946383961"), pairs(w, 2), pairs(h, 2), F.lit("F7")))
        .when(k == 2, F.concat(F.lit("424D" + "00" * 16), pairs(w, 4), pairs(F.when(h > 0, F.lit(1 << 32) - h).otherwise(0), 4), F.lit("01"))).when(k == 3, F.concat(F.lit("FFD8FFE00004AAAA"), F.repeat(F.lit("FFDB0005FFC0FF"), (F.col("p_size") % 7).cast("int")), frame("FFC2")))
        .when(k == 4, F.concat(F.lit("FFD8"), frame("FFC0"), F.lit("FFD9"))).otherwise(F.lit("25504446"))
    )
    raw = F.when(F.col("p_partkey") % 13 == 0, F.substring(raw, 1, 14)).otherwise(raw)
    text = F.concat(F.when(k % 2 == 0, "data:image/x;base64,").otherwise(""), F.base64(F.unhex(raw)))
    parts = _read(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", E.image_bytes(F.lit(None).cast("binary"), F.col("text")).alias("data"))
    return parts.select("p_partkey", I.image_size(F.col("data")).alias("s")).select("p_partkey", "s.width", "s.height")
