"""Operator 4: benchmark decontamination by winnowing, in DataFrame functions only.

Words are numbered; each run of GRAM words has a hash; in every window of WINDOW - GRAM + 1 such hashes the smallest is kept
with its position (the leftmost of equals). Two texts that share WINDOW consecutive words share a kept hash, so the join of
the kept hashes misses no shared window. A hit is then extended: every window of WINDOW words around it is hashed from its
words and joined with the benchmark's windows. Benchmark items of fewer words are one window, found by their first word.

Scale: the documents are read three times (fingerprints, texts with hits, word counts). Up to `common.BROADCAST_ROWS` documents
with a fingerprint hit are found by a checked broadcast of their ids; with more of them all texts are shuffled once to meet the hits. Nothing pairs documents with items: windows join
by their hash; the set of items that hold a window has an id, a document gathers such ids, and each distinct list of ids is
expanded to items once. Positions are packed longs, so that a text with very many hits costs time in proportion. Benchmark
tables are broadcast up to `common.BROADCAST_ROWS` rows and shuffled beyond; up to MAX_ANCHORS first words of short items are
looked up inside a text's array of words, more by a join of all words.

Cases: null and empty texts have no words and no hits; an item without words occurs nowhere; a null item_id marks its words
but is not counted or listed. Rows that repeat a doc_id are judged each by its own text. Empty tables work on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

WINDOW = 13
GRAM = 6
MAX_ANCHORS = 10_000
#: A position and a length (at most WINDOW) in one long.
LENGTH_BITS = 4
#: The low bits of a packed fingerprint hold its position; a text of at most 2 GB has fewer words.
POSITION_BITS = 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; other letters keep their case."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAP), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row rather than once for each use inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprints(w: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """Winnowed fingerprints of an array of words: hash above, position in the low POSITION_BITS bits."""
    low = (1 << POSITION_BITS) - 1

    def grams(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (gram - 1)), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(gram)]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

    def least(g: Column) -> Column:
        n = window - gram + 1
        return F.array_distinct(F.transform(F.slice(g, 1, F.size(g) - (n - 1)), lambda _, i: F.least(*[F.get(g, i + k) for k in range(n)])))

    def of(h: Column) -> Column:
        return F.when(F.size(h) >= window, let(grams(h), least)).otherwise(F.array().cast("array<long>"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def _packed(at: Column, length: Column) -> Column:
    return F.shiftleft(at.cast("long"), LENGTH_BITS).bitwiseOR(length.cast("long"))


def _at(x: Column) -> Column:
    return F.shiftright(x, LENGTH_BITS).cast("int")


def _len(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")


def _hash(fp: Column) -> Column:
    return F.shiftright(fp, POSITION_BITS)


def _position(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if common.small_enough(df) else df


def _meet(left: DataFrame, right: DataFrame, how: str = "inner", fits=lambda x: x) -> DataFrame:
    """Joins on doc_id (null meets null) and text_hash; `fits` may mark the right side for broadcast."""
    right = fits(right.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}))
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), how).drop("_id", "_hash")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash for each row of `docs` (doc_id, text)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = common.durable(items)
    long, short = items.filter(F.size("w") >= WINDOW), items.filter(F.size("w") < WINDOW)
    windows = long.select("item_id", F.explode(F.transform(F.slice("w", 1, F.size("w") - (WINDOW - 1)), lambda _, i: F.xxhash64(F.slice("w", i + 1, WINDOW)))).alias("window"), F.lit(WINDOW).alias("len"))
    windows = windows.union(short.select("item_id", F.xxhash64("w"), F.size("w"))).distinct()
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", "text", F.xxhash64(text).alias("text_hash"))
    kept = docs.select("doc_id", "text_hash", F.explode(fingerprints(words(F.col("text")))).alias("fp")).withColumn("f", _hash(F.col("fp")))
    known = long.select(F.explode(fingerprints(F.col("w"))).alias("fp")).select(_hash(F.col("fp")).alias("f")).distinct()
    found = kept.join(_bounded(known), "f", "left_semi").select("doc_id", "text_hash", _packed(_position(F.col("fp")), F.lit(WINDOW)).alias("hit"))
    if not short.isEmpty():
        anchors = common.durable(short.select(F.element_at("w", 1).alias("word"), F.size("w").alias("len")).distinct())
        if common.small_enough(anchors, MAX_ANCHORS):
            first = sorted({r.word for r in anchors.collect()})
            own = F.filter(F.transform(words(F.col("text")), lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda x: x["word"].isin(first))
            each = docs.select("doc_id", "text_hash", F.explode(own).alias("x")).select("doc_id", "text_hash", "x.*")
        else:
            each = docs.select("doc_id", "text_hash", F.posexplode(words(F.col("text"))).alias("at", "word"))
        found = found.union(each.join(_bounded(anchors), "word").select("doc_id", "text_hash", _packed(F.col("at"), F.col("len"))))
    hits = common.durable(found.groupBy("doc_id", "text_hash").agg(F.collect_set("hit").alias("hits")))
    ids = hits.select("doc_id", "text_hash")
    hit_docs = _meet(docs, ids, "left_semi", F.broadcast) if common.small_enough(ids) else docs
    hit_docs = _meet(hit_docs, hits).select("doc_id", "text_hash", "hits", words(F.col("text")).alias("w"))
    reach = WINDOW - GRAM
    around = F.array(*map(F.lit, range(reach + 1)))
    starts = F.flatten(F.transform("hits", lambda x: F.when(_len(x) < WINDOW, F.array(x)).otherwise(F.transform(F.filter(around, lambda k: k <= _at(x)), lambda k: _packed(_at(x) - k, F.lit(WINDOW))))))
    own = F.transform(F.filter(F.array_distinct(starts), lambda x: _at(x) + _len(x) <= F.size("w")), lambda x: F.struct(x.alias("place"), F.xxhash64(F.slice("w", _at(x) + 1, _len(x))).alias("window")))
    met = hit_docs.select("doc_id", "text_hash", F.explode(own).alias("x")).select("doc_id", "text_hash", "x.*").withColumn("len", _len(F.col("place")))
    sets = common.durable(windows.groupBy("window", "len").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")).withColumn("set_id", F.xxhash64("items")))
    met = common.durable(met.join(_bounded(sets.select("window", "len", "set_id")), ["window", "len"]).select("doc_id", "text_hash", "place", "set_id"))
    span = F.aggregate(
        F.array_sort(F.collect_set("place")),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], _at(x) + _len(x)).alias("end"), (acc["n"] + F.greatest(F.lit(0), _at(x) + _len(x) - F.greatest(acc["end"], _at(x)))).alias("n")),
        lambda acc: acc["n"],
    )
    covered = met.groupBy("doc_id", "text_hash").agg(span.alias("n_hit"), F.array_sort(F.collect_set("set_id")).alias("set_ids"))
    covered = common.durable(covered.withColumn("list_id", F.xxhash64("set_ids")))
    lists = covered.groupBy("list_id").agg(F.first("set_ids").alias("set_ids")).select("list_id", F.explode("set_ids").alias("set_id"))
    each_set = sets.groupBy("set_id").agg(F.first("items").alias("items"))
    lists = lists.join(each_set, "set_id").select("list_id", F.explode_outer("items").alias("item")).groupBy("list_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = lists.select("list_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    both = covered.select("doc_id", "text_hash", "n_hit", "list_id").join(_bounded(listed), "list_id").drop("list_id")
    counted = docs.select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("long").alias("n"))
    out = _meet(counted, both, "left")
    n, n_hit = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", n.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n)).alias("contaminated"), "text_hash",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that are not contaminated, with their columns, whatever these are called."""
    bad = decontaminate(docs, benchmark).filter("contaminated").select("doc_id", "text_hash")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.struct("*").alias("row"))
    return _meet(rows, bad, "left_anti").select("row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, array_to_string(w[i:i+l-1], ' ') AS g, l FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS l, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT l FROM v),
x AS (SELECT doc_id, i, l, array_to_string(w[i:i+l-1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, l)),
h AS (SELECT x.doc_id, x.i, x.l, v.item_id FROM x JOIN v ON x.g = v.g AND x.l = v.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
