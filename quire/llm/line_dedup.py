"""Operator 11: lines that many documents share stay in one of them, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at least `min_chars` code points that at least
`min_docs` documents hold lose all their lines except in the largest doc_id that holds them.

The long lines of all texts become rows (two 64-bit hashes of the key, doc_id, hash of the text, position), some 40 bytes each,
written once. They are dealt to ranges of the hashes, sorted in each range by hash, document (largest first) and position, and
streamed: the first document of a key keeps its lines, and the key counts if the stream gives it `min_docs` documents. The result
is not text but, for each document that loses lines, a compressed bitmap of the lines it keeps; `apply` filters texts by it.

Bitmaps: words of 32 bits, a bit set for each line kept. `keep` lists the words with a bit that is not set, each with `gap`, the
number of full words before it; all words after the last one are full. A document that keeps all lines has no bitmap.

Scale: one range exchange of the line rows; texts are shuffled once, by `apply`, to meet their bitmaps. Ranges can't part one
key, so keys that hold more than 1/HOT_SHARE of all line rows (there are less than HOT_SHARE of them, a proven bound) go another
way: their distinct documents are counted by (key, document), their totals added up from partial sums and sent back to the line
rows as a broadcast table. To find them, rows are first counted for each of BUCKETS residues of the hash, then exactly within
the residues that hold as much. The share changes the way of a key, never its result.

Cases: a null or empty text is one empty line and stays as it is. Rows that repeat a doc_id count as one document, and each row
keeps or drops the lines of its own text. A null doc_id is one document, smaller than all others. Equal lines of one document go
or stay together. An empty table gives no rows. Columns of `docs` other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

MIN_CHARS, MIN_DOCS = 40, 5
BUCKETS, HOT_SHARE = 65_536, 2_048
WORD = 32
FULL = (1 << WORD) - 1
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY, _DOC = ["h1", "h2"], ["doc_id", "text_hash"]


def _text_hash() -> Column:
    return F.xxhash64("text")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased; where all is ASCII, `lower` does just that."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, text_hash, pos: a row for each line of `docs` (doc_id, text) whose key is long enough."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.filter(F.length(F.btrim("line", F.lit(_SPACE))) >= min_chars).withColumn("line", line_key(F.col("line")))
    return keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), *_DOC, "pos")


def hot_keys(lines: DataFrame, share: int = HOT_SHARE, buckets: int = BUCKETS) -> DataFrame:
    """h1, h2 of the less than `share` keys that hold more than 1/share of all rows of `lines`."""
    bucket = F.pmod("h1", F.lit(buckets)).alias("bucket")
    counts = lines.groupBy(bucket).agg(F.count("*").alias("n"))  # at most `buckets` rows
    least = counts.agg((F.sum("n") / share).alias("least"))
    some = counts.join(F.broadcast(least), F.col("n") > F.col("least")).select("bucket", "least")  # less than `share` rows
    rows = lines.select(*_KEY, bucket).join(F.broadcast(some), "bucket")
    return rows.groupBy(*_KEY).agg(F.count("*").alias("n"), F.first("least").alias("least")).filter("n > least").select(*_KEY)


def _of_hot(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    """Rows of _DOC and pos that go, of hot keys: counts by (key, document), then totals of less than HOT_SHARE keys."""
    rows = lines.join(F.broadcast(hot), _KEY)
    totals = rows.select(*_KEY, "doc_id").distinct().groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    gone = F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last"))
    return rows.join(F.broadcast(totals.select(*_KEY, "last")), _KEY).filter(gone).select(*_DOC, "pos")


def _of_ranges(lines: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    """Rows of _DOC and pos that go, of all other keys: hashes in ranges, sorted by document and position, streamed."""
    rows = lines.join(F.broadcast(hot), _KEY, "left_anti").repartitionByRange(*_KEY)
    last_first = [F.col("doc_id").desc_nulls_last(), F.col("pos")]
    rows = rows.sortWithinPartitions(*_KEY, *last_first)
    key = Window.partitionBy(*_KEY)
    place = F.dense_rank().over(key.orderBy(F.col("doc_id").desc_nulls_last()))
    ranked = rows.withColumn("place", place).withColumn("n", F.max("place").over(key))
    return ranked.filter((F.col("n") >= min_docs) & (F.col("place") > 1)).select(*_DOC, "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, text_hash, n_dropped, keep (array of gap, bits): a row for each distinct text of a document that loses lines."""
    lines = common.written(long_lines(docs, min_chars))
    hot = common.written(hot_keys(lines, hot_share))
    gone = _of_ranges(lines, hot, min_docs).unionByName(_of_hot(lines, hot, min_docs)).distinct()  # repeated rows of a text count once
    word, bit = F.floor(F.col("pos") / WORD).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD).cast("int"))
    words = gone.repartition(*_DOC).groupBy(*_DOC, word).agg(F.bit_or(bit).alias("gone"))  # both groupings share the exchange
    listed = words.groupBy(*_DOC).agg(F.sum(F.bit_count("gone")).alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "gone"))).alias("w"))
    before = F.concat(F.array(F.lit(-1)), F.transform("w", lambda x: x["word"]))
    keep = F.zip_with("w", before, lambda x, b: F.when(x.isNotNull(), F.struct((x["word"] - b - 1).alias("gap"), F.lit(FULL).bitwiseXOR(x["gone"]).alias("bits"))))
    return listed.select(*_DOC, "n_dropped", F.slice(keep, 1, F.size("w")).alias("keep"))


def _flags(keep: Column) -> Column:
    """A flag for each line up to the end of the last word of a bitmap; lines after it stay."""
    words = F.flatten(F.transform(keep, lambda x: F.concat(F.array_repeat(F.lit(FULL), x["gap"]), F.array(x["bits"]))))
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(w, i) == 1)))


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept: the texts of `docs` without the lines that their bitmaps leave out."""
    left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("text_hash"))
    maps = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "n_dropped", "keep")
    met = left.join(maps.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    lines = F.zip_with(F.split("text", "\n"), _flags(F.col("keep")), lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line))
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return met.select(
        "doc_id", "text", n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("keep").isNull(), text).otherwise(F.array_join(lines, "\n")).alias("kept"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return apply(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM x),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id < h.last AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
