"""Operator 10: weighted rendezvous hashing of record keys over shards, in DataFrame functions only.

A record goes to the shard with the largest score -weight / ln(u), where u in (0, 1) is hashed from the key and the shard.
The key and the shards decide alone (law `key`): with one more shard a record either stays or moves into the new one, and
each shard holds its weight's share of the keys. For equal weights the largest u decides, so no logarithm is taken.

The slot of a record is its rank in its shard by hashed key. It is found in two steps: records are counted for each shard
and leading BUCKET_DIGITS hex digits of the hashed key, the counts are added up (a table of at most shards x 4,096 rows),
and each record's rank in its own bucket is added. No shard is sorted as a whole.

Scale: the text is read once for its size and checksum and never shuffled; a row of some 60 bytes travels once.

Cases: a null text counts no bytes (size 1, checksum 0); a null doc_id is the empty key. Rows that repeat a doc_id go to one
shard and get slots of their own. Equal texts with different keys may part: under law `key` only the key decides.
An empty table gives no rows; columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

SHARDS = 8
BUCKET_DIGITS = 3
#: Hex digits of MD5 that make up u: 52 bits.
DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard)))), 1, DIGITS), 16, 10).cast("long")


def place(key: Column, weights: list[float]) -> Column:
    """The shard (int) of a key; ties go to the smaller shard."""
    equal = len(set(weights)) == 1
    scores = []
    for shard, weight in enumerate(weights):
        u = _draw(key, shard)
        score = u if equal else F.lit(-float(weight)) / F.log((u + 0.5) / F.lit(float(16**DIGITS)))
        scores.append(F.struct(score.alias("score"), F.lit(-shard).alias("shard")))
    return (-reduce(F.greatest, scores)["shard"]).cast("int") if len(scores) > 1 else F.lit(0)


def shard(docs: DataFrame, weights: list[float], new_weight: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) for each row of `docs` (doc_id, text)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(key).alias("order"))
    rows = rows.withColumns({"shard": place(key, weights), "grown_shard": place(key, [*weights, weights[-1] if new_weight is None else new_weight]), "bucket": F.substring("order", 1, BUCKET_DIGITS)})
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("order", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank)
    few = len(weights) * 16**BUCKET_DIGITS <= common.BROADCAST_ROWS  # the rows of `before`, at most
    placed = ranked.join(F.broadcast(before) if few else before, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read(spark, sf_dir, "documents"), [1.0] * SHARDS)


def _draw_sql(n: int) -> str:
    each = ", ".join(f"{{'u': CAST('0x' || substr(md5(k || ':{i}'), 1, {DIGITS}) AS BIGINT), 's': {-i}}}" for i in range(n))
    return f"CAST(-(list_max([{each}]).s) AS INTEGER)"


ORACLE = f"""
WITH t AS (SELECT [list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) for i in range(256)] AS t),
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, k, CAST(strlen(text) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, [CAST('0x' || x[2*j+1:2*j+2] AS BIGINT) for j in range(strlen(text))]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM d, t)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, {_draw_sql(SHARDS)} AS shard, CAST(row_number() OVER (PARTITION BY {_draw_sql(SHARDS)} ORDER BY md5(k), doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, {_draw_sql(SHARDS + 1)} AS grown_shard
FROM c
"""
