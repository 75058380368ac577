"""Operator 6: chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat services often log a conversation again after each turn. Every turn gets the rolling hash of all turns up to it: the
exclusive or of hashes of (position, role, text), two of 64 bits. A conversation whose full hash is the hash of a shorter
part of another one is a snapshot of it; of equal conversations the smallest conv_id stays. Both are removed by anti-joins,
and what remains is rendered.

Scale: what is numbered, hashed and joined are rows without texts, which carry an MD5 of the text; they are dealt once, by
(conv_id, block of BLOCK turn numbers), so that one endless conversation is many small groups. A block of more than HOT rows, such
as that of a conversation without turn numbers, is cut further, by turn, role and the start of the MD5. Counts and hashes of the
blocks before come from windows over the few rows of blocks. Up to `common.BROADCAST_ROWS` maximal conversations meet their turns
by a checked broadcast; with more of them the texts are dealt by conv_id alone, so that an endless conversation is one task there. Prefixes are pre-aggregated before they meet, so that a first turn
that opens very many conversations is one row. Texts are shuffled once, and only those of the conversations that stay; each
block is rendered as a text of its own, so that no text grows without bound.

Cases: turns are ordered by (turn, role, MD5 of the text) and numbered; repeated rows are turns of their own (equal ones of a block
meet in one group). Null roles are rendered as `user`, null texts as empty, null turns count as 0. Rows without a conv_id are
dropped, since they belong to no conversation. Markers inside roles and texts are escaped by a backslash, so that no text can
forge a turn. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

BLOCK = 256
#: Rows of a block that may meet in one group.
HOT = 4096
KEY = ["conv_id", "part", "bucket"]


def _keyed(turns: DataFrame) -> DataFrame:
    """conv_id, part, bucket, turn, role, d (MD5 of the text), text; the order of parts and buckets is that of turns."""
    rows = turns.filter("conv_id IS NOT NULL").select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"d": F.md5("text"), "part": F.floor(F.col("turn") / BLOCK)})
    hot = common.durable(rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("conv_id", "part", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return rows.withColumn("bucket", F.lit(""))
    fine = F.concat(F.lpad(F.hex(F.col("turn") - F.col("part") * BLOCK), 2, "0"), "role", F.lit("\0"), F.substring("d", 1, 3))
    return rows.join(F.broadcast(hot) if common.small_enough(hot) else hot, ["conv_id", "part"], "left").withColumn("bucket", F.when(F.col("hot"), fine).otherwise("")).drop("hot")


def prefixes(keyed: DataFrame) -> DataFrame:
    """conv_id, length, h1, h2: the rolling hash of the first `length` turns, for each length."""
    own = Window.partitionBy(*KEY).orderBy("turn", "role", "d")
    past = Window.partitionBy("conv_id").orderBy("part", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = keyed.select(*KEY, "turn", "role", "d")
    before = each.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(past)).filter("before > 0").select(*KEY, "before")
    placed = each.withColumn("rank", F.row_number().over(own)).join(before, KEY, "left").withColumn("position", F.coalesce("before", F.lit(0)) + F.col("rank") - 1)
    hashed = placed.withColumns({f"x{i}": F.xxhash64(F.lit(i), "position", "role", "d") for i in (1, 2)})
    run = hashed.select(*KEY, "position", *[F.expr(f"bit_xor(x{i})").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(f"r{i}") for i in (1, 2)])
    blocks = hashed.groupBy(*KEY).agg(*[F.expr(f"bit_xor(x{i})").alias(f"b{i}") for i in (1, 2)])
    carried = blocks.select(*KEY, *[F.expr(f"bit_xor(b{i})").over(past).alias(f"c{i}") for i in (1, 2)]).filter("c1 IS NOT NULL")
    return run.join(carried, KEY, "left").select("conv_id", (F.col("position") + 1).alias("length"), *[F.col(f"r{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))).alias(f"h{i}") for i in (1, 2)])


def maximal(rolling: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are no snapshot of another one."""
    full = rolling.groupBy("conv_id").agg(F.max(F.struct("length", "h1", "h2")).alias("x")).select("conv_id", "x.*")
    whole = full.select(F.col("conv_id"), F.col("length").alias("n"))
    inner = rolling.join(whole, "conv_id").filter("length < n").groupBy("length", "h1", "h2").agg(F.count("*").alias("of")).drop("of")
    first = full.groupBy("length", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return first.join(inner, ["length", "h1", "h2"], "left_anti").select("conv_id", F.col("length").alias("n_turns"))


def _plain(c: str, head: str) -> Column:
    """The text with the sign that opens a marker escaped: its second half gets a backslash before it, and so does a backslash there."""
    first, second = head[:1], head[1:]
    return F.replace(F.replace(F.col(c), F.lit(f"{first}\\"), F.lit(f"{first}\\\\")), F.lit(head), F.lit(f"{first}\\{second}"))


def format_chats(turns: DataFrame, head: str = "<|", foot: str = "|>") -> DataFrame:
    """conv_id, n_turns, part (from 0), text for each block of the maximal conversations in `turns` (conv_id, turn, role, text)."""
    keyed = _keyed(turns)
    kept = common.durable(maximal(common.durable(prefixes(keyed))))
    rows = keyed.join(F.broadcast(kept) if common.small_enough(kept) else kept, "conv_id")
    segment = F.concat(F.lit(head), _plain("role", head), F.lit(f"{foot}\n"), _plain("text", head), F.lit(f"\n{head}end{foot}\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "d", segment.alias("s")))), lambda x: x["s"]), "")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "bucket")) - 1
    order = rows.select(*KEY).distinct().withColumn("at", at.cast("long"))
    # grouped by KEY alone, so that the texts stay where they are for the join
    return rows.groupBy(*KEY).agg(F.first("n_turns").alias("n_turns"), text.alias("text")).join(order, KEY).select("conv_id", "n_turns", F.col("at").alias("part"), "text")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(common.read(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, 0), coalesce(role, 'user'), md5(coalesce(text, ''))) - 1 AS p, coalesce(turn, 0) // {BLOCK} AS b, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, p, b, '<|' || replace(replace(role, '<\\', '<\\\\'), '<|', '<\\|') || '|>' || chr(10) || replace(replace(text, '<\\', '<\\\\'), '<|', '<\\|') || chr(10) || '<|end|>' || chr(10) AS s FROM t),
r AS (SELECT conv_id, p, sha256(string_agg(s, chr(0)) OVER (PARTITION BY conv_id ORDER BY p)) AS h FROM c),
f AS (SELECT conv_id, max(p) + 1 AS n, arg_max(h, p) AS h FROM r GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, n FROM f WHERE NOT EXISTS (SELECT 1 FROM r JOIN f AS g USING (conv_id) WHERE r.h = f.h AND r.p + 1 < g.n) GROUP BY h, n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, dense_rank() OVER (PARTITION BY conv_id ORDER BY b) - 1 AS part, string_agg(s, '' ORDER BY p) AS text FROM c JOIN k USING (conv_id) GROUP BY conv_id, n, b
"""
