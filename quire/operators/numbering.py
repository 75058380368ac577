"""Consecutive numbers without a window over a whole table or document: counts of blocks first, then ranks within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that are numbered together.
BLOCK = 1024


def numbered(rows: DataFrame, key: list[str], order: str, name: str, *ties: Column | str, block: int = BLOCK) -> DataFrame:
    """Adds `name`: the rank (from 1) of each row among those with equal `key`, by the whole number `order`, then by `ties`.

    Rows are ranked within blocks of `block` values of `order`; the sizes of the blocks before are added. Only the blocks of a key
    are sorted as a whole, never its rows. Null keys are keys like any other; a null order comes first.
    """
    part = F.coalesce(F.floor(F.col(order) / block), F.lit(-(2**62)))
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy(*key, "_part").agg(F.count("*").alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_own")
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rank = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.col(order).asc_nulls_first(), *ties))
    return rows.withColumn("_rank", rank).join(before, same).withColumn(name, F.col("_before") + F.col("_rank")).drop("_part", "_p", "_rank", "_before", *[f"_k{i}" for i in range(len(key))])


def dense_ids(uses: DataFrame, marks: DataFrame, known: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """`uses` (doc_id, pos, key) with id: that of `known` (doc_id, key, id), else new ids after the document's mark, in order of first use.

    Equal keys of a document share an id. `marks`: doc_id, high (the largest id in use; 0 where a document has none). Keys are
    reduced to distinct ones before they are numbered. A null key gets no id.
    """
    keys = uses.filter("key IS NOT NULL").groupBy("doc_id", "key").agg(F.min("pos").alias("_first"))
    held = keys.select("doc_id", "key").limit(0).withColumn("id", F.lit(None).cast("long")) if known is None else known.groupBy("doc_id", "key").agg(F.min("id").cast("long").alias("id"))
    new = numbered(keys.join(held, ["doc_id", "key"], "left_anti"), ["doc_id"], "_first", "_n", "key", block=block).join(marks.groupBy("doc_id").agg(F.max("high").alias("_high")), "doc_id", "left")
    ids = new.select("doc_id", "key", (F.coalesce("_high", F.lit(0)) + F.col("_n")).cast("long").alias("id")).unionByName(held)
    return uses.join(ids, ["doc_id", "key"], "left").select(*uses.columns, "id")


def high_water(elements: DataFrame, floor: int = 0) -> DataFrame:
    """doc_id, high: the largest whole number among the `id` texts of a document's elements, at least `floor`."""
    number = F.when(F.trim("id").rlike(r"^[+-]?[0-9]{1,18}$"), F.trim("id").cast("long"))
    return elements.groupBy("doc_id").agg(F.greatest(F.lit(floor).cast("long"), F.coalesce(F.max(number), F.lit(floor).cast("long"))).alias("high"))
