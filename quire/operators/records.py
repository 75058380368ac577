"""Low-level records of files that are one stream each: rules, parents, counts, comparison by position.

`records`: file, ord, tag, level, size. What streams share with them is in `streams` and `levels`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config
from quire.operators import levels, streams


#: Rules on sections that need no payload.
RULES = ("R-040", "R-041", "R-042")


def findings(records: DataFrame) -> DataFrame:
    """file, ord, rule, severity: level jumps, controls without a list, texts without a head, as in the contract of a section."""
    rows = records.select("file", F.lit(f"{config.SECTION_STREAM}0").alias("stream"), "ord", "tag", "level", F.col("ord").alias("offset"), F.lit(None).cast("binary").alias("data"))
    found = streams.record_rules(rows).filter(F.col("rule").isin(*RULES))
    return found.select("file", F.col("offset").cast(records.schema["ord"].dataType).alias("ord"), "rule", "severity")


def parents(records: DataFrame) -> DataFrame:
    """Adds parent_ord: the nearest earlier record of a smaller level, or null."""
    found = levels.enclosed(records, ["file"], "ord")
    return found.select(*records.columns, F.col("above").cast(records.schema["ord"].dataType).alias("parent_ord"))


def tree_parents(records: DataFrame) -> DataFrame:
    """Adds parent_ord by the stack of open records: a record closes those from its level on, has the top one as parent, is pushed.

    A record past a gap in levels is pushed on the next free place; columns called depth or above are not kept apart from those.
    """
    found = levels.stacked(records, ["file"], "ord")
    return found.select(*records.columns, F.col("above").cast(records.schema["ord"].dataType).alias("parent_ord"))


def declared_count(data: Column) -> Column:
    """The little-endian number in the first two bytes of a payload; null for a shorter one."""
    return F.when(F.length(data) >= 2, F.conv(F.hex(F.concat(F.substring(data, 2, 1), F.substring(data, 1, 1))), 16, 10).cast("int"))


def wrong_list_counts(records: DataFrame) -> DataFrame:
    """file, ord, declared, actual of list headers whose `declared` is not the number of paragraph heads one level below them.

    A null `declared` (a payload too short) is a finding too. A head one level below belongs to the header that is its parent.
    """
    known = parents(records)
    heads = known.filter(F.col("tag") == config.PARA_HEAD).groupBy("file", F.col("parent_ord").alias("ord"), (F.col("level") - 1).alias("level")).agg(F.count("*").alias("actual"))
    lists = records.filter(F.col("tag") == config.LIST_HEADER).select("file", "ord", "level", "declared")
    counted = lists.join(heads, ["file", "ord", "level"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return counted.filter("declared IS NULL OR declared <> actual").select("file", "ord", "declared", "actual")


def compare(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """file, ord, kind, severity: differences record by record; another tag hides what else differs."""
    a = reference.select("file", "ord", *[F.col(c).alias(f"a_{c}") for c in ("tag", "level", "size")])
    b = candidate.select("file", "ord", *[F.col(c).alias(f"b_{c}") for c in ("tag", "level", "size")])
    both = a.join(b, ["file", "ord"], "full_outer")
    diff = lambda cond, kind, severity: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    same = F.col("a_tag") == F.col("b_tag")
    found = F.array(
        diff(F.col("b_tag").isNull(), "MISSING", "CRITICAL"), diff(F.col("a_tag").isNull(), "EXTRA", "HIGH"), diff(~same, "TAG", "HIGH"),
        diff(same & (F.col("a_level") != F.col("b_level")), "LEVEL", "HIGH"), diff(same & (F.col("a_size") != F.col("b_size")), "SIZE", "HIGH"),
    )
    return both.select("file", "ord", F.explode(F.array_compact(found)).alias("x")).select("file", "ord", "x.*")


def declared_and_actual(records: DataFrame, declared: DataFrame) -> DataFrame:
    """file, tag, declared, actual where the declared number of records of a tag is not the actual one."""
    actual = records.groupBy("file", "tag").agg(F.count("*").alias("actual"))
    return declared.join(actual, ["file", "tag"], "left").withColumn("actual", F.coalesce("actual", F.lit(0))).filter("declared <> actual")


def missing_tags(records: DataFrame, required: list[int]) -> DataFrame:
    """file, tag of required tags that a file lacks."""
    need = records.select("file").distinct().select("file", F.explode(F.array(*map(F.lit, required))).alias("tag"))
    return need.join(records.select("file", "tag").distinct(), ["file", "tag"], "left_anti")
