"""What encloses a row of a stream with levels: one pass with a stack over the sorted rows of each stream.

A window can't find the nearest earlier row of a smaller level without one expression for each level. Here Spark deals the rows
by stream and sorts them; a task then goes through them once, batch by batch, and holds the open rows: one for each level at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def enclosed(rows: DataFrame, key: list[str], order: str, level: str = "level", marked: str | None = None) -> DataFrame:
    """Adds above: `order` (a whole number) of the nearest earlier row of a smaller level, or null; shallower: how many earlier rows
    of a smaller level have `marked` true (0 without it).

    A row without a level is enclosed by nothing and encloses nothing. Rows of equal order come in any order; null keys are a key.
    """
    dealt = rows.repartition(*key).sortWithinPartitions(*key, order)
    names = dealt.columns
    key_at, order_at, level_at = [names.index(k) for k in key], names.index(order), names.index(level)
    marked_at = None if marked is None else names.index(marked)

    def run(batches):
        last, stack, marks = None, [], {}
        for batch in batches:
            above, shallower = [], []
            flags = [False] * batch.num_rows if marked_at is None else batch.column(marked_at).to_pylist()
            keys = zip(*(batch.column(i).to_pylist() for i in key_at), strict=True)
            for own, at, depth, flag in zip(keys, batch.column(order_at).to_pylist(), batch.column(level_at).to_pylist(), flags, strict=True):
                if own != last:
                    last, stack, marks = own, [], {}
                if depth is None:
                    above.append(None), shallower.append(0)
                    continue
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                above.append(stack[-1][1] if stack else None)
                shallower.append(sum(n for k, n in marks.items() if k < depth))
                stack.append((depth, at))
                if flag:
                    marks[depth] = marks.get(depth, 0) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above, pa.int64()), pa.array(shallower, pa.int64())], schema.names)

    schema = StructType([*dealt.schema.fields, StructField("above", LongType()), StructField("shallower", LongType())])
    return dealt.mapInArrow(run, schema)


def stacked(rows: DataFrame, key: list[str], order: str, level: str = "level") -> DataFrame:
    """Adds depth (from 1), the height of a stack on which each row goes after those from its level on have gone, and above.

    Past a gap in levels a row goes to the next free place: depth = min(level + 1, depth before + 1). Depths have no gaps.
    """
    w = Window.partitionBy(*key).orderBy(order)
    at = F.row_number().over(w)
    rows = rows.withColumn("_at", at)
    lowest = F.min(F.col(level) - F.col("_at")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_at") + 1
    rows = rows.withColumn("depth", F.when(F.col(level).isNotNull(), F.least(lowest, F.col("_at"))).cast("int")).drop("_at")
    return enclosed(rows, key, order, "depth").drop("shallower")
