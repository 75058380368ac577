"""Operator 12: how document filters interact, over all orders in which they can be applied.

A document's failures are a mask of five bits. Applying filter f after the set S of filters is an edge of the lattice of subsets:
there are 5 * 2^4 = 80 edges, and a document contributes to each (removed, redundant or kept). An order of the filters is a path
of five edges; all 120 orders are 600 steps, which take their counts from the edges by a join on (S, f).

Filter E asks whether a smaller doc_id has the same text. Documents are counted without regard to E by (source, failures, labels);
those that pass E, one for each distinct text, are counted in the same way and moved from "fails" to "passes".

Scale: words are counted in the rows of the scan; a row of some 70 bytes for each document is written once (an MD5 of 16 bytes
stands for the text), and texts are never shuffled. The smallest doc_id of a text is found from partial minima, so that copies
of one text are a row for each task; first documents then meet by (text, doc_id), which parts the copies. Edges are made from
counts by (source, mask, labels), at most 128 rows for each source, never from documents. 600 steps are broadcast.

Cases: a null text is empty, and so equal to all empty ones; a text without words fails A only, unless it is a copy. Rows that
repeat a doc_id are counted each, and are no smaller than each other. A null doc_id is neither smaller nor larger than any, so
such rows pass E, and have no labels. A null source is the empty string. Of several labels of one doc_id each counts if any says
so. An empty table gives no rows. Other columns of `docs` are neither read nor returned.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

FILTERS = "ABCDE"
_SPACES = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each filter that looks at the text alone."""
    words = F.array_remove(F.split(text, _SPACES), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(fails: dict[str, Column]) -> Column:
    return sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in fails.items()), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, doc_id, digest (of the text), mask (failures but E), good, toxic for each row of `docs` (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", F.unhex(F.md5(text)).alias("digest"), _mask(failures(text)).alias("mask"))
    known = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    return rows.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def mask_counts(rows: DataFrame) -> DataFrame:
    """part, mask (all five failures), n, good, toxic (of them) from the rows of `judged`."""
    key = ["part", "mask", "good", "toxic"]
    copy = 1 << FILTERS.index("E")
    every = rows.withColumn("mask", F.col("mask") + F.lit(copy)).groupBy(*key).agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    passing = rows.join(first, ["digest", "doc_id"], "left_semi").unionByName(rows.filter("doc_id IS NULL"))
    passing = passing.groupBy(*key).agg(F.count("*").alias("n"))
    moved = passing.unionByName(passing.withColumns({"mask": F.col("mask") + F.lit(copy), "n": -F.col("n")})).unionByName(every)
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return moved.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def edges() -> list[tuple[int, int]]:
    """(mask of the filters applied before, index of the next filter) of all edges of the lattice."""
    own = range(len(FILTERS))
    return [(sum(1 << i for i in before), f) for f in own for k in own for before in combinations([i for i in own if i != f], k)]


def edge_counts(counts: DataFrame) -> DataFrame:
    """part, before, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part and edge."""
    each = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter"), F.lit(factorial(bin(s).count("1")) * factorial(len(FILTERS) - 1 - bin(s).count("1"))).alias("orders")) for s, f in edges()])
    rows = counts.withColumn("e", F.explode(each)).select("*", "e.*")
    fails = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("filter"))) != 0
    open_ = F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda cond, value="n": F.sum(F.when(cond, F.col(value)).otherwise(0)).alias
    out = rows.groupBy("part", "before", "filter", "orders").agg(
        total(~fails & open_)("kept"), total(fails & open_)("removed"), total(fails & ~open_)("redundant"), total(F.col("mask") == F.call_function("shiftleft", F.lit(1), F.col("filter")))("unique_fails"),
        total(fails & open_, "good")("good_lost"), total(fails & open_, "toxic")("toxic_lost"),
    )
    shapley = out.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return out.join(shapley, ["part", "filter"]).drop("orders")


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, before, filter) of the steps of all orders."""
    return [("".join(p), i + 1, sum(1 << FILTERS.index(x) for x in p[:i]), FILTERS.index(f)) for p in permutations(FILTERS) for i, f in enumerate(p)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each part, order of the filters and step."""
    found = edge_counts(mask_counts(common.written(judged(docs, labels))))
    paths = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, before int, filter int")
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.join(F.broadcast(paths), ["before", "filter"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


_FAIL = " OR ".join(f"(contains(substr(o, 1, step - 1), '{x}') AND {x.lower()})" for x in FILTERS)
_OWN = "CASE f " + " ".join(f"WHEN '{x}' THEN {x.lower()}" for x in FILTERS) + " END"
_N_FAILS = " + ".join(f"CAST({x.lower()} AS INTEGER)" for x in FILTERS)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(w.doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, a, b, c, d, e, {_N_FAILS} AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT v.x || w.x || x.x || y.x || z.x AS o FROM x v, x w, x, x y, x z WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS f FROM p, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, o, CAST(step AS INTEGER) AS step, f, n, good, toxic, fails, {_OWN} AS own, ({_FAIL}) AS before FROM g, s),
r AS (SELECT part, o AS filter_order, step, f, sum(CASE WHEN NOT own AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT before THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND before THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM m GROUP BY part, o, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
