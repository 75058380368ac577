"""Reports into sections, sections into features, scores and candidates.

A report is split in its own row; features and scores are expressions over a section's text. Only `lines`, `with_parents` and
`ranking` go by doc_id and shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T


def lines(reports: DataFrame) -> DataFrame:
    """doc_id, ord, line, start: lines of `reports` (doc_id, md) with their offsets in code points."""
    rows = reports.select("doc_id", F.posexplode(F.split("md", "\n")).alias("ord", "line"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    return rows.withColumn("start", (F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).cast("long"))


def split_sections(reports: DataFrame, paths: bool = False) -> DataFrame:
    """doc_id, ord, section_id, depth, title, text, char_start, char_end; with paths also parent_path and section_path.

    Lines before the first heading belong to no section. A report without a heading is one section of depth 0; a blank or null
    report has none. All is found in the row of a report: its lines are an array, a section a slice of it between two headings,
    and one fold over the sections adds up their lengths and keeps the stack of titles. No row meets another, so that reports of
    equal or null doc_id stay apart, each with sections of its own.
    """
    rows = reports.select("doc_id", "md", F.split("md", "\n").alias("_lines"))
    marked = F.filter(F.transform("_lines", lambda x, i: F.when(T.may_be_heading(x), F.struct(i.alias("at"), x.alias("line"), T.strip(x).alias("bare")))), lambda h: h.isNotNull())
    found = F.transform(marked, lambda h: F.struct(h["at"].alias("at"), T.stripped_depth(h["bare"]).alias("depth"), h["line"].alias("line")))
    rows = rows.withColumn("_heads", F.filter(found, lambda h: h["depth"].isNotNull()))
    until = lambda k: F.coalesce(F.get("_heads", k + 1)["at"], F.size("_lines"))
    body = lambda h, k: F.array_join(F.slice("_lines", h["at"] + 1, until(k) - h["at"]), "\n")
    parts = F.transform("_heads", lambda h, k: F.struct(h["depth"].alias("depth"), T.title(h["line"]).alias("title"), body(h, k).alias("body")))
    whole = F.array(F.struct(F.lit(0).alias("depth"), F.lit(config.WHOLE_TITLE).alias("title"), F.col("md").alias("body")))
    rows = rows.withColumn("_parts", F.when(F.size("_heads") > 0, parts).when(T.strip(F.col("md")) != "", whole))
    first = F.get("_heads", F.lit(0))["at"]
    start = F.when(first > 0, F.length(F.array_join(F.slice("_lines", F.lit(1), first), "\n")) + 1).otherwise(0).cast("long")
    texts = F.array().cast("array<string>")
    none = F.array().cast("array<struct<char_start:bigint,char_end:bigint,above:string>>")
    state = lambda at, stack, out: F.struct(at.alias("at"), stack.alias("stack"), out.alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x["body"]) + 1
        above = F.slice(a["stack"], F.lit(1), F.greatest(x["depth"] - 1, F.lit(0))) if paths else texts
        stack = F.concat(above, F.array(x["title"])) if paths else texts
        return state(end, stack, F.concat(a["out"], F.array(F.struct(a["at"].alias("char_start"), end.alias("char_end"), F.array_join(above, " > ").alias("above")))))

    places = F.aggregate("_parts", state(start, texts, none), step, lambda a: a["out"])
    rows = rows.select("doc_id", F.size("_parts").alias("_n"), F.posexplode(F.arrays_zip("_parts", places.alias("_places"))).alias("ord", "_s"))
    part, place = F.col("_s._parts"), F.col("_s._places")
    path = [place["above"].alias("parent_path"), F.when(place["above"] == "", part["title"]).otherwise(F.concat_ws(" > ", place["above"], part["title"])).alias("section_path")]
    return rows.select(
        "doc_id", "ord", F.concat(F.lit("S"), F.col("ord")).alias("section_id"), part["depth"].alias("depth"), part["title"].alias("title"), F.when(part["depth"] > 0, T.strip(part["body"])).otherwise(part["body"]).alias("text"),
        place["char_start"].alias("char_start"), (place["char_end"] - F.when(F.col("ord") == F.col("_n") - 1, 1).otherwise(0)).alias("char_end"), *(path if paths else []),
    )


def with_parents(sections: DataFrame) -> DataFrame:
    """Adds parent_path and section_path to sections that don't come from `split_sections`. The ancestors are a stack cut to depth - 1, so that depth gaps make siblings nest.

    The height of the stack is min(depth, height before + 1), a running minimum; the ancestor at height k is the last section
    of that height. All windows share the key and order of the sections.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.row_number().over(w)
    height = at + F.least(F.lit(0), F.min(F.col("depth") - F.col("_at")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = sections.withColumn("_at", at).withColumn("_height", height)
    above = [F.when(F.col("_height") > k, F.last(F.when(F.col("_height") == k, F.col("title")), ignorenulls=True).over(past)) for k in range(1, config.MAX_MARKDOWN_DEPTH)]
    rows = rows.withColumn("parent_path", F.concat_ws(" > ", *above)).drop("_at", "_height")
    return rows.withColumn("section_path", F.when(F.col("parent_path") == "", F.col("title")).otherwise(F.concat_ws(" > ", "parent_path", "title")))


def features(sections: DataFrame, words: config.Lexicons = config.Lexicons()) -> DataFrame:
    """Adds length, numeric_density, four word counts, has_table and is_top."""
    t = F.col("text")
    return sections.withColumns({
        "length": F.length(t), "numeric_density": T.occurrences(t, words.number) / F.greatest(T.n_tokens(t), F.lit(1)),
        **{f"{k}_words": T.occurrences(t, getattr(words, k)) for k in ("comparison", "process", "space", "evidence")},
        "has_table": t.rlike(r"(?md)^[|].*[|]$"), "is_top": (F.col("ord") == 0) | ((F.col("depth") == 1) & (F.col("ord") <= 2)),
    })


def scores(featured: DataFrame, words: config.Lexicons = config.Lexicons()) -> DataFrame:
    """Adds t1 to t6, each from 0 to 1."""
    c, one = F.col, F.lit(1.0)
    t2 = F.least(one, c("numeric_density") * 0.4 + c("comparison_words") * 0.2) * F.when(c("has_table"), 0.3).otherwise(1.0)
    return featured.withColumns({
        "t1": F.when(c("text").rlike(words.definition), 0.3).otherwise(0.0), "t2": t2,
        "t3": F.least(one, c("space_words") * 0.5), "t4": F.least(one, c("process_words") * 0.5),
        "t5": F.when((c("evidence_words") > 0) & (c("numeric_density") > 0), 0.3).otherwise(0.0),
        "t6": F.when((c("depth") == 1) & c("is_top"), 0.2).otherwise(0.0),
    })


TRIGGERS = ("t1", "t2", "t3", "t4", "t5", "t6")


def candidates(scored: DataFrame) -> DataFrame:
    """Sections with a high score. A row is made whole before it is judged: a plain filter would make all features twice."""
    rows = scored.select(F.explode(F.array(F.struct(*scored.columns))).alias("_s"))
    return rows.filter(F.greatest(*[F.col(f"_s.{t}") for t in TRIGGERS]) >= config.CANDIDATE_SCORE).select("_s.*")


def dominant() -> Column:
    """The first trigger with the highest score."""
    best = F.greatest(*TRIGGERS)
    return reduce(lambda c, t: c.when(F.col(t) == best, t.upper()), TRIGGERS[1:], F.when(F.col("t1") == best, "T1"))


def figure_type(trigger: Column, text: Column, words: config.TypeWords = config.TypeWords()) -> Column:
    """The type of figure that a dominant trigger and the text call for."""
    return (
        F.when(trigger == "T6", "cover_banner")
        .when(trigger == "T3", F.when(text.rlike(words.maps), "map_layout").when(text.rlike(words.plans), "floor_plan").when(text.rlike(words.views), "rendering").otherwise("map_layout"))
        .when(trigger == "T4", F.when(T.occurrences(text, words.dates) >= 3, "roadmap").otherwise("flow_chart"))
        .when(trigger == "T2", F.when(T.occurrences(text, words.numbers) >= 5, "bar_chart").otherwise("comparison_table"))
        .when(trigger == "T5", F.when(text.rlike(words.trends), "line_chart").otherwise("photo"))
        .otherwise("concept_diagram")
    )


def ranking(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k sections of each document with the highest score (the feature: a top-k report)."""
    best = F.greatest(*TRIGGERS)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(best.desc(), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
