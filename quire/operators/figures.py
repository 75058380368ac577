"""Figures: majority vote over runs, reviews, positions, top-k, island merge, near-duplicate removal, renumbering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config
from quire.operators.numbering import numbered

#: Digits of mean scores by which figures are ordered.
SCORE_DIGITS = 9


def vote(figures: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Keeps (section_path, figure_type) groups with a majority of the document's runs, numbered in order of first appearance.

    `figures`: doc_id, run_id, pos, section_path, figure_type, confidence, final_score, suggested_content, and more, which the
    first figure of a group keeps. `results` (doc_id, run_id) lists all successful runs, also those without figures; without it
    the runs that have figures count. vote_rank is the order by score. The items of a group are reduced to the distinct ones
    before they are gathered, and only the first CONTENT_ITEMS of these are. Paths, which may be long, are grouped by their MD5, so that
    the items are shuffled without them; groups meet their items before the number of runs, by the key that both have. Figures are ordered by rounded scores, since the order
    in which the parts of a mean meet would else decide between equal ones.
    """
    names, key, first = ["doc_id", "section_path", "figure_type"], ["doc_id", "_path", "figure_type"], F.struct("run_id", "pos")
    figures = figures.withColumns({c: F.coalesce(c, F.lit("")) for c in names[1:]}).withColumn("_path", F.unhex(F.md5("section_path")))
    n = (figures if results is None else results).groupBy("doc_id").agg(F.count_distinct("run_id").alias("n"))
    own = [c for c in figures.columns if c not in (*names, "_path", "run_id", "pos", "confidence", "final_score", "suggested_content")]
    groups = figures.groupBy(*key).agg(
        F.min("section_path").alias("section_path"), F.count("*").alias("vote_count"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.avg(F.coalesce("final_score", F.lit(0.0))).alias("final_score"),
        F.min(first).alias("first"), *[F.min_by(c, first).alias(c) for c in own],
    )
    items = figures.select(*key, "run_id", "pos", F.posexplode("suggested_content").alias("at", "item")).groupBy(*key, "item").agg(F.min(F.struct("run_id", "pos", "at")).alias("seen"))
    items = items.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("seen"))).filter(F.col("rank") <= config.CONTENT_ITEMS)
    items = items.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("suggested_content"))
    kept = groups.join(items, key, "left").join(n, "doc_id").filter(F.col("vote_count") >= F.floor(F.col("n") / 2) + 1)
    kept = kept.select(*names, *[c for c in groups.columns if c not in (*names, "_path")], "suggested_content", "n")
    kept = kept.withColumn("suggested_content", F.coalesce("suggested_content", F.array().cast("array<string>")))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("final_score", SCORE_DIGITS).desc(), "first"))
    return kept.withColumns({"figure_id": F.concat(F.lit("F"), ordinal), "vote_rank": rank}).drop("n", "first")


def review(figures: DataFrame, reviews: DataFrame) -> DataFrame:
    """Drops figures that their last review rejects; a review may name another type. Without a review a figure stays."""
    last = reviews.groupBy("doc_id", "figure_id").agg(F.max_by(F.struct("approved", "alternative"), "ord").alias("r"))
    out = figures.join(last, ["doc_id", "figure_id"], "left").filter(F.coalesce("r.approved", F.lit(True)))
    return out.withColumn("figure_type", reviewed_type(F.col("figure_type"), F.col("r.alternative"))).drop("r")


def reviewed_type(own: Column, alternative: Column) -> Column:
    """The type that a review names, else a figure's own."""
    return F.coalesce(F.when(~alternative.isin("", "null"), alternative), own)


def allowed(total_chars: Column, limit: int = config.MAX_FIGURES) -> Column:
    return F.greatest(F.lit(1), F.least(F.floor(total_chars / config.CHARS_PER_FIGURE), F.lit(limit))).cast("int")


def top_k(figures: DataFrame) -> DataFrame:
    """The figures of each document with the highest scores, as many as its total_chars allow."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("final_score", SCORE_DIGITS).desc(), "pos"))
    return figures.withColumn("rank", rank).filter(F.col("rank") <= allowed(F.col("total_chars")))


def merge_islands(ranked: DataFrame) -> DataFrame:
    """Neighbours in order of rank with equal section and type become one: the first, with the others' unseen content items (where given) added.

    The figures of a document, few as `top_k` leaves, are one array, cut into islands where section or type changes.
    """
    own = [c for c in ranked.columns if c not in ("doc_id", "final_score", "suggested_content", "island")]
    rows = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in ranked.columns if c not in ("doc_id", "rank", "island")]))).alias("_figures"))
    at = lambda i: F.get("_figures", i)
    same = lambda i: at(i)["section_path"].eqNullSafe(at(i - 1)["section_path"]) & at(i)["figure_type"].eqNullSafe(at(i - 1)["figure_type"])
    starts = F.filter(F.sequence(F.lit(0), F.size("_figures") - 1), lambda i: (i == 0) | ~same(i))
    rows = rows.withColumn("_starts", starts)
    ends = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_figures"))
    islands = F.transform("_starts", lambda i, k: F.slice("_figures", i + 1, ends(k) - i))
    rows = rows.select("doc_id", F.posexplode(islands).alias("island", "_i"))
    items = F.transform("_i", lambda x: F.coalesce(x["suggested_content"], F.array().cast("array<string>")))
    content = F.aggregate(items, F.array().cast("array<string>"), lambda seen, new: F.concat(seen, F.filter(new, lambda x: ~F.array_contains(seen, x))))
    first, made = F.get("_i", F.lit(0)), [content.alias("suggested_content")] if "suggested_content" in ranked.columns else []
    return rows.select(
        "doc_id", (F.col("island") + 1).cast("long").alias("island"), F.array_max(F.transform("_i", lambda x: x["final_score"])).alias("final_score"), F.size("_i").cast("long").alias("merged"), *made, *[first[c].alias(c) for c in own],
    )


def renumber(figures: DataFrame, *order: Column | str) -> DataFrame:
    return figures.withColumn("figure_id", F.concat(F.lit("F"), F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))))


def in_document_order(figures: DataFrame) -> DataFrame:
    return renumber(figures, F.col("char_start").asc_nulls_last(), "island")


def flat(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def anchor_exists(anchor: Column, text: Column, flat_text: Column | None = None) -> Column:
    """At least ten characters of anchor that occur as they are, with other white space, or in a run of seven tenths.

    `flat_text` is `flat(text)` where a caller has it as a column: here it would be made once for each run that is tried.
    """
    a, t = flat(anchor), flat(text) if flat_text is None else flat_text
    part = F.floor(F.length(a) * config.ANCHOR_SHARE).cast("int")
    part = F.greatest(part, F.lit(1))
    windows = F.sequence(F.lit(0), F.length(a) - part)
    some = F.exists(windows, lambda i: F.contains(t, F.substring(a, i + 1, part)))
    return (F.length(anchor) >= config.MIN_ANCHOR) & (F.contains(text, anchor) | F.contains(t, a) | some)


def in_report(figures: DataFrame, reports: DataFrame) -> DataFrame:
    """Adds total_chars, here (char_start and char_end of the anchor, or null) and anchored (whether it exists at all).

    The figures of a document, as one array, meet its text once; no text is copied for a figure or goes on with it. Figures
    without a report are kept, with nulls.
    """
    own = figures.columns
    gathered = figures.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_figures"))
    met = gathered.join(reports.select("doc_id", "md"), "doc_id", "left").withColumn("_flat", flat(F.col("md")))
    rows = met.select(F.length("md").alias("total_chars"), F.explode(F.transform("_figures", lambda f: F.struct(f.alias("f"), anchor_place(f["anchor_text"]).alias("here"), anchored(f["anchor_text"]).alias("anchored")))).alias("x"))
    return rows.select(*[F.col(f"x.f.{c}").alias(c) for c in own], "total_chars", F.col("x.here").alias("here"), F.col("x.anchored").alias("anchored"))


def anchor_place(anchor: Column) -> Column:
    """char_start and char_end of an anchor in the report `md` of its row, or null."""
    found = F.array(F.when(anchor != "", F.position(anchor, F.col("md"))))  # looked for once
    return F.get(F.transform(found, lambda at: F.when(at > 0, F.struct((at - 1).cast("long").alias("char_start"), (at - 1 + F.length(anchor)).cast("long").alias("char_end")))), F.lit(0))


def anchored(anchor: Column) -> Column:
    """Whether an anchor exists in the report `md` of its row, whose flat text is `_flat`."""
    return F.coalesce(anchor_exists(F.coalesce(anchor, F.lit("")), F.col("md"), F.col("_flat")), F.lit(False))


def drop_similar(figures: DataFrame, order: str = "pos") -> DataFrame:
    """In document order, a figure goes if its purpose shares over six tenths of its words with one kept before.

    Of figures with equal sets of words only the first takes part in the comparison: whatever drops it drops the others, and else
    it drops them itself. Words are taken once for each figure.
    """
    rows = figures.withColumn("_words", _purpose_words())
    first = rows.filter(F.size("_words") > 0).groupBy("doc_id", "_words").agg(F.min(order).alias("_first"))
    each = F.array_sort(F.collect_list(F.struct("_first", "_words")))
    kept = F.aggregate(each, F.slice(each, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: _similar(x["_words"], y["_words"])), acc).otherwise(F.concat(acc, F.array(x))))
    kept = first.groupBy("doc_id").agg(F.transform(kept, lambda x: x["_first"]).alias("k")).select("doc_id", F.explode("k").alias(order))
    some = rows.filter(F.size("_words") > 0).join(kept, ["doc_id", order], "left_semi")
    return some.unionByName(rows.filter(F.size("_words") == 0)).select(*figures.columns)


def _purpose_words() -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.coalesce("purpose", F.lit("")), r"(?U)\s+"), "")))


def _similar(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) > config.MAX_OVERLAP


def drop_similar_few(figures: DataFrame, order: str = "pos") -> DataFrame:
    """`drop_similar` where a document has few figures, as in a plan: they are one array, so that nothing is dealt out again. `order` is unique in a document."""
    own = [c for c in figures.columns if c != "doc_id"]
    rows = figures.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), _purpose_words().alias("_words"), F.struct(*own).alias("f")))).alias("_figures"))
    again = lambda acc, x: (F.size(x["_words"]) > 0) & F.exists(acc, lambda y: _similar(x["_words"], y["_words"]))
    kept = F.aggregate("_figures", F.slice("_figures", 1, 0), lambda acc, x: F.when(again(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("doc_id", F.explode(kept).alias("x")).select(*[F.col(c if c == "doc_id" else f"x.f.{c}") for c in figures.columns])


def locate(figures: DataFrame, reports: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds char_start and char_end: of the anchor in the report, else of the section path, else of the first title in the path."""
    own = [c for c in figures.columns if c not in ("total_chars", "here", "anchored")]
    return place(in_report(figures.select(*own), reports), sections).select(*own, "char_start", "char_end")


def place(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds char_start and char_end to figures that `in_report` has met with their reports.

    Of sections with the same path or title the last one counts; titles are tried in order of first appearance. The titles of a
    report meet its figures as one array, so that no pairs are made.
    """
    at = F.struct("char_start", "char_end")
    paths = sections.groupBy("doc_id", "section_path").agg(F.max_by(at, "ord").alias("by_path"))
    titles = sections.filter("title <> ''").groupBy("doc_id", "title").agg(F.min("ord").alias("first"), F.max_by(at, "ord").alias("at"))
    titles = titles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "title", "at"))).alias("titles"))
    known = figures.join(paths, ["doc_id", "section_path"], "left").join(titles, "doc_id", "left")
    by_title = F.get(F.filter("titles", lambda t: F.contains(F.col("section_path"), t["title"])), F.lit(0))["at"]
    return known.withColumn("_at", F.coalesce("here", "by_path", by_title)).select(*figures.columns, "_at.char_start", "_at.char_end")


#: What a figure has that a review adds.
ADDED = {"figure_type": "concept_diagram", "confidence": 0.5, "final_score": 0.6, "cognitive_load": 0.6, "position_hint": "after", "image_prompt_seed": "", "critic_approved": True}


def added(given: Callable[[str], Column | None], number: Column) -> dict[str, Column]:
    """The fields of a figure that a review adds, by name: fixed ones, and those that the review may have given (else None)."""
    some = lambda c, kind="string": F.lit(None).cast(kind) if given(c) is None else given(c)
    return {
        "figure_id": F.concat(F.lit("F"), number), **{c: F.coalesce(some(c), F.lit("")) for c in ("section_path", "anchor_text", "purpose")}, "figure_type": F.coalesce(some("figure_type"), F.lit(ADDED["figure_type"])),
        "confidence": F.coalesce(some("confidence", "double"), F.lit(ADDED["confidence"])), **{k: F.lit(v) for k, v in ADDED.items() if k not in ("figure_type", "confidence")},
        "vote_count": F.lit(1).cast("long"), "suggested_content": F.array().cast("array<string>"), **{t: F.lit(0.0) for t in ("t1", "t2", "t3", "t4", "t5", "t6")},
    }


def add_missing(approved: DataFrame, voted: DataFrame, missing: DataFrame) -> DataFrame:
    """`approved` and the figures that a review adds, numbered on from the voted ones; they have fixed scores, no content and one vote.

    `missing`: doc_id, pos, section_path, figure_type, confidence, and perhaps anchor_text and purpose. Of the fixed fields those
    that `approved` lacks are null on its side. Additions are numbered in blocks of positions.
    """
    n = voted.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = numbered(missing, ["doc_id"], "pos", "_n").join(n, "doc_id", "left")
    fields = added(lambda c: F.col(c) if c in missing.columns else None, F.coalesce("n", F.lit(0)) + F.col("_n"))
    return approved.unionByName(rows.select("doc_id", *[v.alias(k) for k, v in fields.items()]), allowMissingColumns=True)


def drop_repeated(figures: DataFrame) -> DataFrame:
    """Of figures with equal anchor (else opening of the purpose), type and section the first one in each document."""
    anchor = F.lower(F.trim(F.coalesce("anchor_text", F.lit(""))))
    key = F.when(anchor != "", anchor).otherwise(F.lower(F.substring(F.coalesce("purpose", F.lit("")), 1, 30)))
    return figures.groupBy("doc_id", key.alias("key"), "figure_type", F.coalesce("section_path", F.lit("")).alias("section_path")).agg(F.min("pos").alias("pos")).drop("key")
