"""From merged figures to the final plan: types, positions, choice, checks, and the report of a document.

All is keyed by doc_id. A document's figures meet its report once; what is decided in order is a window or a fold over at most
MAX_FIGURES figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quire import config
from quire.functions import text as T
from quire.operators import figures as G
from quire.operators import sections as S

#: What a figure of the vision planner has where it says nothing.
DEFAULTS = {"position_hint": "after", "figure_type": "concept_diagram", "cognitive_load": 0.7, "image_prompt_seed": "", "vote_count": 1, "critic_approved": True}
DEFAULT_CONFIDENCE = 0.7


def with_defaults(figures: DataFrame, order: str = "pos") -> DataFrame:
    """Fills what figures lack: DEFAULTS, trigger scores 0, no content, score from the confidence, ids in order. Null stands for missing."""
    have = lambda c: F.col(c) if c in figures.columns else F.lit(None)
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    confidence = F.coalesce(have("confidence"), F.lit(DEFAULT_CONFIDENCE))
    return figures.withColumns({
        "figure_id": F.coalesce(have("figure_id"), F.concat(F.lit("F"), at)), **{k: F.coalesce(have(k), F.lit(v)) for k, v in DEFAULTS.items()},
        **{t: F.coalesce(have(t), F.lit(0.0)) for t in S.TRIGGERS}, "suggested_content": F.coalesce(have("suggested_content"), F.array().cast("array<string>")),
        "final_score": F.coalesce(have("final_score"), confidence), "confidence": confidence,
    })


def with_section_text(figures: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_text: of the first section whose path is the figure's, or whose title occurs in it; else ''.

    The titles and paths of a report meet its figures as one array; the text joins by the number of the section found.
    """
    known = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("section_path").alias("path"), "title"))).alias("_known"))
    path = F.coalesce("section_path", F.lit(""))
    fits = F.get(F.filter("_known", lambda s: (s["path"] == path) | F.contains(path, s["title"])), F.lit(0))["ord"]
    found = figures.join(known, "doc_id", "left").withColumn("_ord", fits).drop("_known")
    texts = sections.select("doc_id", F.col("ord").alias("_ord"), F.col("text").alias("section_text"))
    return found.join(texts, ["doc_id", "_ord"], "left").withColumn("section_text", F.coalesce("section_text", F.lit(""))).drop("_ord")


def determined_type(words: config.TypeWords = config.TypeWords()) -> Column:
    """The type that the dominant trigger and anchor, content and section text call for."""
    text = F.concat_ws(" ", F.coalesce("anchor_text", F.lit("")), F.array_join("suggested_content", " "), "section_text")
    return S.figure_type(S.dominant(), text, words)


def classify(figures: DataFrame, sections: DataFrame, words: config.TypeWords = config.TypeWords()) -> DataFrame:
    """Fills figure_type where it is empty; a type that is there stays."""
    return with_section_text(figures, sections).withColumn("figure_type", _filled_type(words)).drop("section_text")


def _filled_type(words: config.TypeWords) -> Column:
    return F.coalesce(F.when(F.coalesce("figure_type", F.lit("")) != "", F.col("figure_type")), determined_type(words))


def met(figures: DataFrame, reports: DataFrame, sections: DataFrame, words: config.TypeWords = config.TypeWords()) -> DataFrame:
    """`classify`, `in_report` and `place` in one meeting: figures with figure_type, total_chars, here, anchored, char_start and char_end.

    The figures of a document, the places and names of its sections (as of `split_sections`, with paths) and its report meet in one
    row, dealt by document alone. The text of a section is what the report holds between its ends; it goes with no figure beyond the
    row, and into it only where a figure lacks a type.
    """
    own = [c for c in figures.columns if c != "doc_id"]
    gathered = figures.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_figures"))
    known = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("section_path").alias("path"), "title", "char_start", "char_end"))).alias("_sections"))
    rows = gathered.join(known, "doc_id", "left").join(reports.select("doc_id", "md"), "doc_id", "left").withColumn("_flat", G.flat(F.col("md")))
    where = lambda fits: F.filter("_sections", fits)
    place = lambda s: F.when(s.isNotNull(), F.struct(s["char_start"].alias("char_start"), s["char_end"].alias("char_end")))
    last = lambda fits: F.try_element_at(where(fits), F.lit(-1))

    def text(path: Column) -> Column:
        found = F.get(where(lambda s: (s["path"] == path) | F.contains(path, s["title"])), F.lit(0))
        return F.get(F.transform(F.array(found), lambda s: T.strip(F.substring(F.col("md"), (s["char_start"] + 1).cast("int"), (s["char_end"] - s["char_start"]).cast("int")))), F.lit(0))

    def seen(x: Column) -> Column:
        f, here = x["f"], x["here"]
        lacks, path = F.coalesce(f["figure_type"], F.lit("")) == "", f["section_path"]
        found = here.isNotNull() & (F.length(f["anchor_text"]) >= config.MIN_ANCHOR)
        title = F.get(where(lambda s: (s["title"] != "") & F.contains(path, s["title"])), F.lit(0))["title"]
        return F.struct(
            f.alias("f"), here.alias("here"), F.when(found, True).otherwise(G.anchored(f["anchor_text"])).alias("anchored"), F.when(lacks, text(F.coalesce(path, F.lit("")))).alias("text"),
            place(last(lambda s: s["path"] == path)).alias("by_path"), title.alias("title"),
        )

    placed = F.transform("_figures", lambda f: F.struct(f.alias("f"), G.anchor_place(f["anchor_text"]).alias("here")))
    each = F.transform(F.transform(placed, seen), lambda x: F.struct(x.alias("x"), F.coalesce(x["here"], x["by_path"], place(last(lambda s: s["title"] == x["title"]))).alias("at")))
    rows = rows.select("doc_id", F.length("md").alias("total_chars"), F.explode(each).alias("_e"))
    rows = rows.select("doc_id", *[F.col(f"_e.x.f.{c}") for c in own], "total_chars", "_e.x.here", "_e.x.anchored", "_e.at.char_start", "_e.at.char_end", F.coalesce("_e.x.text", F.lit("")).alias("section_text"))
    return rows.withColumn("figure_type", _filled_type(words)).select(*figures.columns, "total_chars", "here", "anchored", "char_start", "char_end")


def content_matches(kinds: dict[str, tuple[str, ...]] = config.TYPE_CONTENT) -> Column:
    """Whether the content or purpose of a figure has a word that its type is expected to have; a diagnosis, nothing is dropped by it."""
    content, purpose = F.array_join("suggested_content", " "), F.coalesce("purpose", F.lit(""))
    some = lambda words: F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(content, k) | F.contains(purpose, k))
    out = F.lit(True)
    for kind, words in kinds.items():
        out = F.when(F.col("figure_type") == kind, some(words)).otherwise(out)
    return out


def baseline(total_chars: Column, max_figures: int = config.MAX_FIGURES) -> Column:
    """Figures that the length of a report suggests."""
    return F.least(F.floor(total_chars / config.CHARS_PER_FIGURE), F.lit(max_figures)).cast("int")


def cap(total_chars: Column) -> Column:
    """Figures that the length of a report allows."""
    return F.greatest(F.lit(1), F.floor(total_chars / config.CHARS_PER_FIGURE)).cast("int")


def optimise(figures: DataFrame) -> DataFrame:
    """The best figures of each document (which has total_chars), neighbours merged, capped by length, in document order, renumbered."""
    merged = G.merge_islands(G.top_k(figures))
    near = F.row_number().over(Window.partitionBy("doc_id").orderBy("island"))
    return G.in_document_order(merged.withColumn("_near", near).filter(F.col("_near") <= cap(F.col("total_chars"))).drop("_near"))


def number(figure_id: Column) -> Column:
    return F.substring(figure_id, 2, 20).cast("long")


def self_check(figures: DataFrame, reports: DataFrame) -> DataFrame:
    """Figures whose anchor exists in the report and whose confidence is high enough, without near repetitions, capped, renumbered."""
    own = [c for c in figures.columns if c not in ("total_chars", "here", "anchored")]
    return checked(G.in_report(figures.select(*own), reports)).select(*own)


def checked(figures: DataFrame) -> DataFrame:
    """`self_check` of figures that have met their reports: those of a document are few and checked in one row."""
    known = figures.withColumn("_at", number(F.col("figure_id")))
    kept = G.drop_similar_few(known.filter(F.col("anchored") & (F.coalesce("confidence", F.lit(0.0)) >= config.MIN_CONFIDENCE)), "_at")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))
    kept = kept.withColumn("_rank", rank).filter(F.col("_rank") <= cap(F.col("total_chars")))
    return G.renumber(kept, "_rank").drop("_at", "_rank")


def final_figures(reports: DataFrame, sections: DataFrame, voted: DataFrame, words: config.TypeWords = config.TypeWords()) -> DataFrame:
    """The figures of the finished plan from those that a vote (and review) kept.

    `reports`: doc_id, md. `sections`: those of the reports, with section_path. `voted`: doc_id, figure_id, anchor_text, section_path,
    figure_type, confidence, final_score, purpose, suggested_content, and t1 to t6 or none of them. The texts of the reports are read
    and shuffled once, to meet the figures.
    """
    return checked(optimise(_placed(reports, sections, voted, words))).drop("here", "anchored")


def _placed(reports: DataFrame, sections: DataFrame, voted: DataFrame, words: config.TypeWords) -> DataFrame:
    lacking = {t: F.lit(None).cast("double") for t in S.TRIGGERS if t not in voted.columns}
    return met(voted.withColumns(lacking), reports, sections, words).withColumn("pos", F.col("vote_rank"))


def optimised_figures(reports: DataFrame, sections: DataFrame, voted: DataFrame, words: config.TypeWords = config.TypeWords()) -> DataFrame:
    """The figures that `final_figures` checks: typed, placed, the best of each document, merged, in document order."""
    return optimise(_placed(reports, sections, voted, words)).drop("here", "anchored")


def run_facts(runs: DataFrame, model: str = "", n: int = 3, critic_used: bool = True, elapsed_ms: int = 0) -> DataFrame:
    """doc_id, report_summary (of the first run), meta (struct) for the result documents, from the planner's `runs`."""
    first = runs.groupBy("doc_id").agg(F.min_by(F.struct(F.try_variant_get("result", "$.report_summary", "string").alias("s"), "errors"), "run_id").alias("r"))
    meta = F.struct(
        F.lit(model).alias("model"), F.lit(n).alias("self_consistency_n"), F.lit(critic_used).alias("critic_used"), F.lit(elapsed_ms).cast("long").alias("elapsed_ms"), F.coalesce("r.errors", F.array().cast("array<string>")).alias("planner_errors"),
    )
    return first.select("doc_id", F.coalesce("r.s", F.lit("")).alias("report_summary"), meta.alias("meta"))


def summary(reports: DataFrame, final: DataFrame, facts: DataFrame | None = None, max_figures: int = config.MAX_FIGURES) -> DataFrame:
    """doc_id, report_summary, total_chars, baseline_count, total_figures, figures (JSON, in order), meta for each report; the result document.

    `facts` (doc_id, report_summary, meta: a struct) as of `run_facts`; without it, or for reports that it lacks, the summary is empty
    and meta null.
    """
    own = [c for c in ("section_path", "anchor_text", "figure_type", "purpose", "confidence", "final_score", "suggested_content", "vote_count", "char_start", "char_end") if c in final.columns]
    each = F.array_sort(F.collect_list(F.struct(number(F.col("figure_id")).alias("_at"), "figure_id", *own)))
    listed = final.groupBy("doc_id").agg(F.transform(each, lambda x: F.struct(x["figure_id"].alias("figure_id"), *[x[c].alias(c) for c in own])).alias("figures"))
    rows = reports.select("doc_id", F.length("md").alias("total_chars")).join(listed, "doc_id", "left")
    rows = rows.join(facts, "doc_id", "left") if facts is not None else rows.withColumns({"report_summary": F.lit(""), "meta": F.lit(None).cast("struct<model:string>")})
    return rows.select(
        "doc_id", F.coalesce("report_summary", F.lit("")).alias("report_summary"), "total_chars", baseline(F.col("total_chars"), max_figures).alias("baseline_count"),
        F.coalesce(F.size("figures"), F.lit(0)).alias("total_figures"), F.coalesce(F.to_json("figures"), F.lit("[]")).alias("figures"), "meta",
    )


def pretty(meta: Column, kind: StructType) -> Column:
    """A flat struct as JSON text, a line for each field and each entry of a list; {} for null."""
    plain = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)

    def value(f: StructField) -> Column:
        c = meta[f.name]
        if not isinstance(f.dataType, ArrayType):
            return F.when(c.isNull(), "null").otherwise(plain(c))
        return F.when(F.size(c) > 0, F.concat(F.lit("[\n    "), F.array_join(F.transform(c, plain), ",\n    "), F.lit("\n  ]"))).otherwise("[]")

    lines = F.array(*[F.concat(F.lit(f'  "{f.name}": '), value(f)) for f in kind.fields])
    return F.when(meta.isNull(), "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def report_lines(summaries: DataFrame, final: DataFrame, file_name: Column | None = None, title: str = config.REPORT_TITLE, labels: config.ReportLabels = config.ReportLabels()) -> DataFrame:
    """doc_id, md: the plan of each document as Markdown: file, sizes and summary, a heading and the facts of each figure in order, meta.

    `file_name` may use the columns of `summaries`; without it the document's key is the name.
    """
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in final.columns else F.lit("")
    share = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0.0)), 2) if c in final.columns else F.lit("0.00")
    fact = lambda label, value: F.concat(F.lit(f"- **{label}**: "), value)
    facts = F.concat_ws(
        "\n", F.concat(F.lit("### "), "figure_id", F.lit(" — "), "figure_type"), fact(labels.section, have("section_path")), fact(labels.place, have("position_hint")), fact(labels.purpose, have("purpose")),
        fact(labels.anchor, have("anchor_text")), fact(labels.confidence, share("confidence")), fact(labels.score, share("final_score")), fact(labels.votes, have("vote_count")),
        fact(labels.content, F.array_join("suggested_content", ", ")), fact(labels.prompt, have("image_prompt_seed")), F.lit(""),
    )
    each = F.array_sort(F.collect_list(F.struct(number(F.col("figure_id")).alias("at"), facts.alias("s"))))
    listed = final.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["s"]), "\n").alias("body"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if file_name is None else file_name
    top = F.concat_ws(
        "\n", F.lit(f"# {title}"), F.lit(""), fact(labels.file, name), fact(labels.total, F.format_number("total_chars", 0)), fact(labels.baseline, F.col("baseline_count").cast("string")), fact(labels.final, F.col("total_figures").cast("string")),
        fact(labels.summary, F.col("report_summary")), F.lit(""), F.lit(f"## {labels.figures}"), F.lit(""),
    )
    end = F.concat_ws("\n", F.lit(f"## {labels.meta}"), F.lit(""), F.lit("```json"), pretty(F.col("meta"), summaries.schema["meta"].dataType), F.lit("```"))
    return summaries.join(listed, "doc_id", "left").select("doc_id", F.concat_ws("\n", top, "body", end).alias("md"))


def candidate_context(candidates: DataFrame, chars: int = 500, digits: int = 3) -> DataFrame:
    """doc_id, context: the candidate sections of each document in order, with their scores (rounded) and the start of their text."""
    score = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{t.upper()}': "), F.round(t, digits).cast("string")) for t in S.TRIGGERS]), F.lit("}"))
    one = F.concat(F.lit("\n--- Section: "), "section_path", F.lit(" (depth="), "depth", F.lit(") ---\nTrigger scores: "), score, F.lit("\nText: "), F.substring("text", 1, chars), F.lit("\n"))
    each = F.array_sort(F.collect_list(F.struct("ord", one.alias("s"))))
    return candidates.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["s"]), "").alias("context"))
