"""Planner and critic calls as tables: prompts, replies, runs, failures.

`replies`: doc_id, run_id, reply, error; a row for each call, recorded or made by `rule_replies`. A call fails if it has an error or
its reply holds no JSON object; failures are rows, never exceptions. Replies are read as variants, so that fields of unexpected
types become defaults instead of failures. All is keyed by doc_id; a reply stays in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T
from quire.operators import figures as G
from quire.operators import plan as P
from quire.operators import sections as S
from quire.sources.tables import written

#: Shares of the best trigger score and the cognitive load in the final score, and the least score that is kept.
SCORE_SHARE, LOAD_SHARE, LEAST_SCORE = 0.4, 0.6, 0.5
NO_OBJECT = "no JSON object in the reply"


def prompts(reports: DataFrame, contexts: DataFrame, template: str, examples: str = "", max_figures: int = config.MAX_FIGURES, chars: int = config.PROMPT_CHARS) -> DataFrame:
    """doc_id, prompt: the template with the start of report and candidate context in it, then the examples.

    `reports`: doc_id, md. `contexts`: doc_id, context. Report and context are cut together.
    """
    rows = reports.select("doc_id", F.coalesce("md", F.lit("")).alias("md")).join(contexts, "doc_id", "left")
    said = F.substring(F.concat("md", F.lit("\n\n[Candidate Sections]\n"), F.coalesce("context", F.lit(""))), 1, chars)
    prompt = F.replace(F.replace(F.lit(template), F.lit("{{REPORT_TEXT}}"), said), F.lit("{{MAX_FIGURES}}"), F.lit(str(max_figures)))
    return rows.select("doc_id", F.concat(prompt, F.lit(f"\n\n{examples}")).alias("prompt") if examples else prompt.alias("prompt"))


def page_texts(pages: DataFrame, chars: int = config.PAGE_CHARS) -> DataFrame:
    """doc_id, text: the start of the text of each page (doc_id, page_number, text) that has one, in order, for a prompt."""
    flat = T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    rows = pages.select("doc_id", "page_number", flat.alias("s")).filter("s <> ''")
    one = F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit(" text]\n"), F.substring("s", 1, chars))
    each = F.array_sort(F.collect_list(F.struct("page_number", one.alias("s"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(each, lambda x: x["s"]), "\n\n").alias("text"))


def draw(seed: int, *key: Column) -> Column:
    """A number from 0 to 1 in steps of 1/4096, drawn from a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 3), 16, 10).cast("long") / 4096


def rule_replies(candidates: DataFrame, totals: DataFrame, n: int = 3, seed: int = 1, max_figures: int = config.MAX_FIGURES, words: config.TypeWords = config.TypeWords()) -> DataFrame:
    """`replies` of a planner that goes by rules: n runs over the candidate sections of each document.

    A run draws the load of each section from (seed, doc_id, run, section), scores it 0.4 * best trigger + 0.6 * load, drops what
    scores under 0.5 and reports the strongest, as many as the length allows. `candidates`: scored sections with section_path.
    `totals`: doc_id, total_chars. A document without candidates has replies without figures. What a figure takes from a section is
    cut from its text before the sections of a document are gathered, once for all runs, which are made in that row.
    """
    best, text = F.greatest(*S.TRIGGERS), F.col("text")
    section = F.struct(
        "ord", best.alias("best"), "section_path", F.substring("text", 1, 24).alias("anchor_text"), S.figure_type(S.dominant(), text, words).alias("figure_type"), "title", F.struct(*[F.col(t).alias(t.upper()) for t in S.TRIGGERS]).alias("trigger_scores"),
    )
    gathered = candidates.groupBy("doc_id").agg(F.collect_list(section).alias("_sections"))
    number = lambda i: (i + 1).cast("int")

    def figure(x: Column, i: Column) -> Column:
        c = x["section"]
        return F.struct(
            number(i).alias("rank"), F.concat(F.lit("F"), number(i)).alias("figure_id"), c["section_path"].alias("section_path"), c["anchor_text"].alias("anchor_text"), c["figure_type"].alias("figure_type"), c["title"].alias("purpose"),
            (x["load"] / 2 + 0.5).alias("confidence"), x["score"].alias("final_score"), x["load"].alias("cognitive_load"), c["trigger_scores"].alias("trigger_scores"), F.array(c["title"], c["figure_type"]).alias("suggested_content"),
        )

    def figures(run: Column) -> Column:
        drawn = F.transform("_sections", lambda c: F.struct(draw(seed, F.col("doc_id"), run, c["ord"]).alias("load"), c.alias("section")))
        rated = F.transform(drawn, lambda x: F.struct((x["section"]["best"] * SCORE_SHARE + x["load"] * LOAD_SHARE).alias("score"), x["load"].alias("load"), x["section"].alias("section")))
        ranked = F.array_sort(F.transform(F.filter(rated, lambda x: x["score"] >= LEAST_SCORE), lambda x: F.struct((-x["score"]).alias("low"), x["section"]["ord"].alias("ord"), x.alias("x"))))
        return F.transform(F.slice(ranked, F.lit(1), G.allowed(F.col("total_chars"), max_figures)), lambda r, i: figure(r["x"], i))

    every = totals.join(gathered, "doc_id", "left").select("doc_id", "total_chars", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), figures)).alias("run_id", "figures"))
    none = F.array().cast(every.schema["figures"].dataType)
    reply = F.to_json(F.struct(F.lit("").alias("report_summary"), "total_chars", P.baseline(F.col("total_chars"), max_figures).alias("baseline_count"), F.coalesce("figures", none).alias("figures")))
    return every.select("doc_id", "run_id", F.concat(F.lit("```json\n"), reply, F.lit("\n```")).alias("reply"), F.lit(None).cast("string").alias("error"))


def _result(reply: Column, error: Column) -> Column:
    """What a call returned, as a variant; null for a failed call."""
    return F.when(error.isNull(), T.parsed_object(reply))


def _reason(error: Column, result: Column) -> Column:
    """Why a call failed, else null."""
    return F.when(error.isNotNull(), error).when(result.isNull(), NO_OBJECT)


def parsed(replies: DataFrame) -> DataFrame:
    """Adds result (variant, null for a failed call) and reason (of the failure, else null)."""
    return replies.withColumn("result", _result(F.col("reply"), F.col("error"))).withColumn("reason", _reason(F.col("error"), F.col("result")))


def failures(replies: DataFrame) -> DataFrame:
    """doc_id, run_id, stage, reason, transient, quota of the calls that failed."""
    bad = parsed(replies).select("doc_id", "run_id", F.explode(F.array_compact(F.array("reason"))).alias("reason"))  # a filter would parse again
    return bad.select("doc_id", "run_id", F.lit("plan").alias("stage"), "reason", T.is_transient(F.col("reason")).alias("transient"), T.is_quota(F.col("reason")).alias("quota"))


def runs(reports: DataFrame, replies: DataFrame, max_figures: int = config.MAX_FIGURES) -> DataFrame:
    """doc_id, run_id, result, errors: the successful runs of each report, the first one with the reasons of those that failed.

    A report without a successful run has one of its own, numbered 0: without figures. `reports`: doc_id, md. The calls of a report
    meet its length in one row, where they are parsed, so that no reply is written or shuffled twice.
    """
    calls = replies.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "reply", "error"))).alias("_calls"))
    totals = reports.groupBy("doc_id").agg(F.collect_list(F.length(F.coalesce("md", F.lit("")))).alias("_totals"))
    read = F.transform(F.transform("_calls", lambda c: F.struct(c["run_id"].alias("run_id"), c["error"].alias("error"), _result(c["reply"], c["error"]).alias("result"))), lambda c: F.struct(c["run_id"].alias("run_id"), c["result"].alias("result"), _reason(c["error"], c["result"]).alias("reason")))
    rows = totals.join(calls.hint("merge"), "doc_id", "left").select("doc_id", "_totals", read.alias("_read"))
    bad, good = F.filter("_read", lambda c: c["reason"].isNotNull()), F.filter("_read", lambda c: c["reason"].isNull())
    errors = F.transform(bad, lambda c: F.concat(F.lit("run "), c["run_id"].cast("string"), F.lit(": "), c["reason"]))
    empty = lambda total: F.to_json(F.struct(F.lit("").alias("report_summary"), total.alias("total_chars"), P.baseline(total, max_figures).alias("baseline_count"), F.lit(0).alias("total_figures"), F.array().cast("array<string>").alias("figures")))
    run = lambda i, result: F.struct(i.cast(replies.schema["run_id"].dataType).alias("run_id"), result.alias("result"))
    rows = rows.select("doc_id", F.when(F.size(errors) > 0, errors).alias("errors"), F.transform(good, lambda c: run(c["run_id"], c["result"])).alias("_good"), F.transform("_totals", lambda t: run(F.lit(0), F.try_parse_json(empty(t)))).alias("_alone"))
    some = F.coalesce(F.size("_good"), F.lit(0)) > 0
    rows = rows.select("doc_id", "errors", some.alias("_some"), F.posexplode(F.when(some, F.col("_good")).otherwise(F.col("_alone"))).alias("_at", "_run"))
    return rows.select("doc_id", "_run.run_id", "_run.result", F.when((F.col("_at") == 0) | ~F.col("_some"), F.col("errors")).alias("errors"))


def _objects(v: Column, name: str) -> Column:
    """The objects in a named list; other entries are passed over, and where there is no list there are none."""
    return F.filter(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def _string(v: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in names])


def _number(v: Column, name: str, kind: str = "double") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def run_figures(found: DataFrame, outer: bool = False) -> DataFrame:
    """The figures of `runs` for the vote: doc_id, run_id, pos, and the fields of a figure; what lacks or has another type is null or a default.

    A result whose `figures` is no list has none. With `outer` a run without figures has a row, without pos.
    """
    each = F.posexplode_outer if outer else F.posexplode
    rows = found.select("doc_id", "run_id", each(_objects(F.col("result"), "figures")).alias("pos", "f"))
    f = F.col("f")
    items = F.transform(F.try_variant_get(f, "$.suggested_content", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    return rows.select(
        "doc_id", "run_id", "pos", F.coalesce(_string(f, "section_path"), F.lit("")).alias("section_path"), F.coalesce(_string(f, "figure_type"), F.lit("")).alias("figure_type"), F.coalesce(_string(f, "anchor_text"), F.lit("")).alias("anchor_text"),
        F.coalesce(_string(f, "purpose"), F.lit("")).alias("purpose"), _string(f, "position_hint").alias("position_hint"), _number(f, "confidence").alias("confidence"), _number(f, "final_score").alias("final_score"),
        F.array_compact(F.coalesce(items, F.array().cast("array<string>"))).alias("suggested_content"), *[F.coalesce(_number(f, f"trigger_scores.{t.upper()}"), F.lit(0.0)).alias(t) for t in S.TRIGGERS],
    )


def voted(reports: DataFrame, replies: DataFrame, max_figures: int = config.MAX_FIGURES) -> DataFrame:
    """The figures that a majority of the successful runs of each report agrees on. The vote reads them three times; they are written once, as columns."""
    found = written(run_figures(runs(reports, replies, max_figures), outer=True))
    return G.vote(found.filter("pos IS NOT NULL"), found.select("doc_id", "run_id"))


def reviewed(figures: DataFrame, replies: DataFrame) -> DataFrame:
    """`figures` (doc_id, figure_id, figure_type, and more) after the critic: rejected ones go, others may change type, missing ones are added.

    `replies` has at most one row for each document. Where the call failed, or there was none, all figures stay as they are.
    Documents without figures are not reviewed, so that nothing is added to them. The figures of a document meet its reply as one
    array and are reviewed in that row, as `review` and `add_missing` do it for tables. The meeting is a merge: the size of what a
    reply holds is not known before it is parsed, and no table of replies goes through the driver.
    """
    own = [c for c in figures.columns if c != "doc_id"]
    every = figures.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_figures"))
    met = every.join(replies.select("doc_id", "reply", "error").hint("merge"), "doc_id", "left")

    def read(v: Column) -> Column:
        reviews = F.transform(_objects(v, "reviewed"), lambda r: F.struct(_string(r, "figure_id").alias("figure_id"), F.try_variant_get(r, "$.approved", "boolean").alias("approved"), _string(r, "suggest_alternative_type").alias("alternative")))
        missing = F.transform(_objects(v, "add_missing"), lambda m: F.struct(*[_string(m, k).alias(k) for k in ("section_path", "anchor_text", "figure_type", "purpose")], _number(m, "confidence").alias("confidence")))
        return F.struct(reviews.alias("reviews"), missing.alias("missing"))

    rows = met.select("doc_id", "_figures", F.get(F.transform(F.array(_result(F.col("reply"), F.col("error"))), read), F.lit(0)).alias("_r"))
    last = lambda f: F.try_element_at(F.filter("_r.reviews", lambda r: r["figure_id"] == f["figure_id"]), F.lit(-1))
    judged = F.filter(F.transform("_figures", lambda f: F.struct(f.alias("f"), last(f).alias("r"))), lambda x: F.coalesce(x["r"]["approved"], F.lit(True)))
    more = [c for c in G.added(lambda c: None, F.lit(0)) if c not in own]

    def kept(x: Column) -> Column:
        of = lambda c: G.reviewed_type(x["f"][c], x["r"]["alternative"]) if c == "figure_type" else x["f"][c] if c in own else F.lit(None)
        return F.struct(*[of(c).alias(c) for c in (*own, *more)])

    def made(m: Column, i: Column) -> Column:
        fields = G.added(lambda c: m[c], F.size("_figures") + i + 1)
        return F.struct(*[fields.get(c, F.lit(None)).alias(c) for c in (*own, *more)])

    each = F.concat(F.transform(judged, kept), F.coalesce(F.transform("_r.missing", made), F.array()))
    rows = rows.select("doc_id", F.explode(each).alias("x"))
    return rows.select(*[F.col(c if c == "doc_id" else f"x.{c}") for c in (*figures.columns, *more)])
