"""Places for images in a document, and what is put there.

`blocks`: doc_id, ord, section_index, kind, text (of a table: its cells joined), width, height, and empty_large for tables with
an empty cell that is large (the function of that name finds it in the cells of `markup.paragraph_blocks`). A slot is a row: doc_id, id, block_ord, section_index, type, ui_type, style, desc, title, context,
prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T
from quire.operators import blocks as B


def _from(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def slot_type(text: Column, words: config.SlotWords = config.SlotWords()) -> Column:
    """The first kind of place whose words occur in the lower-cased text."""
    low, out = F.lower(text), F
    for kind, pattern in words.kinds:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise(words.other)


def description(kind: Column, title: Column, labels: dict[str, str] = config.SLOT_LABELS) -> Column:
    """The label of a kind, with the title unless that holds the label."""
    label = _from(labels, kind, labels["diagram"])
    return F.when((title != "") & ~F.contains(title, label), F.concat(label, F.lit(" - "), title)).otherwise(label)


def prompt(purpose: Column, path: Column, content: Column, kind: Column, words: config.SlotWords = config.SlotWords(), guides: dict[str, str] | None = None) -> Column:
    """The lines of a request for an image: purpose (the path where that is in English only), short nominal items, kind, guide.

    `guides` may name a guide for each kind; PROMPT_GUIDE is the one for the rest.
    """
    english = lambda s: s.rlike(words.english) & ~s.rlike(words.native)
    items = F.filter(content, lambda s: ~english(s) & (F.length(s) <= config.ITEM_CHARS) & ~s.rlike(words.sentence))
    line = lambda k, value: F.concat(F.lit(f"[{config.PROMPT_LABELS[k]}] "), value)
    own = F.when((F.coalesce(purpose, F.lit("")) != "") & ~english(purpose), purpose)
    other = F.when(F.coalesce(path, F.lit("")) != "", path).otherwise(config.PROMPT_PURPOSE)
    guide = _from(guides, kind, config.PROMPT_GUIDE) if guides else F.lit(config.PROMPT_GUIDE)
    return F.concat_ws("\n", line(0, F.coalesce(own, other)), F.when(F.size(items) > 0, line(1, F.array_join(items, " / "))), line(2, kind), line(3, guide))


def empty_large(cells: Column) -> Column:
    """Whether a table (rows of structs of text, width, height) has a cell without text that is large."""
    big = lambda c: (T.strip(F.coalesce(c["text"], F.lit(""))) == "") & ((c["width"] > config.WIDE_CELL) | (c["height"] > config.HIGH_CELL))
    return F.coalesce(F.exists(F.flatten(cells), big), F.lit(False))


def find_slots(blocks: DataFrame, words: config.SlotWords = config.SlotWords(), limit: int = config.MAX_SLOTS) -> DataFrame:
    """The first places (at most `limit`) of each document: marked texts, large tables, tables with large empty cells.

    A document without any has one place at its start, with the context of its first blocks.
    """
    text = F.coalesce("text", F.lit(""))
    table = F.col("kind") == "table"
    fits = F.col("text").rlike(words.marker) | (table & ((F.col("width") > config.WIDE_TABLE) | (F.col("height") > config.HIGH_TABLE) | F.col("empty_large")))
    w = Window.partitionBy("doc_id").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fits = F.coalesce(fits, F.lit(False))
    titled = B.with_nearest_title(blocks.withColumn("text", text), words.nearest, words.nearest_default)
    rows = B.with_context(titled, of=fits).withColumns({"_fits": fits, "id": (F.sum(fits.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"), "_some": F.max(fits).over(whole), "_at": F.least(F.lit(8), F.max("ord").over(whole))})
    # documents without a place: the context around the ninth block (or the last), ten to either side, in the row of the first
    near = ~F.col("_some") & F.col("ord").between(F.col("_at") - 10, F.col("_at") + 10)
    rows = rows.withColumn("_around", F.collect_list(F.when(near, F.col("text"))).over(whole)).filter(F.col("_fits") & (F.col("id") < limit) | ~F.col("_some") & (F.col("ord") == 0))
    opening = ~F.col("_some")
    title = F.when(~opening & F.col("text").rlike(words.title), F.col("text")).otherwise(F.col("nearest_title"))
    rows = rows.withColumns({"title": title, "context": F.when(opening, T.normalise(F.array_join("_around", "\n"))).otherwise(F.col("context"))})
    of = F.when(opening, F.col("context")).otherwise(F.concat_ws("\n", "title", "context"))
    first = lambda c: F.when(opening, F.lit(0)).otherwise(F.col(c)).cast(blocks.schema[c].dataType)
    slots = rows.select("doc_id", F.when(opening, 0).otherwise(F.col("id")).alias("id"), first("ord").alias("block_ord"), first("section_index").alias("section_index"), slot_type(of, words).alias("type"), "title", "context")
    return slots.withColumns({
        "ui_type": _from(config.SLOT_KINDS, F.col("type"), config.DEFAULT_KIND), "style": F.when(F.col("type") == "venue", "field").otherwise("official"),
        "desc": F.substring(description(F.col("type"), F.col("title")), 1, config.SLOT_CHARS),
    }).withColumn("prompt", prompt(F.col("desc"), F.col("title"), F.array().cast("array<string>"), F.col("ui_type"), words))


def figure_slots(figures: DataFrame, blocks: DataFrame, words: config.SlotWords = config.SlotWords()) -> DataFrame:
    """A slot for each planned figure (doc_id, pos, anchor_text, figure_type, section_path, purpose, suggested_content), at the block of its anchor, else at the first."""
    f = figures.withColumns({c: F.coalesce(c, F.lit("")) for c in ("anchor_text", "section_path", "purpose")}).withColumn("anchor_text", T.strip(F.col("anchor_text")))
    f = f.withColumn("figure_type", F.when(F.coalesce("figure_type", F.lit("")) != "", F.col("figure_type")).otherwise("concept_diagram"))
    # the figures of a document meet its blocks once, each as one array; what goes on is a figure with the texts around its block
    every = f.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in f.columns if c not in ("doc_id", "pos")]))).alias("_figures"))
    rows = every.join(B.gathered(blocks, "section_index"), "doc_id", "left").withColumn("_texts", F.transform("_blocks", lambda x: x["text"]))
    placed = F.transform("_figures", lambda x: x.withField("block_ord", F.greatest(B.ord_of_anchor(F.col("_blocks"), x["anchor_text"]), F.lit(0))))
    known = lambda o: F.filter(F.transform("_blocks", lambda b, k: F.struct(b["ord"].alias("ord"), b["section_index"].alias("section_index"), k.alias("k"))), lambda b: b["ord"] == o)
    around = lambda k: T.normalise(F.array_join(F.slice("_texts", F.greatest(k - B.SPAN, F.lit(0)) + 1, k + B.SPAN + 1 - F.greatest(k - B.SPAN, F.lit(0))), "\n"))
    none = F.struct(F.lit(None).cast(blocks.schema["section_index"].dataType).alias("section_index"), F.lit(None).cast("string").alias("context"))
    seen = lambda o: F.transform(known(o), lambda b: F.struct(b["section_index"].alias("section_index"), around(b["k"]).alias("context")))
    met = F.transform(placed, lambda x: F.transform(F.when(F.size(known(x["block_ord"])) > 0, seen(x["block_ord"])).otherwise(F.array(none)), lambda b: F.struct(x.alias("f"), b.alias("b"))))
    rows = rows.select("doc_id", F.posexplode(F.flatten(met)).alias("id", "_m")).select("doc_id", "id", "_m.f.*", "_m.b.*")
    label = _from(config.FIGURE_KINDS, F.col("figure_type"), config.DEFAULT_KIND)
    one = lambda *values: F.coalesce(*[F.when(v != "", v) for v in values])
    return rows.select(
        "doc_id", "id", "block_ord", F.coalesce("section_index", F.lit(0)).alias("section_index"), F.lit("diagram").alias("type"), label.alias("ui_type"),
        F.lit("official").alias("style"), one(F.substring("purpose", 1, config.SLOT_CHARS), F.col("section_path"), F.concat(label, F.lit(" 후보"))).alias("desc"), one(F.col("section_path"), F.col("purpose"), F.lit(config.PLACE_TITLE)).alias("title"),
        F.coalesce("context", F.lit("")).alias("context"), prompt(F.col("purpose"), F.col("section_path"), F.col("suggested_content"), label, words).alias("prompt"), "figure_type", "anchor_text",
    )


def over_blocks(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """Blocks with slot_id: the last slot that stands at a block, or null."""
    last = slots.groupBy("doc_id", F.col("block_ord").alias("ord")).agg(F.max("id").alias("slot_id"))
    return blocks.join(last, ["doc_id", "ord"], "left")


def with_images(slots: DataFrame, images: DataFrame) -> DataFrame:
    """Adds image: that made for the slot's prompt; equal prompts share one. `images`: prompt, image."""
    made = images.groupBy("prompt").agg(F.min("image").alias("image"))
    return slots.join(made, "prompt", "left")


def drop_repeated_images(slots: DataFrame) -> DataFrame:
    """Of the slots of a document with equal images the first; slots without an image stay."""
    rank = F.row_number().over(Window.partitionBy("doc_id", F.sha2("image", 256)).orderBy("id"))
    return slots.withColumn("_k", rank).filter(F.coalesce("image", F.lit("")).eqNullSafe("") | (F.col("_k") == 1)).drop("_k")


def in_visual_order(slots: DataFrame) -> DataFrame:
    """doc_id, block_ord, image: the images of a document in their visual order (id), put at its slots in order of blocks."""
    some = slots.filter(F.coalesce("image", F.lit("")) != "")
    lists = some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", "id"))).alias("place"), F.array_sort(F.collect_list(F.struct("id", "image"))).alias("shown"))
    return lists.select("doc_id", F.explode(F.arrays_zip("place", "shown")).alias("v")).select("doc_id", "v.place.block_ord", "v.shown.image")


def plan_documents(slots: DataFrame) -> DataFrame:
    """doc_id, plan: the slots of a document in order as JSON, numbered from 1, with the name of the image file of each."""
    href = F.concat(F.lit("BinData/visual_flow_"), F.lpad((F.col("id") + 1).cast("string"), 2, "0"), F.lit(".png"))
    one = F.struct((F.col("id") + 1).alias("id"), (F.col("section_index") + 1).alias("section"), F.col("block_ord").alias("block_index"), href.alias("image_href"), F.col("desc").alias("description"), "type", "style", "title", "prompt", "context")
    return slots.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("plan"))
