"""Edits of documents as relations: figures put in place, texts replaced across runs, cells set and rows added, lists of binaries.

What the edits would do one after the other is stated as keys: the place of a figure, the last valid update of an address, the
number of an added row. All is by document; an edit that can't be made is a row with a reason, and the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.numbering import numbered

#: The least id in use, the distance of new ids to those in use, ids for each picture.
ID_FLOOR, ID_GAP, IDS_EACH = 10_000_000, 1000, 3
# Extensions of image types, and types of extensions.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp"}
TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp"}


def _looked_up(c: Column, known: dict[str, str], default: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.element_at(names, c), F.lit(default))


def extension_of(mime: Column) -> Column:
    return _looked_up(F.lower(F.trim(mime)), EXTENSIONS, "png")


def type_of(extension: Column) -> Column:
    return _looked_up(F.lower(extension), TYPES, "image/png")


def image_bytes(content: Column, encoded: Column) -> Column:
    """The bytes of an image: its content, else what its base64 text (plain, or after the comma of a data URI) stands for; null for none."""
    plain = F.when(F.contains(encoded, F.lit(",")), F.regexp_extract(encoded, r"(?s)^[^,]*,(.*)$", 1)).otherwise(encoded)
    some = F.coalesce(F.when(F.octet_length(content) > 0, content), F.try_to_binary(plain, F.lit("base64")))
    return F.when(F.octet_length(some) > 0, some)


def anchored(children: DataFrame, figures: DataFrame) -> DataFrame:
    """Adds at to `figures` (doc_id, pos, anchor_text): ord of the first paragraph of the document that holds the anchor, or null.

    `children`: doc_id, ord, is_paragraph, text. The anchors of a document, as one array, meet each of its paragraphs once; only
    paragraphs that hold an anchor go on.
    """
    needle = F.trim(F.coalesce("anchor_text", F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    wanted = figures.select("doc_id", "pos", needle.alias("a")).filter("a <> ''").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "a")).alias("_wanted"))
    met = children.filter("is_paragraph").join(wanted, "doc_id").select("doc_id", "ord", F.explode(F.filter("_wanted", lambda w: F.contains("text", w["a"]))).alias("w"))
    found = met.groupBy("doc_id", F.col("w.pos").alias("pos")).agg(F.min("ord").alias("at"))
    return figures.join(found, ["doc_id", "pos"], "left")


def inserted(children: DataFrame, figures: DataFrame, ids: DataFrame, block: int = 1024) -> DataFrame:
    """doc_id, place, ord (null for a picture), pos (null for a child), para_id, pic_id, inst_id: a document's children with pictures.

    As if the figures were put in one after the other by pos: before or after the first paragraph that holds the anchor, else at
    the end. Of several after one paragraph the last stands first, of several before one the last stands nearest; so a figure's
    place is (child, side, pos or -pos). Figures without an image (`has_image`) are left out and take no ids; `ids`: doc_id, high.
    """
    put = anchored(children, figures.filter("has_image"))
    side = F.when(F.col("at").isNull(), 0).when(F.col("position_hint") == "before", -1).otherwise(1)
    put = numbered(put, ["doc_id"], "pos", "_n", block=block).join(ids, "doc_id", "left")
    first = F.coalesce("high", F.lit(ID_FLOOR)) + ID_GAP + (F.col("_n") - 1) * IDS_EACH
    put = put.withColumns({"_side": side, "_order": F.when(side == 1, -F.col("pos")).otherwise(F.col("pos"))})
    pictures = put.select("doc_id", F.lit(None).cast(children.schema["ord"].dataType).alias("ord"), "pos", F.col("at").alias("_at"), "_side", F.col("_order").cast("long").alias("_order"), *[(first + k).cast("long").alias(c) for k, c in enumerate(("para_id", "pic_id", "inst_id"))])
    own = children.select("doc_id", "ord", F.lit(None).cast(figures.schema["pos"].dataType).alias("pos"), F.col("ord").alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_order"), *[F.lit(None).cast("long").alias(c) for c in ("para_id", "pic_id", "inst_id")])
    w = Window.partitionBy("doc_id").orderBy(F.col("_at").asc_nulls_last(), "_side", "_order")
    return own.unionByName(pictures).withColumn("place", F.row_number().over(w) - 1).select("doc_id", "place", "ord", "pos", "para_id", "pic_id", "inst_id")


def _counted(text: Column, old: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).cast("long")


def _step(rows: DataFrame, old: str, new: str, on: Column | None = None) -> DataFrame:
    """`rows` with old replaced in text (where `on` holds), and n raised by how often."""
    text, n = F.replace("text", F.lit(old), F.lit(new)), F.col("n") + _counted(F.col("text"), F.lit(old))
    return rows.withColumns({"text": text, "n": n} if on is None else {"text": F.when(on, text).otherwise(F.col("text")), "n": F.when(on, n).otherwise(F.col("n"))})


def replaced(runs: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """doc_id, para, ord, text, n of `runs` (doc_id, para, ord, text) with texts replaced; n is the count of the paragraph.

    Replacements go in the order of `mapping`, each on the result of those before: first inside each run, then, if the joined text
    of a paragraph still holds one, over that text, which goes to the first run while the others become empty. Runs are replaced in
    their rows; those of a paragraph meet as one array, and what a run gets is put into the array before it is parted again, so that
    no run carries the text of its paragraph. Null texts are empty; an empty key replaces nothing.
    """
    pairs = [(a, b) for a, b in mapping.items() if a]
    own, n = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    rows = runs.select("doc_id", "para", "ord", own.alias("text"), n.alias("n"))
    for a, b in pairs:
        rows = _step(rows, a, b)
    rows = rows.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("runs"), F.sum("n").alias("n"))
    rows = rows.withColumn("joined", F.array_join("runs.text", "")).withColumn("_need", F.array(*[F.contains("joined", F.lit(a)) for a, _ in pairs]).cast("array<boolean>"))
    # the texts that are needed were named before any of them is replaced
    rows = rows.withColumnRenamed("joined", "text")
    for k, (a, b) in enumerate(pairs):
        rows = _step(rows, a, b, F.col("_need")[k])
    whole = lambda r, i: F.struct(r["ord"].alias("ord"), F.when(i == 0, F.col("text")).otherwise("").alias("text"))
    out = F.when(F.exists("_need", lambda x: x), F.transform("runs", whole)).otherwise(F.col("runs"))
    return rows.select("doc_id", "para", "n", F.explode(out).alias("r")).select("doc_id", "para", "r.ord", "r.text", "n")


_ADDRESS = ["doc_id", "table_id", "r", "c"]


def updated_cells(cells: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells after all updates, errors): doc_id, table_id, ord, r, c, text and doc_id, pos, op, reason.

    `cells`: doc_id, table_id, ord, r, c, text, state (`text`; `empty`: its first paragraph holds no text element, so that nothing
    can be written into it; `none`: no paragraph). `updates`: doc_id, pos, op, table_id, r, c, text, values, as if made by pos:
    `set` gives the cell at (r, c) a text, `append` adds a row like the table's last one, one row further, with `values` as
    texts, '' for missing ones. A set may address a row that was appended before it. Of several for one address the last counts;
    of cells with equal addresses the first is meant. ord of added cells goes on after the table's largest.
    """
    key = ["doc_id", "table_id"]
    # all goes by table; what is by address is a window over rows that are dealt by table already
    marked = cells.select(*key, "ord", "r", "c", "text", "state").withColumn("_top", F.max("r").over(Window.partitionBy(*key)))
    row = F.array_sort(F.collect_list(F.when(F.col("r") == F.col("_top"), F.struct("ord", "c", "state", F.col("text").alias("old")))))
    tables = marked.groupBy(*key).agg(F.max("_top").alias("_last"), F.max("ord").alias("_ord"), F.count("*").alias("_there"), row.alias("_row"))
    known = updates.join(tables, key, "left")
    appends = known.filter("op = 'append' AND _there IS NOT NULL AND _last IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
    appends = appends.select(*key, "pos", "values", "_n", "_ord", "_last", F.size("_row").alias("_width"), F.posexplode("_row").alias("_i", "_cell"))
    added = appends.select(
        *key, (F.col("_ord") + (F.col("_n") - 1) * F.col("_width") + F.col("_i") + 1).cast(cells.schema["ord"].dataType).alias("ord"), (F.col("_last") + F.col("_n")).cast(cells.schema["r"].dataType).alias("r"), F.col("_cell.c").alias("c"),
        F.when(F.col("_cell.state") == "text", F.coalesce(F.get("values", F.col("_i")), F.lit(""))).otherwise(F.col("_cell.old")).alias("text"), F.col("_cell.state").alias("state"), F.col("pos").alias("_made"),
    )
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    pos = updates.schema["pos"].dataType
    sets = known.filter("op = 'set'").select(*key, none("ord", cells.schema["ord"].dataType), "r", "c", "text", none("state", "string"), none("_made", pos), F.col("pos").alias("_pos"), F.lit(True).alias("_set"), F.col("_there").isNotNull().alias("_there"))
    plain = [none("_pos", pos), F.lit(False).alias("_set"), F.lit(True).alias("_there")]
    every = cells.select(*key, "ord", "r", "c", "text", "state", none("_made", pos), *plain).unionByName(added.select("*", *plain)).unionByName(sets)
    w = Window.partitionBy(*_ADDRESS).orderBy("_set", "ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = every.withColumns({"_first": (F.row_number().over(w) == 1) & ~F.col("_set"), "_cell": F.first(F.when(~F.col("_set"), F.struct("state", "_made"))).over(whole)})
    there = F.col("_cell").isNotNull() & F.col("r").isNotNull() & F.col("c").isNotNull() & F.col("_cell.state").isNotNull() & F.coalesce(F.col("_cell._made").isNull() | (F.col("_cell._made") < F.col("_pos")), F.lit(False))
    reason = F.when(~F.col("_there"), "no such table").when(~there, "no such cell").when(F.col("_cell.state") == "none", "no paragraph")
    every = every.withColumn("reason", F.when(F.col("_set"), reason))
    last = F.max(F.when(F.col("_set") & F.col("reason").isNull() & (F.col("_cell.state") == "text"), F.struct("_pos", "text"))).over(whole)
    every = every.withColumn("_last", last)
    out = every.filter("NOT _set").select(*key, "ord", "r", "c", F.when(F.col("_first") & F.col("_last").isNotNull(), F.col("_last.text")).otherwise(F.col("text")).alias("text"))
    bad = every.filter("_set AND reason IS NOT NULL").select("doc_id", F.col("_pos").alias("pos"), F.lit("set").alias("op"), "reason")
    bad = bad.unionByName(known.filter("op = 'append' AND (_there IS NULL OR _last IS NULL)").select("doc_id", "pos", "op", F.lit("no such table").alias("reason")))
    return out, bad.unionByName(known.filter("op NOT IN ('set', 'append') OR op IS NULL").select("doc_id", "pos", "op", F.lit("no such update").alias("reason")))


def binary_names(files: DataFrame, folder: str = "bindata/") -> DataFrame:
    """doc_id, alias, name, mime: the names under which the images of a package are referred to.

    `files`: doc_id, ord, name. An image goes by its stem, and one called BIN0012 by 12 too. Of images with equal aliases the last
    one counts, of one image's the number. Other files, and those of no known type, have none.
    """
    path = F.replace("name", F.lit("\\"), F.lit("/"))
    base = F.substring_index(path, "/", -1)
    stem, ext = F.regexp_extract(base, r"^(.*)\.[^.]*$", 1), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() if kv[0] != "webp" for x in kv]), ext)
    number = F.when(F.upper(stem).startswith("BIN"), F.regexp_replace(F.substring(stem, 4, 1_000_000), "^0+", ""))
    images = files.filter(F.lower(path).startswith(folder) & F.contains(base, F.lit("."))).select("doc_id", "ord", "name", mime.alias("mime"), F.array_compact(F.array(stem, F.when(number != "", number))).alias("aliases")).filter("mime IS NOT NULL")
    each = images.select("doc_id", "ord", "name", "mime", F.posexplode("aliases").alias("part", "alias"))
    return each.groupBy("doc_id", "alias").agg(F.max_by(F.struct("name", "mime"), F.struct("ord", "part")).alias("b")).select("doc_id", "alias", "b.name", "b.mime")


def with_binaries(images: DataFrame, files: DataFrame) -> DataFrame:
    """`images` (doc_id, bin_ref, and more) with name and mime of the binary, both null where it is missing, and missing."""
    names = binary_names(files).withColumnRenamed("alias", "bin_ref")
    return images.join(names, ["doc_id", "bin_ref"], "left").withColumn("missing", F.col("name").isNull()).select(*images.columns, "name", "mime", "missing")


def extended_manifest(manifest: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, ord, id, href, type: `manifest` and those of `items` (doc_id, pos, href, type) whose href it lacks, in order, as image1 and on.

    New ids go on from the largest number of an id imageN of the document. Items of documents without a manifest are left out.
    """
    number = F.regexp_extract("id", r"^image([0-9]{1,9})$", 1)
    marks = manifest.groupBy("doc_id").agg(F.coalesce(F.max(F.when(number != "", number.cast("long"))), F.lit(0).cast("long")).alias("_high"), F.max("ord").alias("_ord"))
    new = items.join(manifest.select("doc_id", "href").distinct(), ["doc_id", "href"], "left_anti").join(marks, "doc_id")
    new = numbered(new, ["doc_id"], "pos", "_n", "href")
    new = new.select("doc_id", (F.col("_ord") + F.col("_n")).cast(manifest.schema["ord"].dataType).alias("ord"), F.concat(F.lit("image"), F.col("_high") + F.col("_n")).alias("id"), "href", "type")
    return manifest.select("doc_id", "ord", "id", "href", "type").unionByName(new)
