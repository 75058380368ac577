"""Columns over JSON payloads whose shape is not sure: read as variants, by ladders of names; what doesn't fit becomes a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Names under which pages, their images and whole documents arrive, in order of precedence.
PAGE_NAMES = ("pages", "page_images", "images")
IMAGE_NAMES = ("image_base64", "base64", "image", "image_url")
DOCUMENT_NAMES = ("pdf_base64", "pdf", "pdf_data")


def parse(payload: Column) -> Column:
    """The payload as a variant, or null where it is no JSON object."""
    v = T.strict_json(payload)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def first_string(v: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields that is a string and not empty, else ''. Only strings count: numbers and objects are passed over."""
    each = [F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in names]
    return F.coalesce(*[F.when(x != "", x) for x in each], F.lit(""))


def image_data(image: Column) -> Column:
    """The data of an image in base64: after the comma of a data URI; null for an address, which is left to a fetcher; else as it is."""
    return F.when(image.startswith("data:image") & F.contains(image, F.lit(",")), F.regexp_extract(image, r"(?s)^[^,]*,(.*)$", 1)).when(image.rlike("^https?://"), None).otherwise(image)


def pages(v: Column, max_pages: int) -> Column:
    """The pages of a parsed payload: array of page_number, image, url, width, height, text.

    The first of PAGE_NAMES that is a list with entries counts; its first max_pages entries are looked at. A string is an image, an
    object may name one; other entries, and those without an image, are left out but keep their number. Sizes that are no numbers
    are 0. url is set, and image null, where an entry gives an address.
    """
    lists = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in PAGE_NAMES]
    entries = F.slice(F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>")), 1, max_pages)

    def page(x: Column, i: Column) -> Column:
        kind = F.schema_of_variant(x)
        plain, is_object = kind == "STRING", F.startswith(kind, F.lit("OBJECT"))
        image = F.when(plain, F.try_variant_get(x, "$", "string")).when(is_object, first_string(x, IMAGE_NAMES)).otherwise("")
        size = lambda k: F.when(is_object, F.coalesce(F.try_variant_get(x, f"$.{k}", "double").cast("int"), F.lit(0))).otherwise(0)
        return F.struct((i + 1).alias("page_number"), image_data(image).alias("image"), F.when(image.rlike("^https?://"), image).alias("url"), size("width").alias("width"), size("height").alias("height"), F.when(is_object, first_string(x, ("text",))).otherwise("").alias("text"))

    return F.filter(F.transform(entries, page), lambda p: p["url"].isNotNull() | (p["image"] != ""))


def document(v: Column) -> Column:
    """The whole document that a payload without pages may hold, in base64, or null."""
    raw = first_string(v, DOCUMENT_NAMES)
    return F.when(raw != "", F.when(raw.startswith("data:") & F.contains(raw, F.lit(",")), F.regexp_extract(raw, r"(?s)^[^,]*,(.*)$", 1)).otherwise(raw))


def reason(payload: Column, v: Column) -> Column:
    """Why a payload gives nothing: null where it has pages or a document."""
    return F.when(payload.isNull(), "no payload").when(v.isNull(), "no JSON object").when((F.size(pages(v, 1_000_000)) == 0) & document(v).isNull(), "no page")
