"""Columns over labelled texts and layered settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import config
from quire.functions import text as T


def labelled(text: Column, pattern: str = r"\[([^\]]+)\]\s*([^\[]+)") -> Column:
    """Map of the labels in a text to what follows each: `[label] value [label] value`; the last of equal labels counts."""
    parts = [F.transform(F.regexp_extract_all(text, F.lit(pattern), k), T.strip) for k in (1, 2)]
    pairs = F.reverse(F.arrays_zip(parts[0].alias("key"), parts[1].alias("value")))
    first = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))))
    return F.coalesce(first, F.create_map().cast("map<string,string>"))


def image_prompt(prompt: Column, description: Column, category: Column, guides: dict[str, str], labels: config.PromptParts = config.PromptParts()) -> Column:
    """The request for an image, a line for each part: the guide of its type, else its direction; purpose, content, topic; rules.

    A prompt without labels is taken as it is, with description and category. Null stands for an empty text.
    """
    seed = T.strip(F.coalesce(prompt, F.lit("")))
    parts = labelled(seed)
    value = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in guides.items() for x in kv]) if guides else F.create_map().cast("map<string,string>")
    guide = F.coalesce(F.try_element_at(known, value(labels.type)), F.lit(""))
    said = lambda text, c: F.when(c != "", F.concat(F.lit(text), c))
    given = F.array(F.when(guide != "", guide).otherwise(said("", value(labels.direction))), said("Visual purpose: ", value(labels.purpose)), said("Content to depict: ", value(labels.content)), said("Document context: ", value(labels.topic)))
    plain = F.array(said("", seed), said("", F.coalesce(description, F.lit(""))), said("Figure type: ", F.coalesce(category, F.lit(""))))
    rules = F.array(*map(F.lit, labels.rules))
    return F.array_join(F.concat(F.array_compact(F.when(F.size(parts) > 0, given).otherwise(plain)), rules), "\n")


def parsed(text: Column) -> Column:
    """Map of the settings in a file's text: lines `key=value`, without quotes; comments, empty values and placeholders in braces go.

    Of equal keys the first counts. Null gives an empty map.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n?|\n"), T.strip), lambda x: ~x.startswith("#") & F.contains(x, F.lit("=")))
    key = lambda x: T.strip(F.regexp_extract(x, r"^([^=]*)=", 1))
    value = lambda x: F.btrim(F.btrim(T.strip(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)), F.lit('"')), F.lit("'"))
    pairs = F.filter(F.transform(lines, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != "") & ~p["value"].rlike(r"[{}]"))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))))


def layered(*layers: Column) -> Column:
    """One map of several: the first layer that has a key, and a value that is not empty, gives it."""
    some = lambda v: F.when(v != "", v)
    empty = F.create_map().cast("map<string,string>")
    merged = reduce(lambda a, b: F.map_zip_with(a, F.coalesce(b, empty), lambda _, x, y: F.coalesce(some(x), some(y))), layers[1:], F.coalesce(layers[0], empty))
    return F.map_filter(merged, lambda _, v: F.coalesce(v, F.lit("")) != "")


def setting(settings: Column, *names: str) -> Column:
    """The first of the named settings that is there, without slashes at its end, or null."""
    return F.coalesce(*[F.rtrim(F.try_element_at(settings, F.lit(k)), F.lit("/")) for k in names])
