"""Files of record streams: contracts, feature checks, comparison of two files, reports.

`streams`: file, stream; a row for each stream that a file has. `records`: file, stream, ord, tag, level, data (and offset, size).
Every finding is a row of FINDING columns: offset -1 stands for the stream as a whole, name for the record's tag. All windows
are by (file, stream); files meet their streams by joins on these keys, and nothing is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import config
from quire.operators import levels

FINDING = ("file", "stream", "offset", "name", "rule", "severity", "detail")


def tag_name(tag: Column) -> Column:
    """The name of a record's tag; `TAG_0x...` for an unknown one."""
    names = F.create_map(*[F.lit(x) for kv in config.TAG_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, tag), F.concat(F.lit("TAG_0x"), F.lpad(F.lower(F.hex(tag)), 3, "0")))


def control(tag: Column, data: Column) -> Column:
    """The four bytes of a control header, as text; null for other records and short payloads."""
    return F.when((tag == config.CTRL_HEADER) & (F.octet_length(data) >= 4), F.decode(F.substring(data, 1, 4), "ISO-8859-1"))


def control_name(ctrl: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in config.CONTROL_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, ctrl), ctrl)


def number_at(data: Column, at: int, size: int) -> Column:
    """The little-endian number of `size` bytes from the byte `at` (from 0); null for a shorter payload."""
    parts = [F.substring(data, at + 1 + k, 1) for k in reversed(range(size))]
    return F.when(F.octet_length(data) >= at + size, F.conv(F.hex(F.concat(*parts)), 16, 10).cast("long"))


def _w():
    return Window.partitionBy("file", "stream").orderBy("ord")


def numbered(records: DataFrame) -> DataFrame:
    """Adds i (the position in its stream, from 0), offset, size, ctrl, and prev_tag, prev_level of the record before."""
    size = F.octet_length("data").cast("long") if "size" not in records.columns else F.col("size")
    rows = records.withColumn("size", size).withColumn("i", F.row_number().over(_w()) - 1)
    if "offset" not in records.columns:
        rows = rows.withColumn("offset", F.sum(F.col("size") + 4).over(_w()) - F.col("size") - 4)
    return rows.withColumns({"ctrl": control(F.col("tag"), F.col("data")), "prev_tag": F.lag("tag").over(_w()), "prev_level": F.lag("level").over(_w())})


def _is(kind: str) -> Column:
    return F.col("stream").startswith(kind)


def _found(rows: DataFrame, rule: str, severity: str, name=None, detail=None, offset=None) -> DataFrame:
    name = tag_name(F.col("tag")) if name is None else F.lit(name) if isinstance(name, str) else name
    detail = F.lit(None).cast("string") if detail is None else detail
    return rows.select("file", "stream", (F.col("offset") if offset is None else F.lit(offset)).cast("long").alias("offset"), name.alias("name"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def empty_streams(streams: DataFrame, records: DataFrame) -> DataFrame:
    return streams.join(records.select("file", "stream").distinct(), ["file", "stream"], "left_anti")


def first_sections(streams: DataFrame, limit: int) -> DataFrame:
    """`streams` with at most `limit` sections of each file, in lexicographic order (0: all)."""
    if not limit:
        return streams
    rank = F.row_number().over(Window.partitionBy("file", _is(config.SECTION_STREAM)).orderBy("stream"))
    return streams.withColumn("_rank", rank).filter(~_is(config.SECTION_STREAM) | (F.col("_rank") <= limit)).drop("_rank")


def _each(rows: DataFrame, cases: list[tuple]) -> DataFrame:
    """The findings of rows: cases are (condition, rule, severity, name, detail, offset), all looked at in one pass."""
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c
    made = [F.when(cond, F.struct((F.col("offset") if at is None else F.lit(at)).cast("long").alias("offset"), (tag_name(F.col("tag")) if name is None else text(name)).alias("name"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text(detail).alias("detail"))) for cond, rule, severity, name, detail, at in cases]
    return rows.select("file", "stream", F.explode(F.array_compact(F.array(*made))).alias("f")).select("file", "stream", "f.*")


def record_rules(records: DataFrame) -> DataFrame:
    """Findings on single records and their neighbours, in one pass: R-012 first tags and R-015 levels of the document stream; R-031
    first tag, R-040 level jumps, R-041 controls without a list, R-042 texts without a head in sections; R-070 first tag of master pages."""
    doc, section, master = F.col("stream") == config.DOC_STREAM, _is(config.SECTION_STREAM), _is(config.MASTER_STREAM)
    rows = numbered(records.filter(doc | section | master))
    rows = rows.withColumn("ahead", F.collect_list(F.struct("tag", "level")).over(_w().rowsBetween(1, config.LOOK_AHEAD)))
    state = F.aggregate(
        "ahead", F.lit(0),
        lambda s, x: F.when(s != 0, s).when((x["level"] <= F.col("level")) & (x["tag"] != config.CTRL_DATA), F.lit(-1)).when((x["tag"] == config.LIST_HEADER) & (x["level"] == F.col("level") + 1), F.lit(1)).otherwise(s),
    )
    tag, first, head = F.col("tag"), F.col("i") == 0, F.col("tag") == config.PARA_HEAD
    return _each(rows, [
        *((doc & (F.col("i") == i) & (tag != want), "R-012", "CRITICAL", None, None, None) for i, want in enumerate((config.DOC_PROPERTIES, config.ID_MAPPINGS))),
        (doc & (F.col("level") != 0), "R-015", "MEDIUM", None, None, None), (section & first & ~head, "R-031", "CRITICAL", None, None, None), (section & (F.col("level") - F.col("prev_level") > 1), "R-040", "HIGH", None, None, None),
        (section & (tag == config.CTRL_HEADER) & (state != 1), "R-041", "HIGH", None, control_name(F.col("ctrl")), None), (section & (tag == config.PARA_TEXT) & ~F.col("prev_tag").eqNullSafe(F.lit(config.PARA_HEAD)), "R-042", "MEDIUM", None, None, None),
        (master & first & ~head, "R-070", "MEDIUM", None, None, None),
    ])


def document_counts(records: DataFrame) -> DataFrame:
    """Findings on document streams as wholes: R-012 records that lack, R-013 required tag, R-014 declared counts that are not the
    actual ones, or a payload too short for them. One row of counts for each stream is all that is gathered."""
    doc = numbered(records.filter(F.col("stream") == config.DOC_STREAM))
    maps = (F.col("i") == 1) & (F.col("tag") == config.ID_MAPPINGS)
    counts = F.struct(*[F.count_if((F.col("i") >= 2) & (F.col("tag") == t)).alias(f"t{t}") for t in config.DECLARED_TAGS])
    whole = doc.groupBy("file", "stream").agg(F.count("*").alias("n"), F.max(F.col("tag") == config.COMPATIBLE_DOCUMENT).alias("compatible"), F.max(F.when(maps, F.struct("offset", "data"))).alias("maps"), counts.alias("actual"))
    code, need, data = lambda tag: f"TAG_{tag:#05x}", 4 * len(config.DECLARED_TAGS), F.col("maps.data")
    at = F.col("maps.offset")
    said = [(number_at(data, 4 * k, 4), F.col(f"actual.t{t}"), t) for k, t in enumerate(config.DECLARED_TAGS)]
    return _each(whole, [
        *((F.col("n") <= i, "R-012", "CRITICAL", code(t), None, -1) for i, t in enumerate((config.DOC_PROPERTIES, config.ID_MAPPINGS))), (~F.col("compatible"), "R-013", "HIGH", code(config.COMPATIBLE_DOCUMENT), None, -1),
        (F.col("maps").isNotNull() & (F.octet_length(data) < need), "R-014", "HIGH", tag_name(F.lit(config.ID_MAPPINGS)), "too short", at),
        *((F.col("maps").isNotNull() & (F.octet_length(data) >= need) & (declared != actual), "R-014", "HIGH", "ID_MAPPINGS", F.concat_ws(":", tag_name(F.lit(t)), declared.cast("string"), actual.cast("string")), at) for declared, actual, t in said),
    ])


def stream_rules(streams: DataFrame, records: DataFrame) -> DataFrame:
    """Findings on streams that lack or are empty: R-010 no document stream, R-011 an empty one, R-030 an empty section."""
    doc = F.col("stream") == config.DOC_STREAM
    filled = records.groupBy("file", "stream").agg(F.count("*").alias("n"))
    own = _each(streams.join(filled, ["file", "stream"], "left"), [(doc & F.col("n").isNull(), "R-011", "CRITICAL", "STREAM", None, -1), (_is(config.SECTION_STREAM) & F.col("n").isNull(), "R-030", "CRITICAL", "STREAM", None, -1)])
    absent = streams.groupBy("file").agg(F.max(doc).alias("has"), F.lit(config.DOC_STREAM).alias("stream"))
    return own.unionAll(_each(absent, [(~F.col("has"), "R-010", "CRITICAL", "STREAM", None, -1)]))


def document_rules(streams: DataFrame, records: DataFrame) -> DataFrame:
    """The findings on document streams alone: R-010 to R-015."""
    own = records.filter(F.col("stream") == config.DOC_STREAM)
    return _union([stream_rules(streams, own).filter("rule IN ('R-010', 'R-011')"), document_counts(own), record_rules(own)])


def section_rules(streams: DataFrame, records: DataFrame) -> DataFrame:
    """The findings of `record_rules` and `stream_rules` on sections alone."""
    own = records.filter(_is(config.SECTION_STREAM))
    return record_rules(own).unionAll(stream_rules(streams.filter(_is(config.SECTION_STREAM)), own).filter("rule = 'R-030'"))


def file_version(header: Column) -> Column:
    """major.minor.micro.build from the bytes of a file header; 0.0.0.0 for a shorter one."""
    parts = [number_at(header, at, 1).cast("string") for at in (35, 34, 33, 32)]
    return F.when(F.octet_length(header) >= 36, F.concat_ws(".", *parts)).otherwise("0.0.0.0")


def file_flags(header: Column) -> Column:
    """Map of the named flags of a file header; empty for a shorter one."""
    word = number_at(header, 36, 4)
    made = F.map_from_arrays(F.array(*map(F.lit, config.FILE_FLAGS)), F.array(*[F.getbit(word, F.lit(k)) == 1 for k in range(len(config.FILE_FLAGS))]))
    return F.when(F.octet_length(header) >= 40, made).otherwise(F.create_map().cast("map<string,boolean>"))


def header_rules(files: DataFrame, headers: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Findings on files: R-000 those that couldn't be opened, R-001 no header or another signature, R-002 a version before 5.

    `files`: file. `headers`: file, data: the bytes of each file's header. `failures`: file, reason; such a file is judged by
    nothing else.
    """
    rows = files.select("file").distinct().join(headers.groupBy("file").agg(F.first("data", ignorenulls=True).alias("data")), "file", "left")
    if failures is not None:
        rows = rows.join(failures.groupBy("file").agg(F.min("reason").alias("reason")), "file", "full_outer")
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    data, opened = F.col("data"), F.col("reason").isNull()
    signed = F.hex(F.substring(data, 1, len(config.FILE_SIGNATURE))) == config.FILE_SIGNATURE.encode().hex().upper()
    head = rows.withColumn("stream", F.when(opened, "FileHeader").otherwise("<open>"))
    return _each(head, [
        (~opened, "R-000", "CRITICAL", "FILE", F.col("reason"), -1), (opened & data.isNull(), "R-001", "CRITICAL", "FILE_SIGNATURE", "missing", -1), (opened & ~signed, "R-001", "CRITICAL", "FILE_SIGNATURE", "absent", -1),
        (opened & signed & (F.split_part(file_version(data), F.lit("."), F.lit(1)).cast("int") < 5), "R-002", "HIGH", "HWP_VERSION", file_version(data), -1),
    ])


def _opened(rows: DataFrame, failures: DataFrame | None) -> DataFrame:
    return rows if failures is None else rows.join(failures.select("file").distinct(), "file", "left_anti")


def contract(streams: DataFrame, records: DataFrame, max_sections: int = 0, headers: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """All contract findings of each file; with `headers` and `failures` as in `header_rules`, also on the files as such."""
    streams, records = _opened(streams, failures), _opened(records, failures)
    some = first_sections(streams, max_sections)
    own = records.join(some, ["file", "stream"], "left_semi") if max_sections else records
    parts = [stream_rules(some, own), document_counts(own), record_rules(own)]
    return _union(parts if headers is None else [*parts, header_rules(streams, headers, failures)])


def column_checks(records: DataFrame) -> DataFrame:
    """multicol: section controls without a later, deeper column control, and column controls with a bad count.

    A column control is reported once, with the number of section controls that it follows on a deeper level as detail.
    """
    rows = numbered(records.filter(_is(config.SECTION_STREAM)))
    secd, cold = F.col("ctrl") == "secd", F.col("ctrl") == "cold"
    rows = rows.filter(secd | cold).withColumn("is_secd", secd)
    backwards = Window.partitionBy("file", "stream").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("later", F.max(F.when(cold, F.col("level"))).over(backwards))
    rows = levels.enclosed(rows, ["file", "stream"], "i", marked="is_secd")
    count = number_at(F.col("data"), 0, 2)
    return _each(rows, [
        (secd & ~F.coalesce(F.col("later") > F.col("level"), F.lit(False)), "multicol", "INFO", "CTRL_HEADER(secd)", None, None),
        (cold & (F.col("shallower") > 0) & ~F.coalesce(count.between(*config.COLUMNS), F.lit(False)), "multicol", "ERROR", "CTRL_HEADER(cold)", F.col("shallower").cast("string"), None),
    ])


def master_checks(streams: DataFrame, records: DataFrame) -> DataFrame:
    """masterpage: none although headers or footers occur, empty ones, ones with another first record, children without a list."""
    masters = streams.filter(_is(config.MASTER_STREAM))
    marked = numbered(records.filter(_is(config.SECTION_STREAM))).filter(F.col("ctrl").isin("hdr ", "ftr ")).select("file").distinct()
    none = marked.join(masters, "file", "left_anti").withColumn("stream", F.lit(config.MASTER_STREAM))
    rows = numbered(records.filter(_is(config.MASTER_STREAM)))
    child = (F.col("level") > F.col("prev_level")) & ~F.col("prev_tag").isin(config.LIST_HEADER, config.CTRL_HEADER)
    return _union([
        _found(none, "masterpage", "WARN", "STREAM", offset=-1),
        _found(empty_streams(masters, records), "masterpage", "ERROR", "STREAM", offset=-1),
        _found(rows.filter((F.col("i") == 0) & (F.col("tag") != config.PARA_HEAD)), "masterpage", "ERROR"),
        _found(rows.filter(child), "masterpage", "WARN"),
    ])


def control_checks(records: DataFrame) -> DataFrame:
    """controls: unknown ones, unknown ones without control data among the next records, and those handled in part only."""
    rows = numbered(records.filter(_is(config.SECTION_STREAM)))
    ahead = reduce(lambda a, k: a | F.coalesce((F.lead("tag", k).over(_w()) == config.CTRL_DATA) & (F.lead("level", k).over(_w()) == F.col("level")), F.lit(False)), range(1, config.DATA_AHEAD + 1), F.lit(False))
    rows = rows.withColumn("fed", ahead).filter("ctrl IS NOT NULL")
    unknown = ~F.col("ctrl").isin(*config.CONTROL_NAMES)
    return _each(rows, [
        (unknown, "controls", "ERROR", None, "unknown", None), (unknown & ~F.col("fed"), "controls", "ERROR", None, "no data", None),
        (F.col("ctrl").isin(*config.PARTIAL_CONTROLS), "controls", "WARN", None, control_name(F.col("ctrl")), None),
    ])


def _list_children(rows: DataFrame) -> DataFrame:
    """Lists with `declared` and `actual`, the number of paragraph heads one level below, up to the next record of their level or above.

    A head belongs to the nearest record before it of a smaller level, if that is a list one level above.
    """
    heads = levels.enclosed(rows.select("file", "stream", "i", "tag", "level"), ["file", "stream"], "i").filter(F.col("tag") == config.PARA_HEAD)
    actual = heads.groupBy("file", "stream", F.col("above").alias("i"), (F.col("level") - 1).alias("level")).agg(F.count("*").alias("actual"))
    lists = rows.filter(F.col("tag") == config.LIST_HEADER).withColumn("declared", number_at(F.col("data"), 0, 2))
    return lists.join(actual, ["file", "stream", "i", "level"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))


def structure_checks(records: DataFrame) -> DataFrame:
    """structure: level gaps (S-001) and lists whose declared number of paragraphs is short or wrong (S-002)."""
    rows = numbered(records.filter((F.col("stream") == config.DOC_STREAM) | _is(config.SECTION_STREAM) | _is(config.MASTER_STREAM)))
    gap = rows.filter(F.col("level") > F.coalesce("prev_level", F.lit(0)) + 1)
    lists = rows.filter(F.col("tag") == config.LIST_HEADER)
    short = lists.filter(F.octet_length("data") < 2)
    counted = _list_children(rows).filter("declared <> actual")
    return _union([
        _found(gap, "S-001", "ERROR"), _found(short, "S-002", "ERROR", detail=F.lit("too short")),
        _found(counted, "S-002", "WARN", detail=F.concat_ws(":", F.col("declared").cast("string"), F.col("actual").cast("string"))),
    ])


CHECKS = ("multicol", "masterpage", "controls", "structure")


def verify(streams: DataFrame, records: DataFrame, features: tuple[str, ...] = CHECKS, failures: DataFrame | None = None) -> DataFrame:
    """The findings of the chosen feature checks; `feature` names the check. Files of `failures` (file, reason) are an ERROR each."""
    streams, records = _opened(streams, failures), _opened(records, failures)
    made = {"multicol": lambda: column_checks(records), "masterpage": lambda: master_checks(streams, records), "controls": lambda: control_checks(records), "structure": lambda: structure_checks(records)}
    parts = [made[f]().withColumn("feature", F.lit(f)) for f in features]
    return _union(parts if failures is None else [*parts, _not_opened(failures, "open", "ERROR").withColumn("feature", F.lit("open"))])


def _not_opened(failures: DataFrame, rule: str, severity: str) -> DataFrame:
    rows = failures.groupBy("file").agg(F.min("reason").alias("reason"), F.lit("<open>").alias("stream"))
    return _found(rows, rule, severity, "FILE", F.col("reason"), -1)


def report(files: DataFrame, findings: DataFrame, severities: tuple[str, ...] = ("CRITICAL", "HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """file, n_... for each severity, passed, status for every row of `files` (file); a file without findings passes."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in severities]
    per = findings.groupBy("file").agg(*counts)
    zero = [F.coalesce(f"n_{s.lower()}", F.lit(0)).alias(f"n_{s.lower()}") for s in severities]
    bad = [s for s in severities if s in ("CRITICAL", "HIGH", "ERROR")]
    passed = reduce(lambda c, s: c & (F.col(f"n_{s.lower()}") == 0), bad, F.lit(True))
    return files.select("file").distinct().join(per, "file", "left").select("file", *zero).withColumn("passed", passed).withColumn("status", F.when(passed, "PASS").otherwise("FAIL"))


def all_files(files: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """file: those of `files` and those that couldn't be opened."""
    own = files.select("file")
    return (own if failures is None else own.union(failures.select("file"))).distinct()


def listing(findings: DataFrame) -> DataFrame:
    """Adds rank: the order in which a file's findings are printed, by the name of the severity."""
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("severity", "stream", "offset", "rule", "detail")))


def display(records: DataFrame) -> DataFrame:
    """Adds name, control (its name) and line: the record as one indented line of text with the start of its data in hex."""
    rows = numbered(records).withColumns({"name": tag_name(F.col("tag")), "control": control_name(F.col("ctrl"))})
    ctrl = F.when(F.col("control") != "", F.concat(F.lit(" ctrl='"), "control", F.lit("'"))).otherwise("")
    raw = F.when(F.octet_length("data") > 0, F.concat(F.lit(" "), F.lower(F.hex(F.substring("data", 1, 16))))).otherwise("")
    place = F.concat(F.lit("[0x"), F.lpad(F.lower(F.hex("offset")), 8, "0"), F.lit("] L"), F.lpad(F.col("level").cast("string"), 2, "0"))
    return rows.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("level")), place, F.lit(" "), "name", F.coalesce(ctrl, F.lit("")), F.lit(" sz="), F.col("size").cast("string"), raw))


def first_difference(a: Column, b: Column) -> Column:
    """The position (from 0) of the first byte in which two binaries differ, or the length of the shorter one: by halving steps."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])

    def longer(at: Column, step: Column) -> Column:
        return F.when((step <= n - at) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), longer)


def _compared(stream: Column) -> Column:
    return stream.isin("FileHeader", config.DOC_STREAM) | stream.startswith(config.SECTION_STREAM) | stream.startswith(config.MASTER_STREAM)


def compare(reference: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], max_sections: int = 0, failures: DataFrame | None = None) -> DataFrame:
    """file, stream, i, kind, severity, differs_at of all differences between two versions of files, each a pair (streams, records).

    With max_sections only the first so many sections of each version count. A file of `failures` (file, reason), of which a
    version couldn't be opened, is one difference in the stream <open>.

    A stream of one side is a difference without i. In streams of both, records meet by position: one without a partner, another
    tag (which hides the rest), level, size, and data (differs_at: the first byte that differs, on the common prefix of records of
    different size).
    """
    reference, candidate = (tuple(_opened(x, failures) for x in (first_sections(s, max_sections), r)) for s, r in (reference, candidate))
    sides = [s.filter(_compared(F.col("stream"))).select("file", "stream").distinct().withColumn(f"in_{k}", F.lit(True)) for k, (s, _) in zip("ab", (reference, candidate), strict=True)]
    names = sides[0].join(sides[1], ["file", "stream"], "full_outer")
    only = lambda k, kind, severity: names.filter(F.col(f"in_{k}").isNull()).select("file", "stream", F.lit(None).cast("int").alias("i"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(None).cast("int").alias("differs_at"))
    shared = names.filter("in_a AND in_b").select("file", "stream")
    rows = []
    for k, (_, records) in zip("ab", (reference, candidate), strict=True):
        r = numbered(records.filter(_compared(F.col("stream"))))
        rows.append(r.select("file", "stream", "i", *[F.col(c).alias(f"{k}_{c}") for c in ("tag", "level", "size", "data")]))
    both = rows[0].join(rows[1], ["file", "stream", "i"], "full_outer").join(shared, ["file", "stream"], "left_semi")
    x, y = F.col("a_data"), F.col("b_data")
    n = F.least("a_size", "b_size").cast("int")
    x, y = F.substring(x, F.lit(1), n), F.substring(y, F.lit(1), n)
    both = both.withColumn("differs_at", F.when(x != y, first_difference(x, y)))
    diff = lambda cond, kind, severity, at=None: F.when(cond, F.struct(F.lit(kind).alias("kind"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (F.lit(None).cast("int") if at is None else at).alias("differs_at")))
    same = F.col("a_tag") == F.col("b_tag")
    weight = F.when(F.col("stream") == config.DOC_STREAM, "HIGH").otherwise("MEDIUM")
    found = F.array(
        diff(F.col("b_tag").isNull(), "MISSING", "CRITICAL"), diff(F.col("a_tag").isNull(), "EXTRA", "HIGH"), diff(~same, "TAG", "HIGH"), diff(same & (F.col("a_level") != F.col("b_level")), "LEVEL", "HIGH"),
        diff(same & (F.col("a_size") != F.col("b_size")), "SIZE", "HIGH"), diff(same & F.col("differs_at").isNotNull(), "DATA", weight, F.col("differs_at")),
    )
    records = both.select("file", "stream", "i", F.explode(F.array_compact(found)).alias("v")).select("file", "stream", "i", "v.*")
    out = only("b", "MISSING", "CRITICAL").unionAll(only("a", "EXTRA", "LOW")).unionAll(records)
    if failures is None:
        return out
    closed = _not_opened(failures, "MISSING", "CRITICAL")
    return out.unionAll(closed.select("file", "stream", F.lit(None).cast("int").alias("i"), F.col("rule").alias("kind"), "severity", F.lit(None).cast("int").alias("differs_at")))


def stream_names(*versions: DataFrame) -> DataFrame:
    """file, stream: each stream that one of the versions (streams) has."""
    return _union([v.select("file", "stream") for v in versions]).distinct()


def tag_counts(records: DataFrame) -> DataFrame:
    """file, stream, name, n: how many records of each tag a stream has."""
    return records.groupBy("file", "stream", tag_name(F.col("tag")).alias("name")).agg(F.count("*").alias("n"))


def trees(records: DataFrame, with_data: bool = False, most: int = 64) -> DataFrame:
    """file, stream, tree: the records of a stream as a JSON list, each with its children; with_data adds its first `most` bytes in hex.

    The text is put together from a piece for each record in order: after a record come its children, if the next one is deeper,
    or as many ends as the next one is less deep. The pieces of one stream meet in a row.
    """
    rows = levels.stacked(numbered(records), ["file", "stream"], "i")
    rows = rows.withColumns({"_next": F.lead("depth").over(_w()), "_prev": F.lag("depth").over(_w())})
    facts = F.to_json(F.struct(
        "tag", tag_name(F.col("tag")).alias("tag_name"), "level", "size", "offset", "stream", F.when(F.col("ctrl") != "", F.col("ctrl")).alias("ctrl_id"),
        *([F.when(F.octet_length("data") > 0, F.lower(F.hex(F.substring("data", 1, most)))).alias("data_hex")] if with_data else []),
    ))
    body, down = F.substring(facts, F.lit(1), F.length(facts) - 1), F.coalesce(F.col("_next"), F.lit(1))
    piece = F.concat(F.when(F.col("depth") <= F.col("_prev"), ",").otherwise(""), body, F.when(down > F.col("depth"), ',"children":[').otherwise(F.concat(F.lit("}"), F.repeat(F.lit("]}"), F.col("depth") - down))))
    each = F.array_sort(F.collect_list(F.struct("i", piece.alias("s"))))
    return rows.groupBy("file", "stream").agg(F.concat(F.lit("["), F.array_join(F.transform(each, lambda x: x["s"]), ""), F.lit("]")).alias("tree"))


def diff_report(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """`report` with the statuses of a comparison: IDENTICAL without differences, WARN without serious ones, FAIL."""
    out = report(files, diffs)
    none = reduce(lambda c, s: c & (F.col(f"n_{s}") == 0), ("critical", "high", "medium", "low"), F.lit(True))
    return out.withColumn("status", F.when(none, "IDENTICAL").when(F.col("passed"), "WARN").otherwise("FAIL")).drop("passed")


def prioritised(diffs: DataFrame) -> DataFrame:
    """Adds priority: within a file by severity, then file header, document stream, first section, others; then in order of streams and records."""
    rank = lambda column, keys: reduce(lambda c, k: c.when(column.startswith(k[1]), k[0]), enumerate(keys[1:], 1), F.when(column.startswith(keys[0]), 0)).otherwise(99)
    order = [rank(F.col("severity"), ("CRITICAL", "HIGH", "MEDIUM", "LOW")), rank(F.col("stream"), ("FileHeader", config.DOC_STREAM, f"{config.SECTION_STREAM}0")), "stream", F.col("i").asc_nulls_first(), rank(F.col("kind"), ("MISSING", "EXTRA", "TAG", "LEVEL", "SIZE", "DATA"))]
    return diffs.withColumn("priority", F.row_number().over(Window.partitionBy("file").orderBy(*order)))
