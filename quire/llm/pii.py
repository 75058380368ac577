"""Operator 7: personal data, by patterns and by what other terms disclose of it.

The patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. Terms may give an entity
away although they match no pattern, such as a name that stands near one address. The unit of evidence is a distinct line of
text, so that copies add nothing. Over all documents, with N lines, n(e) lines with entity e, n(t) with term t and n(e, t) with
t within CONTEXT words of e, a term discloses e if

    n(e, t) >= SUPPORT,   n(e, t) / n(t) >= GENERALISE,   log2(N n(e, t) / (n(e) n(t))) >= BITS.

Lines of one entity whose other words, beyond CONTEXT words of any entity, are nearly the same are copies: but one of them
counts, in n(e), n(e, t) and n(t). The neighbours themselves are not compared, so that a signature that recurs on different
lines is evidence; so is each different line with under REST other words. Near copies are found by BANDS of ROWS minimum hashes, so that of
lines that share nine tenths of these words all but some millionths are found. Disclosing terms are generalised to the kind of
entity they disclose most of (`[EMAIL TERM]`); from REMOVE on they are removed. Entities become `[EMAIL]` and the like.

Scale: three passes over the texts and no shuffle of texts. Only (entity, term, line digest) and (entity, line digest, bucket) rows of
entities, and (term, line digest) rows of terms with enough support, are shuffled, pre-aggregated. A term with n(e, t) can pass
only while n(t) <= n(e, t) / GENERALISE; a task that finds it on more lines says so in one row and stops counting it, so that
no term has more rows in a task than this bound. Term tables are broadcast up to MAX_TERM_BYTES; beyond
that words are joined by key. All patterns take time linear in a text, however long its runs are.

Cases: a null text has no spans and stays null. Offsets are code points, the end exclusive. Equal rows are judged alike. A null
doc_id is passed on. All other columns are kept by `sanitise`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.llm import common, kernels

KINDS = ("email", "ip", "card", "phone")
CONTEXT, SUPPORT, GENERALISE, REMOVE, BITS = 8, 3, 0.5, 0.9, 6.0
REST, BANDS, ROWS = 8, 10, 3
#: Bytes of terms, with TERM_BYTES for what belongs to each, that may be broadcast.
MAX_TERM_BYTES, TERM_BYTES = 64 << 20, 150

# Possessive runs and a look at the character before keep them linear; what they match is what the plain patterns match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_SEEDS = kernels.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out = []
    if "@" in text:
        free = 0
        for m in _DOMAIN.finditer(text):
            start = at = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                free = m.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _line(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def _digest(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _outside(spans: list[tuple[str, int, int]]):
    """A test whether a match overlaps none of the spans, by binary search in their union."""
    starts, ends = [], []
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start), ends.append(end)

    def test(m: re.Match) -> bool:
        k = bisect_left(starts, m.end())
        return k == 0 or ends[k - 1] <= m.start()

    return test


def _entity(text: str, span: tuple[str, int, int]) -> str:
    kind, start, end = span
    return f"{kind}:" + re.sub(r"[^0-9.]" if kind != "email" else "$^", "", text[start:end].lower())


def _terms(text: str, a: int = 0, b: int | None = None) -> list[re.Match]:
    """The words of three letters or more; the one tokeniser of this module."""
    return list(_TERM.finditer(text, a, len(text) if b is None else b))


def _evidence(text: str):
    """(entity, term, line digest, bucket) rows of each line that holds entities.

    A row without term and bucket for each entity of a line, one with a term for each term within CONTEXT words of it, and, if
    the line has REST other words, one for each band of minimum hashes; near copies of a line share a bucket with it.
    """
    spans = sorted(base_spans(text), key=lambda s: s[1])
    k = 0
    while k < len(spans):
        a, b = _line(text, spans[k][1])
        own = []
        while k < len(spans) and spans[k][1] < b:
            own.append(spans[k])
            k += 1
        digest, outside = _digest(text[a:b]), _outside(own)
        words = [m for m in _terms(text, a, b) if outside(m)]
        starts, low, near = [m.start() for m in words], [m[0].lower() for m in words], np.zeros(len(words) + 1, np.int64)
        for span in own:
            key = _entity(text, span)
            i, j = bisect_left(starts, span[1]), bisect_left(starts, span[2])
            first, last = max(0, i - CONTEXT), min(len(words), j + CONTEXT)
            near[first] += 1
            near[last] -= 1
            yield key, None, digest, None
            for term in {*low[first:i], *low[j:last]}:
                yield key, term, digest, None
        rest = {x for x, n in zip(low, np.cumsum(near[:-1]).tolist(), strict=True) if not n}
        if len(rest) < REST:
            continue
        h = np.array([_digest(x) for x in rest], np.int64).view(np.uint64)
        least = np.array([kernels.mix(h ^ seed).min() for seed in _SEEDS]).reshape(BANDS, ROWS)
        buckets = [_digest(f"{i}:{x.tolist()}") for i, x in enumerate(least)]
        for key in {_entity(text, s) for s in own}:
            for bucket in buckets:
                yield key, None, digest, bucket


def _broadcastable(terms: DataFrame) -> bool:
    """Whether the bytes of the column `term` allow to send it to every task."""
    return (terms.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0) <= MAX_TERM_BYTES


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """term, p, kind: the terms that disclose some entity, with the largest n(e, t) / n(t) and the kind of that entity."""

    def near(batches):
        for batch in kernels.parts(batches):
            rows, lines = [], 0
            for text in batch.column(0):
                if text := text.as_py():
                    lines += 1 + text.count("\n")
                    rows += _evidence(text)
            rows.append((None, None, lines, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["entity", "term", "line", "bucket"])

    texts = docs.select("text")
    seen = common.durable(texts.mapInArrow(near, "entity string, term string, line long, bucket long"))
    lines = seen.filter("entity IS NULL").agg(F.sum("line")).first()[0] or 0
    inside = seen.filter("bucket IS NOT NULL").distinct()
    first = inside.groupBy("entity", "bucket").agg(F.min("line").alias("first"), F.count("*").alias("k")).filter("k > 1").select("entity", "bucket", "first")
    copied = inside.join(first, ["entity", "bucket"]).filter("line <> first").select("entity", "line").distinct().withColumn("copy", F.lit(True))
    rows = seen.filter("entity IS NOT NULL AND bucket IS NULL").select("entity", "term", "line").distinct().join(copied, ["entity", "line"], "left")
    each = rows.groupBy("entity", "term").agg(F.count_if(F.col("copy").isNull()).alias("both"), F.count("copy").alias("copies"))
    each = common.durable(each.filter((F.col("both") >= SUPPORT) | F.col("term").isNull()))
    joint = each.filter("term IS NOT NULL").join(each.filter("term IS NULL").select("entity", F.col("both").alias("own")), "entity")
    # Lines near any entity are a part of all lines, so that a term too frequent among them is so among all.
    close = rows.filter("term IS NOT NULL").select("term", "line").distinct().groupBy("term").agg(F.count("*").alias("close"))
    joint = joint.join(close, "term").filter(F.col("both") / (F.col("close") - F.col("copies")) >= GENERALISE).drop("close")
    joint = common.durable(joint)
    if joint.isEmpty():
        return joint.select("term", F.lit(1.0).alias("p"), F.lit("").alias("kind"))
    # A term on more lines than this passes for no entity.
    most = joint.groupBy("term").agg(F.floor(F.max(F.col("both") / GENERALISE + F.col("copies"))).alias("most"))
    known = {r.term: r.most for r in most.collect()} if _broadcastable(most) else None

    def where(batches):
        at: dict[str, set[int]] = {}
        common_ = set()
        for batch in kernels.parts(batches):
            rows = []
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    found = {m.lower() for m in _TERM.findall(line)}
                    if known is None:
                        digest = _digest(line)
                        rows += [(t, digest) for t in found]
                    elif found := (known.keys() & found) - common_:
                        digest = _digest(line)
                        for t in found:
                            at.setdefault(t, set()).add(digest)
                            if len(at[t]) > known[t]:
                                common_.add(t)
                                del at[t]
            if known is None:
                yield pairs(rows)
        yield pairs([(t, x) for t, own in at.items() for x in own])
        yield pairs([(t, None) for t in common_])

    def pairs(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "line"])

    at = texts.mapInArrow(where, "term string, line long")
    at = at if known is not None else at.join(most, "term", "left_semi")
    counts = at.distinct().groupBy("term").agg(F.count("line").alias("n"), F.max(F.col("line").isNull()).alias("over")).filter("NOT over")
    n = F.col("n") - F.col("copies")
    p, bits = F.col("both") / n, F.log2(F.col("both") * F.lit(float(lines)) / (F.col("own") * n))
    passed = joint.join(counts, "term").filter((p >= GENERALISE) & (bits >= BITS))
    best = F.min_by(F.substring_index("entity", ":", 1), F.struct(-p, "entity"))
    return passed.groupBy("term").agg(F.max(p).alias("p"), best.alias("kind"))


def _with_terms(docs: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, str]] | None]:
    """Few disclosing terms come as a dict; very many as one more, last column of those that a text has, joined by key."""
    terms = common.durable(disclosing_terms(docs))
    if _broadcastable(terms):
        return docs, {r.term: (r.p, r.kind) for r in terms.collect()}
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name in use
    key, own_terms = f"{free}row", f"{free}terms"
    row = F.xxhash64(F.coalesce("text", F.lit("")))

    def words(batches):
        for batch in kernels.parts(batches):
            rows = [(k, t) for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in {m[0].lower() for m in _terms(text.as_py() or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["key", "term"])

    each = docs.select(row.alias("key"), "text").mapInArrow(words, "key long, term string")
    own = each.distinct().join(terms, "term").groupBy(F.col("key").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("p", "kind")))).alias(own_terms))
    return docs.withColumn(key, row).join(own, key, "left").drop(key), None


def _own_terms(held) -> dict[str, tuple[float, str]]:
    return {t: (x["p"], x["kind"]) for t, x in held.as_py() or ()}


def all_spans(text: str, terms: dict[str, tuple[float, str]]) -> list[tuple[str, int, int]]:
    """The base spans, then those of disclosing terms (kind `term`) outside them."""
    base = base_spans(text)
    if not terms:
        return base
    outside = _outside(base)
    return base + [("term", *m.span()) for m in _terms(text) if m[0].lower() in terms and outside(m)]


def clean(text: str, spans: list[tuple[str, int, int]], terms: dict[str, tuple[float, str]]) -> str:
    """The text with its spans replaced; of overlapping spans the first names the whole."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out.append(text[at:start])
            if kind == "term":
                p, of = terms[text[start:end].lower()]
                out.append("" if p >= REMOVE else f"[{of.upper()} TERM]")
            else:
                out.append(f"[{kind.upper()}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end) for each row of `docs` (doc_id, text)."""
    rows, few = _with_terms(docs.select("doc_id", "text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in kernels.parts(batches):
            own = batch.column(2) if few is None else None
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_spans(t.as_py() or "", few if own is None else _own_terms(own[i]))] for i, t in enumerate(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data and disclosing terms in `text` replaced; all columns stay."""
    rows, few = _with_terms(docs)
    at, names = docs.columns.index("text"), docs.columns
    schema = StructType([StructField(f.name, StringType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches):
        for batch in kernels.parts(batches):
            own = batch.column(len(names)) if few is None else None
            out = []
            for i, t in enumerate(batch.column(at)):
                text, terms = t.as_py(), few if own is None else _own_terms(own[i])
                out.append(clean(text, all_spans(text, terms), terms) if text else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    return rows.mapInArrow(run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find(common.read(spark, sf_dir, "documents"))
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *map(of, KINDS), F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
