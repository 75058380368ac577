"""Operator 8: quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Each rule has one metric and a bound. On a sample the cascade measures what a rule
costs for each document and what share it rejects, and orders the rules by rejections per cost; a rule then sees only the
documents that all rules before it have passed. The order changes the work and never the result, since every rule is a pure
function of the text. Rules that share a metric share its cost.

Scale: one pass, no shuffle, 2 MB of text at a time in a worker. The sample is `SAMPLE_ROWS` rows of the first partitions,
measured inside a task, of which only sums come to the driver; only the order of the rules depends on it.

Cases: a null text has no words; empty and very short texts fail `few_words`. Repeated rows are judged alike. All columns of
the input stay; own columns of `judge` replace input columns of the same name, and `passing` adds none.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from quire.llm import common, kernels

#: Rows that fit the cascade's order.
SAMPLE_ROWS = 500
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Texts:
    """Metrics of a chunk of texts, each computed at most once, for the texts still in question."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n, self.held = data, offs, len(offs) - 1, {}

    def get(self, name: str) -> np.ndarray:
        if name not in self.held:
            self.held[name] = METRICS[name](self)
        return self.held[name]

    def words(self):
        if "words" not in self.held:
            self.held["words"] = kernels.words(self.data, self.offs)
        return self.held["words"]

    def only(self, rows: np.ndarray) -> Texts:
        """The texts of the given rows, with what is known of them."""
        size = np.diff(self.offs)
        out = Texts(self.data[np.repeat(rows, size)], np.concatenate([[0], np.cumsum(size[rows])]))
        out.held = {k: v[rows] for k, v in self.held.items() if k in METRICS}
        return out

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """The number of set flags, one a byte, for each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def _n_words(t: Texts) -> np.ndarray:
    return np.diff(t.words()[2]).astype(np.int64)


def _word_chars(t: Texts) -> np.ndarray:
    return t.sums(kernels.SPACE_WORDS[t.data] & ((t.data & 0xC0) != 0x80))


def _n_symbols(t: Texts) -> np.ndarray:
    return t.sums(_SYMBOL[t.data])


def _n_dup_lines(t: Texts) -> np.ndarray:
    out = np.zeros(t.n, np.int64)
    raw = t.data.tobytes()
    blank = b" \t\n\x0b\x0c\r"
    for i, (a, b) in enumerate(zip(t.offs[:-1].tolist(), t.offs[1:].tolist(), strict=True)):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(blank)]
        out[i] = len(lines) - len({*lines})
    return out


def _n_repeat_words(t: Texts) -> np.ndarray:
    starts, ends, first = t.words()
    out = np.zeros(t.n, np.int64)
    w = kernels.window_hashes(kernels.word_hashes(t.data, starts, ends), WINDOW)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > WINDOW:
            own = w[a : b - WINDOW + 1]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = np.zeros(len(own), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                step = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(twice)
                step[at] += 1
                step[at + WINDOW] -= 1
                out[i] = np.count_nonzero(np.cumsum(step[:-1]))
    return out


def _n_same_neighbours(t: Texts) -> np.ndarray:
    starts, ends, first = t.words()
    h = kernels.word_hashes(t.data, starts, ends)
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        same[1:-1] = h[1:] == h[:-1]
    same[first[:-1]] = 0
    total = np.concatenate([[0], np.cumsum(same)])
    return total[first[1:]] - total[first[:-1]]


def _n_lines(t: Texts) -> np.ndarray:
    return t.sums(t.data == 10) + 1


_BULLETS = tuple(x.encode() for x in "-*•‣▪●◦")
_ELLIPSES = (b"...", "…".encode())


def _has_at(data: np.ndarray, at: np.ndarray, room: np.ndarray, signs: tuple[bytes, ...]) -> np.ndarray:
    """Whether one of the signs stands at each place, which has `room` bytes."""
    out = np.zeros(len(at), bool)
    for sign in signs:
        ok = room >= len(sign)
        for k, byte in enumerate(sign):
            ok &= data[np.minimum(at + k, len(data) - 1)] == byte
        out |= ok
    return out


def _line_counts(t: Texts) -> None:
    """Lines with a word, and those of them that open with a bullet or end with an ellipsis; all three are kept."""
    starts, ends, first = t.words()
    breaks = np.concatenate([[0], np.cumsum(t.data == 10)])
    line = breaks[starts] + np.repeat(np.arange(t.n), np.diff(first))  # rises with each line and each text
    opens = np.ones(len(line), bool)
    opens[1:] = line[1:] != line[:-1]
    closes = np.ones(len(line), bool)
    closes[:-1] = opens[1:]
    size = ends - starts
    bullet = _has_at(t.data, starts, size, _BULLETS)
    ellipsis = np.zeros(len(line), bool)
    for sign in _ELLIPSES:
        ellipsis |= _has_at(t.data, np.maximum(ends - len(sign), 0), np.where(size >= len(sign), len(sign), 0), (sign,))
    for name, flags in (("n_text_lines", opens), ("n_bullet_lines", opens & bullet), ("n_ellipsis_lines", closes & ellipsis)):
        total = np.concatenate([[0], np.cumsum(flags)])
        t.held[name] = total[first[1:]] - total[first[:-1]]


def _of_lines(name: str) -> Callable[[Texts], np.ndarray]:
    def metric(t: Texts) -> np.ndarray:
        _line_counts(t)
        return t.held[name]

    return metric


_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def _n_letter_words(t: Texts) -> np.ndarray:
    starts, ends, first = t.words()
    letters = np.concatenate([[0], np.cumsum(_LETTER[t.data])])
    total = np.concatenate([[0], np.cumsum(letters[ends] > letters[starts])])
    return total[first[1:]] - total[first[:-1]]


METRICS: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": _n_words,
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_same_neighbours": _n_same_neighbours,
    "n_lines": _n_lines,
    "n_text_lines": _of_lines("n_text_lines"),
    "n_bullet_lines": _of_lines("n_bullet_lines"),
    "n_ellipsis_lines": _of_lines("n_ellipsis_lines"),
    "n_letter_words": _n_letter_words,
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text if `rejects` holds of its metrics (integer arithmetic); `sql` says the same for DuckDB."""

    name: str
    metrics: tuple[str, ...]
    rejects: Callable[..., np.ndarray]
    sql: str
    base: bool = False


RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20, "n_words < 20", True),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n, "100 * n_repeat_words > 30 * n_words", True),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c > 15 * n) | (10 * c < 15 * n), "word_chars > 15 * n_words OR 10 * word_chars < 15 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n, "2 * n_dup_lines > n_lines"),
    Rule("same_neighbours", ("n_words", "n_same_neighbours"), lambda n, s: 10 * s > 3 * n, "10 * n_same_neighbours > 3 * n_words"),
    Rule("bullets", ("n_text_lines", "n_bullet_lines"), lambda n, b: 10 * b > 9 * n, "10 * n_bullet_lines > 9 * n_text_lines"),
    Rule("ellipses", ("n_text_lines", "n_ellipsis_lines"), lambda n, e: 10 * e > 3 * n, "10 * n_ellipsis_lines > 3 * n_text_lines"),
    Rule("letters", ("n_words", "n_letter_words"), lambda n, k: 10 * k < 6 * n, "10 * n_letter_words < 6 * n_words"),
)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in order of rejections per cost on a sample; a metric costs only the first rule that needs it."""

    def measure(batches):
        cost, rejected, n = dict.fromkeys(METRICS, 0.0), {r.name: 0 for r in rules}, 0
        for batch in kernels.parts(batches):
            for _, _, data, offs in kernels.chunks(batch.column(0)):
                t = Texts(data, offs)
                for m in METRICS:
                    began = time.perf_counter()
                    t.get(m)
                    cost[m] += time.perf_counter() - began
                n += t.n
                for r in rules:
                    rejected[r.name] += int(r.rejects(*map(t.get, r.metrics)).sum())
        names, values = zip(*[(f"cost {k}", v) for k, v in cost.items()], *[(f"rejected {k}", v) for k, v in rejected.items()], ("rows", n), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["name", "value"])

    sums = docs.select("text").limit(sample_rows).mapInArrow(measure, "name string, value double").groupBy("name").agg(F.sum("value").alias("value")).collect()
    seen = {r.name: r.value for r in sums}
    share = {r.name: seen.get(f"rejected {r.name}", 0) / max(1, seen.get("rows", 0)) for r in rules}
    order, paid = [], set()
    while len(order) < len(rules):
        rest = [r for r in rules if r.name not in order]
        best = max(rest, key=lambda r: ((share[r.name] + 1e-6) / (1e-9 + sum(seen.get(f"cost {m}", 0) for m in r.metrics if m not in paid)), -rules.index(r)))
        order.append(best.name)
        paid |= set(best.metrics)
    return order


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None, report: bool = False, drop: bool = False) -> DataFrame:
    """The columns of `docs` (which has text), then kept and rejected_by (the first rule of the cascade that rejects, or null).

    With report: doc_id, all reported metrics of every text, base_failed, kept, rejected_by. With drop: only the rows kept, as
    they are.
    """
    order = order or plan_cascade(docs, rules)
    cascade = [next(r for r in rules if r.name == name) for name in order]
    keep = docs.select("doc_id", "text") if report else docs if drop else docs.drop("kept", "rejected_by")
    at = keep.columns.index("text")
    added = [*(StructField(m, LongType()) for m in REPORTED if report), *([StructField("base_failed", BooleanType())] if report else []), StructField("kept", BooleanType()), StructField("rejected_by", StringType())]
    schema = StructType([*(keep.select("doc_id").schema.fields if report else keep.schema.fields), *added])
    names = schema.names
    schema = keep.schema if drop else schema

    def run(batches):
        for batch in kernels.parts(batches):
            parts: dict[str, list] = {f.name: [] for f in added}
            for _, _, data, offs in kernels.chunks(batch.column(at)):
                t = Texts(data, offs)
                by, rows, rest = np.full(t.n, None, object), np.arange(t.n), t
                if report:
                    for m in REPORTED:
                        parts[m].append(t.get(m))
                    parts["base_failed"].append(np.any([r.rejects(*map(t.get, r.metrics)) for r in rules if r.base], axis=0))
                for r in cascade:
                    if not len(rows):
                        break
                    out = r.rejects(*map(rest.get, r.metrics))
                    if out.any():
                        by[rows[out]] = r.name
                        rows = rows[~out]
                        rest = rest.only(~out)
                parts["rejected_by"].append(by)
                parts["kept"].append(np.equal(by, None))
            if drop:
                yield batch.filter(pa.array(np.concatenate(parts["kept"]) if parts["kept"] else [], pa.bool_()))
                continue
            own = [pa.array(np.concatenate(v) if v else [], type=pa.string() if k == "rejected_by" else pa.bool_() if k in ("kept", "base_failed") else pa.int64()) for k, v in parts.items()]
            yield pa.RecordBatch.from_arrays([*([batch.column(0)] if report else batch.columns), *own], names)

    return keep.mapInArrow(run, schema)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns, whatever these are called."""
    return judge(docs, drop=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"), report=True).drop("rejected_by")


ORACLE = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM a),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(string_split(t, chr(10))) AS n_lines, len([i for i in range(2, len(w) + 1) if w[i] = w[i-1]]) AS n_same_neighbours,
  len(l) AS n_text_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪●◦]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS n_letter_words FROM b),
g AS (SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM h WHERE k > 1) GROUP BY doc_id),
m AS (SELECT c.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" OR ".join(r.sql for r in RULES if r.base)}) AS base_failed, NOT ({" OR ".join(f"({r.sql})" for r in RULES)}) AS kept FROM m
"""
