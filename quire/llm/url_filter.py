"""Operator 2: URL rules in a sorted digest array.

A rule is a host and a path prefix written as one string (`example.org/es/`); it holds for the host and all its subdomains.
The 64-bit xxhash keys of all rules are sorted and stored with the full strings in one file, which Spark ships to every
executor; workers memory-map it, so that all workers of a machine share its pages. A URL is probed with every host suffix
and every prefix length that occurs among the rules, in one vectorised binary search a batch; each hit is confirmed against
the stored string, so that a digest collision cannot decide anything. The longest rule wins.

Scale: one pass over the URLs, no shuffle; only page_id and url are read. Suffixes longer than the longest host among the rules
are not tried, so that a host of very many labels costs no more than one of that length. The store takes 8 + 8 + 1 bytes and the string for
each rule and is bounded by `MAX_RULES`; a longer list is refused rather than cut.

Cases: a null URL, or one without `://`, has an empty host and path and no rule; where no rule fits, the verdict is the
`default` (allow). An empty rule list leaves every URL to the default; an empty table gives no rows; repeated rows stay. Columns other
than page_id and url are neither read nor returned.
"""

from __future__ import annotations

import atexit
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, kernels

MAX_RULES = 50_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.translate(F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


class RuleStore:
    """A file of sorted digests, offsets, verdicts and strings; opened by memory map."""

    def __init__(self, path: str):
        head = np.memmap(path, np.uint64, "r", shape=(3,))
        n, shapes, self.longest = (int(x) for x in head)
        at = 24
        self.shapes = np.memmap(path, np.uint64, "r", at, (shapes,)) if shapes else np.zeros(0, np.uint64)
        at += 8 * shapes
        self.keys = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.zeros(0, np.uint64)
        at += 8 * n
        self.offsets = np.memmap(path, np.uint64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        self.blocked = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.zeros(0, np.uint8)
        at += n
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(rules: dict[str, str], path: str) -> None:
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; the store holds {MAX_RULES}")
        raw = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v == "block") for k, v in rules.items())
        shapes = sorted({len(k.partition("/")[2]) + 1 for k in rules})
        longest = max((len(k.partition("/")[0]) for k in rules), default=0)
        with open(path, "wb") as f:
            for part in ([len(raw), len(shapes), longest], shapes, [x[0] for x in raw], np.concatenate([[0], np.cumsum([len(x[1]) for x in raw])])):
                f.write(np.array(part, np.uint64).tobytes())
            f.write(np.array([x[2] for x in raw], np.uint8).tobytes())
            f.write(b"".join(x[1] for x in raw))

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate its rule's index, or -1."""
        digests = np.fromiter((xxhash.xxh64_intdigest(c) for c in candidates), np.uint64, len(candidates))
        out = np.full(len(candidates), -1)
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # several strings may share a digest
                if self.text(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def text(self, k: int) -> bytes:
        return self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()


def candidates(host: str, path: str, shapes: list[int], longest: int) -> list[bytes]:
    """Host suffixes of at most `longest` characters x prefix lengths, longest rule string first."""
    if not host or not path.startswith("/"):
        return []
    end = host[max(0, len(host) - longest - 1) :]
    suffixes = [end[i + 1 :] for i, c in enumerate(end) if c == "."] + ([host] if len(host) <= longest else [])
    out = [s + path[:n] for s in suffixes for n in shapes if n <= len(path)]
    return [c.encode() for c in sorted(out, key=len, reverse=True)]


def filter_urls(pages: DataFrame, rules: dict[str, str], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (or null), verdict for each row of `pages` (page_id, url)."""
    sc = pages.sparkSession.sparkContext
    fd, path = tempfile.mkstemp(prefix="url-rules-", suffix=".bin")
    os.close(fd)
    RuleStore.write(rules, path)
    sc.addFile(path)
    atexit.register(os.unlink, path)  # executors may fetch it as long as the driver lives
    name = os.path.basename(path)

    def judge(batches):
        store = RuleStore(SparkFiles.get(name))
        shapes = [int(x) for x in store.shapes]
        for batch in kernels.parts(batches):
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            of = [candidates(h, p, shapes, store.longest) for h, p in zip(hosts, paths, strict=True)]
            found = store.find([c for x in of for c in x])
            rule, verdict, at = [], [], 0
            for x in of:
                hits = [k for k in found[at : at + len(x)].tolist() if k >= 0]
                at += len(x)
                rule.append(store.text(hits[0]).decode() if hits else None)
                verdict.append(("block" if store.blocked[hits[0]] else "allow") if hits else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    url = F.col("url")
    return pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.read(spark, sf_dir, "pages"), RULES)


def _case(value) -> str:
    """The rules in order of length, longest first, as the branches of a CASE."""
    out = []
    for rule, verdict in sorted(RULES.items(), key=lambda x: (-len(x[0]), x[0])):
        host, _, rest = rule.partition("/")
        out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{value(rule, verdict)}'")
    return " ".join(out)


ORACLE = rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {_case(lambda r, v: r)} END AS rule, CASE {_case(lambda r, v: v)} ELSE 'allow' END AS verdict FROM h
"""
