"""Decodes section markup: a row for each text and element that a reading takes, and for the root, with what encloses it.

A section is gone through once, tag by tag, with a stack of what is open; its rows are handed on when it has ended. One that is
no well-formed markup gives a single row with a reason.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows after which a batch is handed on, and tags whose parts are remembered.
BATCH_ROWS, KNOWN_TAGS = 20_000, 50_000
TOKEN = re.compile(r"""(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++""")
_NAME = re.compile(r"</?(?:[^\s<>/:]+:)?([^\s<>/:]+)", re.ASCII)
_WHOLE = re.compile(r"</?([^\s<>/]+)", re.ASCII)
_SAID = re.compile(r"\S", re.ASCII)
_BAD_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)")
_BAD_NUMBER = re.compile(r"""\s(?:rowAddr|colAddr|rowSpan|colSpan)\s*=\s*["'](?!\s*[+-]?\d+\s*["'])""", re.ASCII)
_TEXT_TAGS, _BREAKS, _FACTS = ("t", "text"), ("lineBreak", "br", "tab"), {"cellAddr": "addr", "cellSpan": "span", "cellSz": "size"}
_INTS = pa.list_(pa.int32())
COLUMNS = {
    "at": pa.int32(), "kind": pa.string(), "name": pa.string(), "token": pa.string(), "first": pa.string(), "n_t": pa.int32(), "up_p": _INTS, "up_tbl": _INTS, "up_tc": _INTS, "direct": pa.bool_(),
    "row": pa.int32(), "run": pa.string(), "has_table": pa.bool_(), "opened": pa.bool_(), "addr": pa.string(), "span": pa.string(), "size": pa.string(), "reason": pa.string(),
}
SCHEMA = "at int, kind string, name string, token string, first string, n_t int, up_p array<int>, up_tbl array<int>, up_tc array<int>, direct boolean, row int, run string, has_table boolean, opened boolean, addr string, span string, size string, reason string"


def _parts(tag: str) -> tuple:
    """kind, name without and with prefix of a tag, whether it has an unknown entity or a bad number."""
    kind = "skip" if tag[1] in "!?" else "close" if tag[1] == "/" else "empty" if tag.endswith("/>") else "open"
    name, whole = (m[1] if (m := p.match(tag)) else "" for p in (_NAME, _WHOLE))
    return kind, name, whole, kind != "skip" and _BAD_ENTITY.search(tag) is not None, name in ("cellAddr", "cellSpan") and _BAD_NUMBER.search(tag) is not None


def _row(at: int, kind: str, name: str, token: str | None, first: str | None, n_t: int, up: dict) -> dict:
    return {"at": at, "kind": kind, "name": name, "token": token, "first": first, "n_t": n_t, "up_p": up["p"], "up_tbl": up["tbl"], "up_tc": up["tc"]}


def _section(xml: str | None, known: dict) -> list[dict]:
    """The rows of a section, or one with the reason why it can't be read."""
    rows, stack, up, held = [], [], {"p": [], "tbl": [], "tc": []}, {"p": [], "tbl": []}
    n_t = roots = read = at = 0
    depth = lowest = 0
    before, torn, loose, entity, number = None, False, False, False, False
    for at, m in enumerate(TOKEN.finditer(xml or "")):
        token = m[0]
        read += len(token)
        cdata = token.startswith("<![CDATA[")
        if cdata or token[0] != "<":
            loose = loose or depth == 0 and _SAID.search(token) is not None
            entity = entity or not cdata and "&" in token and _BAD_ENTITY.search(token) is not None
            if n_t or up["tc"] or before in _TEXT_TAGS:
                rows.append(_row(at, "cdata" if cdata else "text", "", token, before if before in _TEXT_TAGS else None, n_t, up))
            continue
        if (parts := known.get(token)) is None:
            if len(known) >= KNOWN_TAGS:
                known.clear()
            parts = known[token] = _parts(token)
        kind, name, whole, bad_entity, bad_number = parts
        if kind == "skip":
            continue
        entity, number = entity or bad_entity, number or bad_number
        if kind == "close":
            depth -= 1
            lowest = min(lowest, depth)
            before = None
            if stack:
                opened = stack.pop()
                torn = torn or opened[0] != whole
                if opened[1] in up:
                    up = up | {opened[1]: up[opened[1]][:-1]}
                n_t -= opened[1] == "t"
                if opened[1] in held:
                    held[opened[1]].pop()
            if name == "p" and up["tc"]:
                rows.append(_row(at, kind, name, None, None, n_t, up))
            continue
        roots += depth == 0
        made, parent = None, stack[-1] if stack else ("", "", None)
        if name in up or name in _BREAKS or name in ("tr", "img") or not depth:
            made = _row(at, kind, name, token if name in ("p", "img") else None, None, n_t, up)
            if name == "p":
                made |= {"run": None, "has_table": False, "_in": held["p"][-1] if held["p"] else None}
            elif name == "tbl":
                made["row"] = 0
                for p in reversed(held["p"]):
                    if p["has_table"]:
                        break
                    p["has_table"] = True
            elif name == "tr":
                made["direct"] = parent[1] == "tbl"
                if made["direct"]:
                    made["row"] = parent[2]["row"]
                    parent[2]["row"] += 1
            elif name == "tc":
                made |= {"row": held["tbl"][-1]["row"] - 1 if held["tbl"] else -1, "direct": parent[1] == "tr" and len(stack) > 1 and stack[-2][1] == "tbl"}
            rows.append(made)
        elif name == "run":
            for p in reversed(held["p"]):
                if p["run"] is not None:
                    break
                p["run"] = token
        elif parent[1] == "tc" and name in _FACTS:
            parent[2].setdefault(_FACTS[name], token)
        elif parent[1] == "tbl" and name == "sz":
            parent[2].setdefault("size", token)
        before = name if kind == "open" else None
        if kind == "open":
            depth += 1
            stack.append((whole, name, made))
            if name in up:
                up = up | {name: [*up[name], at]}
            n_t += name == "t"
            if name in held:
                held[name].append(made)
    reason = (
        "no element" if not roots else "stray sign" if read != len(xml) else "tags don't match" if lowest < 0 or torn or stack else "more than one root" if roots > 1
        else "text outside the root" if loose else "unknown entity" if entity else "bad number" if number else None
    )
    if reason:
        return [{"at": 0, "reason": reason}]
    for row in rows:
        if (outer := row.pop("_in", None)) is not None:
            row["opened"] = outer["has_table"]
    return rows


def decode_sections(sections: DataFrame, key: list[str]) -> DataFrame:
    """The columns of `key`, then those of SCHEMA, of `sections` (key, xml)."""
    sections = sections.select(*key, "xml")
    schema = StructType([*sections.select(*key).schema.fields, *StructType.fromDDL(SCHEMA).fields])

    def made(batch, source, rows):
        own = [pc.take(batch.column(i), pa.array(source, pa.int32())) for i in range(len(key))]
        return pa.RecordBatch.from_arrays([*own, *(pa.array([r.get(c) for r in rows], t) for c, t in COLUMNS.items())], [*key, *COLUMNS])

    def run(batches):
        known = {}
        for batch in batches:
            source, rows = [], []
            for i, xml in enumerate(batch.column(len(key))):
                own = _section(xml.as_py(), known)
                rows += own
                source += [i] * len(own)
                if len(rows) >= BATCH_ROWS:
                    yield made(batch, source, rows)
                    source, rows = [], []
            if rows:
                yield made(batch, source, rows)

    return sections.mapInArrow(run, schema)
