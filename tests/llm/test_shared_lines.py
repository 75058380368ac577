"""Line deduplication, filter audit and fill-in-middle against brute force, with nulls, long texts, ties, repeated rows, empty tables."""

import hashlib
import random
from collections import defaultdict
from itertools import permutations

import pytest

from quire.llm import fill_middle, filter_audit, line_dedup

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="session")
def docs():
    rng = random.Random(11)
    shared = [f"{'ÄbC' if k % 3 else 'Abc'} shared line number {k} that is well over forty characters long" for k in range(30)]
    near = ["x" * 39, "y" * 40, "é" * 40, "Z" * 40]
    rows = [(None, shared[0] + "\n" + shared[0], "a"), (None, None, None), (5, "", None), (6, None, "b"), (7, "\n\n", ""), (8, shared[1], "b"), (8, shared[1], "b"), (9, ("long " * 30 + "\n") * 400 + shared[2], "c")]
    for i in range(10, 70):
        lines = [rng.choice([*shared, *near, "short", "", f"own line of document {i} which is as long as it needs to be"]) for _ in range(rng.randrange(120))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r", " \x0b"]) for x in lines]
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(70 + k, "Some words that are A COPY of each other " * 3, "a") for k in range(4)] + [(71, "Some words that are A COPY of each other " * 3, "b"), (72, "Some words that are A COPY of each other " * 3, "a")]
    return rows


def dedup(rows, min_chars=40, min_docs=5):
    keys = [[lower(x.strip(SPACE)) for x in (t or "").split("\n")] for _, t, _ in rows]
    holders = defaultdict(set)
    for (d, _, _), own in zip(rows, keys, strict=True):
        for k in own:
            if len(k) >= min_chars:
                holders[k].add(-1 if d is None else d)
    out = []
    for (d, t, _), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, own, strict=True) if not (len(k) >= min_chars and len(holders[k]) >= min_docs and max(holders[k]) != (-1 if d is None else d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("share", [1, 50, 10**9])  # no key is hot, some are, all are
def test_lines_brute_force(spark, docs, share):
    table = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS pos", "'x' AS h1", "2 AS n_dropped", "3 AS keep", "'y' AS text_hash")
    got = line_dedup.apply(table, line_dedup.keep_bitmaps(table, hot_share=share)).collect()
    want = dedup(docs)
    assert sum(x[2] for x in want) > 1000
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got), key=key) == sorted(want, key=key)


def test_bitmaps_are_compressed(spark):
    line = "a line of more than forty characters that all documents hold"
    rows = [(i, "\n".join([line] * (i == 1) + [f"{k}" for k in range(100_000)] + [line] * (i > 1)), None) for i in range(1, 6)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in maps) == [1, 2, 3, 4] and all(len(r.keep) == 1 and r.n_dropped == 1 for r in maps)
    assert {r.doc_id: r.keep[0].gap for r in maps} == {1: 0, 2: 3125, 3: 3125, 4: 3125}
    got = line_dedup.apply(spark.createDataFrame(rows, DOCS), line_dedup.keep_bitmaps(spark.createDataFrame(rows, DOCS))).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(d, t) for d, _, _, t in dedup(rows)}


def test_lines_plan_has_one_exchange_for_the_ranges(spark, docs):
    lines = spark.createDataFrame(docs, DOCS).transform(line_dedup.long_lines)
    plan = line_dedup._of_ranges(lines, line_dedup.hot_keys(lines, 1), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(h1" not in plan.split("rangepartitioning")[0] and "Python" not in plan


def audit(rows, labels):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    import re

    per = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and t in first and d > first[t],
        }
        per[s or ""].append(({k for k, v in fails.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out = {}
    for part, ds in per.items():
        total = defaultdict(int)
        for p in permutations("ABCDE"):
            for i, f in enumerate(p):
                before = set(p[:i])
                gone = [x for x in ds if f in x[0] and not x[0] & before]
                total[f] += len(gone)
                out[part, "".join(p), i + 1] = [
                    sum(not x[0] & {*before, f} for x in ds), len(gone), sum(f in x[0] and bool(x[0] & before) for x in ds), sum(x[0] == {f} for x in ds), sum(x[1] for x in gone), sum(x[2] for x in gone), f,
                ]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = total[v[-1]]
    return out


def test_audit_brute_force(spark, docs):
    rows = [*docs, *((100 + i, t, "d") for i, t in enumerate(["", None, "A B C D", "50% " * 60, "w " * 60, " ".join(f"word{k}" for k in range(60)), "#" + " ".join(f"Word{k}" for k in range(60))] * 3))]
    labels = [(5, 1, 0), (5, 0, 1), (8, None, 1), (None, 1, 1), (70, 1, None), (71, 1, 1), (99, 1, 1), *((i, i % 2, i % 3 == 0) for i in range(10, 120, 4) if i not in (70, 71))]
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS mask", "2 AS part", "true AS good", "'x' AS digest")
    got = filter_audit.audit(table, spark.createDataFrame([(d, q, int(x) if x is not None else None) for d, q, x in labels], "doc_id long, quality int, toxic int")).collect()
    want = audit(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(filter_audit.edges()) == 80 and len(filter_audit.steps()) == 600


def test_units_at_checkpoints():
    text = "aé漢😀́" * 700 + "z"
    raw = text.encode()
    for every in (1, 2, 3, 7, 64, 10**6):
        units = fill_middle.Units(raw, every)
        assert units.n == len(text)
        for u in [*range(0, len(text) + 1, 97), 0, 1, len(text) - 1, len(text)]:
            assert units.offset(u) == len(text[:u].encode())
    assert fill_middle.Units(b"").n == 0 and fill_middle.Units(b"").offset(0) == 0


def test_middle_brute_force(spark, docs):
    rows = [*docs, *((200 + i, t, "") for i, t in enumerate(["é" * 100_000, "a<P>b", "<S>", "x<M", "<M>" * 4, "a", "漢字", "<P", "P>"] * 12))]
    table = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS form", "2 AS output", "'k' AS key")
    got = fill_middle.transform(table).collect()
    assert got[0].__fields__ == ["doc_id", "text", "source", "key", "n", "form", "prefix_chars", "middle_chars", "output"] and len(got) == len(rows)
    forms = set()
    for r in got:
        t = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        form = "plain" if t == "" or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        forms.add(form)
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r.n, r.form, r.output) == (len(t), form, want)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (a, b - a))
        assert fill_middle.restore(r.output.encode(), r.form).decode() == t
    assert forms == {"plain", "psm", "spm"}
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.transform(table, digests=True).collect()}
    assert digests == {(r.doc_id, hashlib.sha256(r.output.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert line_dedup.apply(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    assert fill_middle.transform(none).count() == fill_middle.transform(none, digests=True).count() == 0
