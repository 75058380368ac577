"""Levels by brute force, trees of records, file headers, files that are refused, jobs with an exit status."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quire import config, jobs
from quire.operators import intake, levels
from quire.operators import streams as S

RECORDS = "file string, stream string, ord int, tag int, level int, data binary"


@pytest.fixture(scope="module")
def records():
    rng = random.Random(12)
    return [(f"f{f}", s, i, rng.choice([50, 51, 54, 69]), rng.randrange(5), rng.choice([None, b"", b"secd\x01", b"x" * 99])) for f in range(12) for s in ("DocInfo", "BodyText/Section0") for i in range(rng.randrange(40))]


def test_enclosing_rows(spark, records):
    rows = [(f, s, i, None if i % 17 == 16 else v) for f, s, i, _, v, _ in records]
    table = spark.createDataFrame(rows, "file string, stream string, ord int, level int").withColumn("m", F.col("ord") % 3 == 0)
    got = {(r.file, r.stream, r.ord): (r.above, r.shallower) for r in levels.enclosed(table, ["file", "stream"], "ord", marked="m").collect()}
    streams = {}
    for f, s, i, v in rows:
        before = streams.setdefault((f, s), [])
        smaller = [j for j, w in before if v is not None and w is not None and w < v]
        assert got[f, s, i] == (max(smaller, default=None), sum(j % 3 == 0 for j in smaller))
        before.append((i, v))
    assert len(got) == len(rows) and levels.enclosed(table.limit(0), ["file", "stream"], "ord").count() == 0


def test_trees_nest_like_a_stack(spark, records):
    got = {(r.file, r.stream): json.loads(r.tree) for r in S.trees(spark.createDataFrame(records, RECORDS), with_data=True).collect()}
    want = {}
    for f, s, _, tag, level, data in records:
        roots = want.setdefault((f, s), ([], []))
        stack, top = roots[1], roots[0]
        del stack[level:]  # past a gap in levels a record goes to the next free place
        node = {"tag": tag, "level": level, "size": len(data) if data is not None else None, "ctrl": "secd" if tag == 54 and data and len(data) >= 4 and data[:4] == b"secd" else "xxxx" if tag == 54 and data and len(data) >= 4 else None, "hex": data[:64].hex() if data else None, "children": []}
        (stack[-1][1]["children"] if stack else top).append(node)
        stack.append((level, node))
    plain = lambda ns: [{"tag": n["tag"], "level": n["level"], "size": n.get("size"), "ctrl": n.get("ctrl_id"), "hex": n.get("data_hex"), "children": plain(n.get("children", []))} for n in ns]
    assert {k: plain(v) for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def header(version=(0, 0, 0, 5), sign=config.FILE_SIGNATURE, flags=0, cut=None):
    return (sign.encode().ljust(32, b"\0") + bytes(version) + flags.to_bytes(4, "little"))[:cut]


def test_headers_and_failures(spark):
    heads = {"ok": header(), "old": header((1, 2, 3, 4)), "cut": header(cut=33), "other": header(sign="PK"), "empty": b"", "null": None}
    headers = spark.createDataFrame([*heads.items()], "file string, data binary")
    files = spark.createDataFrame([(f,) for f in [*heads, "none", "shut"]], "file string")
    failures = spark.createDataFrame([("shut", "locked"), ("gone", "no such file")], "file string, reason string")
    got = {(r.file, r.stream, r.rule, r.severity, r.detail) for r in S.header_rules(files, headers, failures).collect()}
    assert got == {
        ("old", "FileHeader", "R-002", "HIGH", "4.3.2.1"), ("cut", "FileHeader", "R-002", "HIGH", "0.0.0.0"), ("other", "FileHeader", "R-001", "CRITICAL", "absent"), ("empty", "FileHeader", "R-001", "CRITICAL", "absent"),
        ("null", "FileHeader", "R-001", "CRITICAL", "missing"), ("none", "FileHeader", "R-001", "CRITICAL", "missing"), ("shut", "<open>", "R-000", "CRITICAL", "locked"), ("gone", "<open>", "R-000", "CRITICAL", "no such file"),
    }
    flags = spark.createDataFrame([(header(flags=0b100000000101),), (header(cut=39),)], "d binary").select(S.file_flags(F.col("d")).alias("f")).collect()
    assert {k for k, v in flags[0].f.items() if v} == {"compressed", "distributed", "track_changes"} and flags[1].f == {}


def test_jobs_have_a_status(spark, tmp_path):
    good = [("a", "DocInfo", 0, 0x10, 0, b"p"), ("a", "DocInfo", 1, 0x11, 0, b"\0" * 32), ("a", "DocInfo", 2, 0x1E, 0, b""), ("a", "BodyText/Section0", 0, 50, 0, b"p"), ("a", "BodyText/Section0", 1, 51, 1, b"t"), ("a", "BodyText/Section1", 0, 50, 0, b"p")]

    def saved(name, rows):
        table = spark.createDataFrame(rows, RECORDS)
        table.write.parquet(f"{tmp_path}/{name}-records")
        table.select("file", "stream").distinct().write.parquet(f"{tmp_path}/{name}-streams")
        return [f"{tmp_path}/{name}-streams", f"{tmp_path}/{name}-records"]

    fine, bad = saved("good", good), saved("bad", [*good[:-1], ("a", "BodyText/Section1", 0, 54, 0, b"zzzz")])
    spark.createDataFrame([("b", "locked")], "file string, reason string").write.parquet(f"{tmp_path}/failures")
    spark.createDataFrame([("a", header())], "file string, data binary").write.parquet(f"{tmp_path}/headers")
    assert jobs.main(["check", *fine, "--headers", f"{tmp_path}/headers", "--out", f"{tmp_path}/out"], spark) == 0
    assert [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/out/report").collect()] == [{"file": "a", "n_critical": 0, "n_high": 0, "n_medium": 0, "n_low": 0, "passed": True, "status": "PASS"}]
    assert jobs.main(["check", *bad], spark) == 1 and jobs.main(["check", *bad, "--max-sections", "1"], spark) == 0
    assert jobs.main(["check", *fine, "--headers", f"{tmp_path}/headers", "--failures", f"{tmp_path}/failures"], spark) == 1
    assert jobs.main(["verify", *fine], spark) == 0 and jobs.main(["verify", *bad, "--feature", "controls"], spark) == 1 and jobs.main(["verify", *bad, "--feature", "structure"], spark) == 0
    assert jobs.main(["verify", *fine, "--failures", f"{tmp_path}/failures"], spark) == 1
    assert jobs.main(["diff", *fine, *fine], spark) == 0 and jobs.main(["diff", *fine, *bad], spark) == 1 and jobs.main(["diff", *fine, *bad, "--max-sections", "1"], spark) == 0
    assert jobs.main(["no"], spark) == 2
    spark.createDataFrame([(1, 0, "<a><p><t>x</t></p></a>"), (1, 1, "<a><p><t>y</t></p></a>")], "doc_id long, section_index int, xml string").write.parquet(f"{tmp_path}/sections")
    spark.createDataFrame([(2, 0, "<a>")], "doc_id long, section_index int, xml string").write.parquet(f"{tmp_path}/broken")
    assert jobs.main(["read", f"{tmp_path}/sections", "--out", f"{tmp_path}/read"], spark) == 0 and jobs.main(["read", f"{tmp_path}/broken"], spark) == 1
    assert [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/read/text").collect()] == [{"doc_id": 1, "plain": "x\ny"}]


def test_refused_files_are_rows(spark):
    korean = "가나다".encode("cp949")
    files = [("a.md", b"x\r\n\r\n\r\n\r\ny"), ("b.txt", korean), ("c.docx", b"PK\x03\x04"), ("c.docx", b"no"), ("d", b"x"), ("", b"x"), (None, b"x"), ("e.md", None), ("f.pdf", b"%PDF-1"), ("dir/G.MD", b""), ("h.hwp", b"")]
    seen = Observation()
    rows = intake.judged(spark.createDataFrame(files, "path string, content binary"), {"pdf": lambda c: F.when(F.length(c) > 99, "never")}, seen)
    got = {(r.path, r.format, r.text, r.stage, r.reason) for r in rows.collect()}
    assert got == {
        ("a.md", "md", "x\n\ny", None, None), ("b.txt", "txt", "가나다", None, None), ("c.docx", "docx", None, "read", "no reader of docx"), ("c.docx", "docx", None, "read", "not a docx"), ("d", None, None, "upload", "unknown format: d"), ("", None, None, "upload", "no name"),
        (None, None, None, "upload", "no name"), ("e.md", "md", None, "read", "no content"), ("f.pdf", "pdf", None, "parse", "the reader gave no text"), ("dir/G.MD", "md", "", None, None), ("h.hwp", "hwp", None, "read", "not a hwp"),
    }
    assert seen.get == {"n_files": 11, "n_refused": 8}
    assert intake.accepted(rows).count() == 3 and intake.refused(rows).count() == 8
