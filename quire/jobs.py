"""Jobs with an exit status, for schedulers: `spark-submit quire/jobs.py check|verify|diff|read ...`.

Inputs are Parquet tables that Spark reads: streams (file, stream), records (file, stream, ord, tag, level, data), and perhaps
headers (file, data) and failures (file, reason); for read, sections (doc_id, section_index, xml). Results are written as JSON
lines, findings and a report for each file. The status is 0 if every file passes (for diff: has no difference; for read: each
section can be read), 1 if not, 2 for a bad call.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quire.operators import markup as M
from quire.operators import streams as S
from quire.sources.sinks import write_json


def _finish(findings: DataFrame, report: DataFrame, out: str | None, passed: str) -> int:
    if out:
        write_json(findings, f"{out}/findings")
        write_json(report, f"{out}/report")
    return int(report.filter(f"NOT ({passed})").limit(1).count())


def check(streams: DataFrame, records: DataFrame, out: str | None = None, max_sections: int = 0, headers: DataFrame | None = None, failures: DataFrame | None = None) -> int:
    """Contract findings of all files; status 1 if one has a critical or high one."""
    found = S.contract(streams, records, max_sections, headers, failures)
    return _finish(found, S.report(S.all_files(streams, failures), found), out, "passed")


def verify(streams: DataFrame, records: DataFrame, out: str | None = None, features: tuple[str, ...] = S.CHECKS, failures: DataFrame | None = None) -> int:
    """Feature checks of all files; status 1 if one has an error."""
    found = S.verify(streams, records, features, failures)
    return _finish(found, S.report(S.all_files(streams, failures), found, ("ERROR", "WARN", "INFO")), out, "passed")


def diff(reference: tuple[DataFrame, DataFrame], candidate: tuple[DataFrame, DataFrame], out: str | None = None, max_sections: int = 0, failures: DataFrame | None = None) -> int:
    """Differences between two versions of all files; status 1 if there is one."""
    found = S.compare(reference, candidate, max_sections, failures)
    files = S.all_files(reference[0].select("file").union(candidate[0].select("file")), failures)
    return _finish(found, S.diff_report(files, found), out, "status = 'IDENTICAL'")


def read(sections: DataFrame, out: str | None = None) -> int:
    """Blocks and text of section markup, and errors, as JSON lines; status 1 if a section can't be read."""
    rows, errors = M.read(sections)
    if out:
        found = M.reader_blocks(rows)
        write_json(found, f"{out}/blocks")
        write_json(M.reader_text(found), f"{out}/text")
        write_json(errors, f"{out}/errors")
    return int(errors.limit(1).count())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("check", "verify", "diff"):
        p = jobs.add_parser(name)
        p.add_argument("streams"), p.add_argument("records")
        if name == "diff":
            p.add_argument("other_streams"), p.add_argument("other_records")
        if name != "verify":
            p.add_argument("--max-sections", type=int, default=0)
        else:
            p.add_argument("--feature", action="append", choices=S.CHECKS)
        p.add_argument("--headers") if name == "check" else None
        p.add_argument("--failures"), p.add_argument("--out")
    p = jobs.add_parser("read")
    p.add_argument("sections"), p.add_argument("--out")
    try:
        a = parser.parse_args(args)
    except SystemExit as e:
        return 0 if not e.code else 2
    spark = spark or SparkSession.builder.getOrCreate()
    table = lambda path: spark.read.parquet(path) if path else None
    if a.job == "read":
        return read(table(a.sections), a.out)
    if a.job == "check":
        return check(table(a.streams), table(a.records), a.out, a.max_sections, table(a.headers), table(a.failures))
    if a.job == "verify":
        return verify(table(a.streams), table(a.records), a.out, tuple(a.feature or S.CHECKS), table(a.failures))
    return diff((table(a.streams), table(a.records)), (table(a.other_streams), table(a.other_records)), a.out, a.max_sections, table(a.failures))


if __name__ == "__main__":
    sys.exit(main())
