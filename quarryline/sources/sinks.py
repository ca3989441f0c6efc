"""Findings as newline-delimited JSON, as a SARIF 2.1.0 file, and as lines of a table."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quarryline.functions import paths as P
from quarryline.operators import report


def write_ndjson(findings: DataFrame, path: str) -> None:
    """A folder of JSON lines, one object for each finding; null fields are left out."""
    findings.write.json(path)


def check_report_path(findings: DataFrame, path: str) -> None:
    ok = findings.sparkSession.range(1).select(P.report_path_allowed(F.lit(path))).first()[0]
    if not ok or os.path.islink(os.path.normpath(path)):
        raise ValueError(f"no report is written to {path!r}")


class _Written(WriterCommitMessage):
    def __init__(self, part: int, path: str, n: int):
        self.part, self.path, self.n = part, path, n


class _ItemsWriter(DataSourceArrowWriter):
    """Items of a JSON list as text: a file for each task beside the report, joined in the order of the tasks at the commit."""

    def __init__(self, options: dict[str, str]):
        self.path, self.indent = options["path"], int(options["indent"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        path, n = f"{self.path}.{context.partitionId():06d}.{context.taskAttemptId()}", 0
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            for b in iterator:
                for item in b.column("item").to_pylist():
                    text = json.dumps(json.loads(item), indent=2).replace("\n", "\n" + " " * self.indent)
                    f.write(",\n" * (n > 0) + " " * self.indent + text)
                    n += 1
        return _Written(context.partitionId(), path, n)

    def commit(self, messages: list[_Written]) -> None:
        with os.fdopen(os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
            some = False
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
                out.write(",\n" * (some and m.n > 0))
                some = some or m.n > 0
                with open(m.path) as f:
                    shutil.copyfileobj(f, out)
                os.remove(m.path)

    def abort(self, messages: list[_Written]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class ItemsSink(DataSource):
    """Rows of one column ``item``, a JSON object as text, as the items of a list in one file; the folder must be the same for the driver and the executors."""

    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return "item string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ItemsWriter(self.options)


def _write_items(items: DataFrame, order: str, path: str, indent: int) -> None:
    items.sparkSession.dataSource.register(ItemsSink)
    items.orderBy(order).select("item").write.format("json_items").options(path=path, indent=str(indent)).mode("append").save()


def _present(**columns: Column) -> Column:
    """A struct as JSON text; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def write_sarif(findings: DataFrame, path: str, tool: str = "quarryline", version: str = "0.1.0", fingerprint: str = "contentHash/v1") -> None:
    """One log of one run, written whole or not at all.

    The tasks write rules and results as text, in the order of ids and of findings, and the
    driver joins their files, a block at a time, between the log's head and tail. The
    report's folder must be one that driver and executors share.
    """
    check_report_path(findings, path)
    c = F.col
    rule = _present(
        id=c("rule_id"), name=c("rule_name"), shortDescription=F.struct(c("rule_name").alias("text")), fullDescription=F.struct(c("explanation").alias("text")),
        defaultConfiguration=F.struct("level"), properties=F.struct("category", "cwe", "owasp", F.array(F.lit("security"), c("category")).alias("tags")),
    )
    region = F.struct(c("start_line").alias("startLine"), F.when(c("end_line") != 0, c("end_line")).alias("endLine"))
    place = F.struct(F.struct(F.struct(c("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = _present(ruleId=c("rule_id"), level=c("level"), message=F.struct(c("message").alias("text")), locations=F.array(place), partialFingerprints=F.struct(c("fingerprint").alias(fingerprint)))
    marks = ("@rules@", "@results@")
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": [marks[0]]}}, "results": [marks[1]]}
    head = json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)
    drafts = [f"{path}.{os.getpid()}.{x}" for x in ("rules", "results")]
    try:
        _write_items(report.sarif_rules(findings).select("rule_id", rule.alias("item")), "rule_id", drafts[0], 12)
        _write_items(report.sarif_results(findings).select("seq", result.alias("item")), "seq", drafts[1], 8)
        with os.fdopen(os.open(f"{path}.tmp", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
            for mark, draft in zip(marks, drafts, strict=True):
                before, closing, head = re.split(rf'\n *"{mark}"(\n *)', head)
                out.write(before)
                if os.path.getsize(draft):
                    out.write("\n")
                    with open(draft) as f:
                        shutil.copyfileobj(f, out)
                    out.write(closing)
            out.write(head)
        os.replace(f"{path}.tmp", path)
    finally:
        for draft in [*drafts, f"{path}.tmp"]:
            if os.path.exists(draft):
                os.remove(draft)


def summary(findings: DataFrame) -> str:
    """The counts in one line: all findings, then each known severity that occurs."""
    counts = {r["severity"]: r["n"] for r in report.severity_summary(findings).orderBy("severity_rank").collect()}
    total = counts.pop("total")
    return f"{total} total — " + ", ".join(f"{n} {s}" for s, n in counts.items()) if counts else "0 findings"


def table_lines(findings: DataFrame) -> Iterator[str]:
    """The table's lines and the summary, for a terminal; the driver holds one part of the sorted rows at a time."""
    none = True
    for r in report.table_rows(findings).toLocalIterator():
        none = False
        yield f"{r['badge']}  {r['location']}  {r['title']}"
        if r["snippet"]:
            yield f"       ↳ {r['snippet']}"
    if none:
        yield "✓ No security findings."
    else:
        yield ""
        yield summary(findings)
