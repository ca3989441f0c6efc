"""The pinned cases of paths, addresses, thresholds and cuts."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quarryline.functions import findings as N
from quarryline.functions import paths as P
from quarryline.functions import text as X
from quarryline.operators import patches, report
from quarryline.plans import fixtures


def values(spark, rows, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").orderBy("i").select(expression(F.col("v"))).collect()]


def test_repository_paths(spark):
    """A path is refused where it is rooted, has a drive or a backslash, or climbs above its start at any point."""
    paths = [r[0] for r in fixtures.FIXTURES["paths"][1]]

    def climbs(path):
        depth = 0
        for part in path.split("/"):
            depth += 0 if part in ("", ".") else -1 if part == ".." else 1
            if depth < 0:
                return True
        return False

    bad = [p == "" or p[0] == "/" or p[1:2] == ":" or "\\" in p or climbs(p) for p in paths]
    assert [p is not None for p in values(spark, paths, P.path_problem)] == bad
    assert 10 < sum(bad) < len(bad) - 10


def test_report_paths(spark):
    paths = [r[0] for r in fixtures.FIXTURES["report_paths"][1]]
    clean = [os.path.normpath(p).replace("//", "/") if p.startswith("/") else p for p in paths]
    assert values(spark, paths, P.report_path_allowed) == [p != "" and not c.startswith(P.SYSTEM_PREFIXES) for p, c in zip(paths, clean, strict=True)]


def test_urls(spark):
    ok = ["https://x.example", "https://x.example:8443/a", "http://localhost:3000", "http://127.0.0.1", "http://[::1]:8080", "https://my_host.example/x", " https://a.example\n", "https://", "https:x", "HTTPS://A/?%"]
    bad = ["http://x.example", "http://10.0.0.1:80", "file:///x", "ftp://x", "javascript:f()", "data:a", "", "https://a:b", "https://a/%2", "https://a b", "https://[::1", "http://LOCALHOST", "http:localhost", "https://a\tb", "x"]
    assert values(spark, ok, P.url_allowed) == [True] * len(ok)
    assert values(spark, bad, P.url_allowed) == [False] * len(bad)


def test_white_space_goes_at_the_ends(spark):
    assert values(spark, ["\t a\u00a0b \r\n", "\u2003\u3000", "", "a"], X.trimmed) == ["a\u00a0b", "", "", "a"]
    assert values(spark, ["\thttps://h/o/r.git\n", "git@h/o/r", "git@h:o/r.git"], P.origin_base) == ["o/r"] * 3
    keys = values(spark, ["https://h/o", "\r\nhttps://h/o\t"], lambda c: P.project_key(c, F.lit("/r")))
    assert keys[0] == keys[1]


@pytest.mark.parametrize(("threshold", "n"), [("high", 2), ("critical", 1), ("medium", 3), ("low", 4), ("any", 4)])
def test_thresholds(spark, threshold, n):
    found = spark.createDataFrame([(s,) for s in N.SEVERITIES], "severity string")
    assert report.at_or_above(found, threshold).first()["n"] == n
    assert report.at_or_above(found.limit(0), threshold).first()["n"] == 0


def test_unknown_threshold_is_refused_by_the_gate(spark):
    with pytest.raises(ValueError):
        report.gate(spark.createDataFrame([], "severity string"), "bogus")


def test_summary_counts_unknown_severities_in_the_total_only(spark):
    rows = report.severity_summary(spark.createDataFrame([("odd",), ("high",)], "severity string")).collect()
    assert {r["severity"]: r["n"] for r in rows} == {"high": 1, "total": 2}


def test_cuts_count_bytes(spark):
    assert values(spark, ["abcd", "abcde", "ééé"], lambda c: X.snippet(c, 4)) == ["abcd", "abcd…", "éé…"]
    assert values(spark, ["abcd", "abcde"], lambda c: X.cell(c, 4)) == ["abcd", "abc…"]
    assert values(spark, ["abc"], lambda c: X.cell(c, 1)) == ["a"]
    assert values(spark, ["abc"], lambda c: X.cell(c, 0)) == [""]


def test_ages(spark):
    now = datetime.datetime(2024, 1, 31)
    steps = {59: "just now", 60: "1m ago", 59 * 60: "59m ago", 3600: "1h ago", 23 * 3600: "23h ago", 86_400: "1d ago", 29 * 86_400: "29d ago", 30 * 86_400: "2024-01-01", -5: "just now"}
    rows = [(i, now - datetime.timedelta(seconds=s)) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "i int, t timestamp_ntz").orderBy("i")
    assert [r[0] for r in df.select(X.relative_age(F.col("t"), F.lit(now).cast("timestamp_ntz"))).collect()] == list(steps.values())
    assert values(spark, ["soon"], lambda c: X.relative_age_of_text(c, F.lit(now).cast("timestamp_ntz"))) == ["soon"]
    texts = {
        "2023-01-01T23:30:00-05:00": "2023-01-01", "2023": "2023", "2023-01-01 10:00:00": "2023-01-01 10:00:00", "2024-01-30T23:59:00Z": "1m ago", "2024-01-31T01:00:00+02:00": "1h ago", "2024-01-30T22:00:00.123456789Z": "1h ago",
        "2024-01-30T22:00:00,5Z": "1h ago", "2023-02-30T00:00:00Z": "2023-02-30T00:00:00Z", "2024-01-30T22:00:00": "2024-01-30T22:00:00", "2024-01-30t22:00:00Z": "2024-01-30t22:00:00Z", "2025-01-01T00:00:00Z": "just now", "": "",
    }
    assert values(spark, list(texts), lambda c: X.relative_age_of_text(c, F.lit(now).cast("timestamp_ntz"))) == list(texts.values())


def test_indent(spark):
    assert values(spark, ["", "a", "a\nb\n\n"], lambda c: X.indent(c, "> ")) == ["", "> a", "> a\n> b"]


def test_patches(spark):
    rows = patches.patch_files(fixtures.table(spark, "patches")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["first_pos"]):
        by.setdefault(r["patch_id"], []).append((r["path"], r["unsafe"]))
    assert by["pair"] == [("docs/intro.md", False), ("lib/alpha.rs", False)]
    assert by["tab"] == [("web/menu.ts", False)]
    assert by["twice"] == [("one.py", False)]
    assert by["climb"][0][1]
    assert "removed" not in by
    assert len(by["quirk"]) == 2
    assert by["crlf"] == [("x.go", False)] and by["stamped"] == [("dir/y.py", False)]
    said = {r["patch_id"]: r["verdict"] for r in patches.verdicts(fixtures.table(spark, "patches")).collect()}
    assert said["removed"] == said["words"] == "touches no files" and said["climb"] == "unsafe path" and said["crlf"] == "ok"
    assert {k for k, v in said.items() if v == "empty"} == {"blank", "empty", "spaces"}
    assert {r["patch_id"] for r in patches.usable(fixtures.table(spark, "patches")).collect()} == {k for k, v in said.items() if v != "empty"}


def test_latest_backup(spark):
    names = fixtures.table(spark, "backups")
    assert patches.latest_backup(names, ".backup-").first()["name"] == ".backup-20240301T120000Z"
    assert patches.latest_backup(names, ".backup-", "20240101T000000Z").first()["name"] == ".backup-20240101T000000Z"
    assert patches.latest_backup(names.limit(0), ".backup-").first()["name"] is None
