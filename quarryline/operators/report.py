"""Findings as a table, a summary, rules and results of a log, and a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import findings as N
from quarryline.functions import text as X

SNIPPET_BYTES = 100


def sorted_findings(findings: DataFrame) -> DataFrame:
    """By severity, path, line, then the order of arrival (``seq``); unknown severities last."""
    return findings.withColumn("severity_rank", N.severity_rank(F.col("severity"))).orderBy("severity_rank", "file_path", "line_start", "seq")


def table_rows(findings: DataFrame) -> DataFrame:
    """(badge, location, title, snippet) in the table's order."""
    return sorted_findings(findings).select(N.badge(F.col("severity")).alias("badge"), N.location(F.col("file_path"), F.col("line_start")).alias("location"), "title", X.snippet(F.col("snippet"), SNIPPET_BYTES).alias("snippet"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """(severity, severity_rank, n) of each known severity that occurs, and the total as severity "total", rank 100; the total counts unknown ones too."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n")).withColumn("severity_rank", N.severity_rank(F.col("severity")))
    total = findings.agg(F.count("*").alias("n")).select(F.lit("total").alias("severity"), F.lit(100).alias("severity_rank"), "n")
    return counts.where(F.col("severity_rank") < N.UNKNOWN_RANK).select("severity", "severity_rank", "n").unionByName(total)


def at_or_above(findings: DataFrame, threshold: str) -> DataFrame:
    """One row ``n``: findings of the threshold's rank or worse."""
    return findings.agg(F.count_if(N.severity_rank(F.col("severity")) <= N.threshold_rank(F.lit(threshold))).alias("n"))


def gate(findings: DataFrame, threshold: str = "high", ci: bool = True) -> bool:
    """True if a build should fail."""
    if threshold not in ("critical", "high", "medium", "low", "any"):
        raise ValueError(f"unknown threshold {threshold!r}")
    return ci and at_or_above(findings, threshold).first()["n"] > 0


def _with_rule(findings: DataFrame) -> DataFrame:
    c = F.col
    return findings.withColumns({"rule_id": N.rule_id(c("category"), c("detection"), c("pattern")), "rule_name": N.rule_name(c("pattern"), c("title")), "level": N.sarif_level(c("severity"))})


def sarif_rules(findings: DataFrame) -> DataFrame:
    """A row for each rule id, from its first finding by ``seq``."""
    first = _with_rule(findings).groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "explanation", "category", "cwe", "owasp", "level"), "seq").alias("r"))
    return first.select("rule_id", "r.*")


def sarif_results(findings: DataFrame) -> DataFrame:
    """A row for each finding; the end line only where it is beyond the start."""
    return _with_rule(findings).select("seq", "rule_id", "level", F.col("title").alias("message"), F.col("file_path").alias("uri"), F.col("line_start").alias("start_line"), F.when(F.col("line_end") > F.col("line_start"), F.col("line_end")).alias("end_line"), F.col("content_hash").alias("fingerprint"))


def fixable(findings: DataFrame) -> DataFrame:
    """Findings of categories that aren't kept from automatic patches."""
    return findings.where(~F.col("category").isin("secrets", "sql-injection", "command-injection", "ssrf", "missing-auth", "broken-access"))
