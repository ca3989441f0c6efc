"""Column expressions on findings: ranks, levels, rule ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in order, and their levels in the log format.
SEVERITIES = ("critical", "high", "medium", "low", "info")
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
UNKNOWN_RANK = 99
ENTROPY_RULE = "secrets/high-entropy-near-keyword"


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; anything else 99."""
    return F.coalesce(F.get(F.array(*[F.lit(i) for i in range(5)]), (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")), F.lit(UNKNOWN_RANK))


def threshold_rank(threshold: Column) -> Column:
    """The rank that a threshold includes: "any" counts as low, an unknown one as high."""
    return F.when(threshold == "any", 3).when(threshold.isin("critical", "high", "medium", "low"), severity_rank(threshold)).otherwise(1)


def sarif_level(severity: Column) -> Column:
    level = F.lit("none")
    for name, value in LEVELS.items():
        level = F.when(severity == name, value).otherwise(level)
    return level


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case, any other run as one hyphen, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")


def rule_id(category: Column, detection: Column, pattern: Column) -> Column:
    return (
        F.when((category == "secrets") & (detection == "regex") & (F.coalesce(pattern, F.lit("")) != ""), F.concat(F.lit("secrets/"), slug(pattern)))
        .when((category == "secrets") & (detection == "entropy"), ENTROPY_RULE)
        .otherwise(category)
    )


def rule_name(pattern: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(pattern, F.lit("")), title)


def badge(severity: Column) -> Column:
    return F.concat(F.lit("["), F.upper(severity), F.lit("]"))


def location(path: Column, line: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"))
