"""A report that the tasks write, against one that is made of lists."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quarryline.operators import report
from quarryline.plans import catalog
from quarryline.sources import sinks


def whole(findings, tool="quarryline", version="0.1.0"):
    """The log as one object; keys in their order."""
    rules = [
        {"id": r["rule_id"], "name": r["rule_name"], "shortDescription": {"text": r["rule_name"]}, "fullDescription": {"text": r["explanation"]}, "defaultConfiguration": {"level": r["level"]},
         "properties": {"category": r["category"], "cwe": r["cwe"], "owasp": r["owasp"], "tags": ["security", r["category"]]}}
        for r in report.sarif_rules(findings).orderBy("rule_id").collect()
    ]
    results = [
        {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]},
         "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["start_line"]} | ({"endLine": r["end_line"]} if r["end_line"] else {})}}],
         "partialFingerprints": {"contentHash/v1": r["fingerprint"]}}
        for r in report.sarif_results(findings).orderBy("seq").collect()
    ]
    log = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results}]}
    return json.dumps(log, indent=2)


@pytest.fixture(scope="module")
def found(spark, sf):
    odd = F.when(F.col("seq") % 50 == 0, F.lit('a "quoted" / \\ tab\t line\n é ☃ 😀 \u2028 \x01')).otherwise(F.col("title"))
    return catalog.findings(spark, sf).withColumn("title", odd).repartition(7).persist()


def test_the_report_is_that_of_one_list(spark, found, tmp_path):
    out = tmp_path / "log.sarif"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_sarif(found, str(out))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.read_text() == whole(found)
    assert os.listdir(tmp_path) == ["log.sarif"] and out.stat().st_mode & 0o077 == 0


def test_reports_without_results(spark, found, tmp_path):
    sinks.write_sarif(found.limit(0), str(tmp_path / "none.sarif"), tool='a "@results@" tool')
    assert (tmp_path / "none.sarif").read_text() == whole(found.limit(0), tool='a "@results@" tool')


def test_a_failed_report_leaves_nothing(spark, found, tmp_path):
    broken = found.withColumn("title", F.when(F.col("seq") == found.agg(F.max("seq")).first()[0], F.raise_error(F.lit("no title"))).otherwise(F.col("title")))
    (tmp_path / "log.sarif").write_text("old")
    with pytest.raises(Exception, match="no title"):
        sinks.write_sarif(broken, str(tmp_path / "log.sarif"))
    assert (tmp_path / "log.sarif").read_text() == "old" and len(os.listdir(tmp_path)) == 1
