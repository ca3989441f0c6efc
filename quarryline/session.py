"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benches; on a cluster spark-submit makes it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quarryline")
    base = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it.

    On a cluster the package is installed on the executors or sent with --py-files.
    """
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (here, env.get("PYTHONPATH", ""))))
