"""Written tables between the steps of a job, in the folder that the cluster shares.

A staged table cuts the lineage: what reads it twice reads the same rows, and a lost
executor costs its tasks only.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, tuple[SparkSession, str]] = {}


def root(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; where that is unset, on one machine, a temporary folder is made and set."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quarryline-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = (spark, f"{base.rstrip('/')}/staged-{app}")
        atexit.register(_clear, app)
    return _roots[app][1]


def _clear(app: str) -> None:
    spark, path = _roots.pop(app, (None, ""))
    try:
        drop(spark, path)
    except Exception:  # the JVM is gone: the cluster's own clean-up of the folder applies
        pass


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write(df: DataFrame, name: str, *by: str) -> str:
    """Writes ``df`` as Parquet, in folders of the columns ``by``, and returns the path; it stays until it is dropped or the application ends."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name))
