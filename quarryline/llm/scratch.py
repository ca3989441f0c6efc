"""Written tables that cut lineage, kept in the cluster's shared checkpoint folder.

A table written here survives the loss of any executor: later stages reread files
instead of recomputing or depending on one executor's blocks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, tuple[SparkSession, str]] = {}
#: The tables of each open ``passing`` block, innermost last.
_open: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder is given (tests on one
    machine), a temporary folder is made and set.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quarryline-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = (spark, f"{base.rstrip('/')}/quarryline-{app}")
        atexit.register(clear, app)
    return _roots[app][1]


def clear(app: str) -> None:
    """Deletes the application's tables; a session that has already ended leaves nothing to do."""
    spark, path = _roots.pop(app, (None, ""))
    try:
        drop(spark, path)
    except Exception:  # the JVM is gone: the cluster's own clean-up of the folder applies
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table; nothing may read it later."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write(df: DataFrame, name: str, kept: bool = False) -> str:
    """Writes ``df`` as Parquet in the shared folder and returns the path."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = _open[:-1] if kept else _open
    if blocks:
        blocks[-1].append(path)
    return path


def table(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the table read back.

    A table made in a ``passing`` block goes at its end, or, if ``kept``, at the end of
    the block around it; without a block it stays until the application ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df, name, kept))


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables made inside, but for kept ones, when the block ends.

    What leaves the block may read kept tables only.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop(spark, path)
