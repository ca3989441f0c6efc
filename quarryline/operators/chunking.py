"""Overlapping windows of lines, with stable content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X

WINDOW, OVERLAP = 30, 5


def chunk_lines(files: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(rel_path, language, kind, line_start, line_end, content_text, content_hash) from (rel_path, language, text).

    Windows start every ``window - overlap`` lines and stop at the first that reaches the
    end. A null text (not valid UTF-8) and an empty one have no chunks. No shuffle.
    """
    step = window - overlap
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be smaller than the window")
    # A text that isn't empty has a line; a filter on the lines would split each text twice.
    some = files.where(F.col("text") != "").select("rel_path", "language", X.lines(F.col("text")).alias("__lines"))
    last = F.greatest(F.lit(0), F.ceil((F.size("__lines") - window) / step)) * step
    cut = some.withColumn("__start", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))))
    body = cut.select(
        "rel_path", "language", F.lit("lines").alias("kind"), (F.col("__start") + 1).cast("int").alias("line_start"),
        F.least(F.col("__start") + window, F.size("__lines")).cast("int").alias("line_end"),
        F.array_join(F.slice("__lines", (F.col("__start") + 1).cast("int"), window), "\n").alias("content_text"),
    )
    return body.withColumn("content_hash", X.content_hash(F.col("rel_path"), F.col("language"), F.col("line_start"), F.col("line_end"), F.col("content_text")))


def corpus_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (files, chunks); files without chunks count."""
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
