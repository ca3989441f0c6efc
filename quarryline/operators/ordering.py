"""Running totals over a whole order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources import staging


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in ranges of about equal numbers of rows in the order of ``keys``, sorted inside, with ``__range`` in that order.

    Spark draws the splitters from rows of the whole tuple of keys, so the rows of one first
    key, however many, go to many ranges. Rows equal in all keys are split by their
    place in the input, which must be a written table: it is read once for the draw and
    once for the rows.
    """
    placed = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*keys, "__tie"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie").withColumn("__range", F.spark_partition_id())


def running(df: DataFrame, key: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` of all rows up to and with each, in the order of (``key``, ``order``).

    The input is computed once and its rows move once, to sorted ranges in which sums run;
    then each range gets the sum of the ranges before it. Only one sum a range comes
    together in one task. Null amounts count as 0, rows without a key are left out, and
    rows equal in key and order follow each other in any order.
    """
    held = staging.table(df.where(F.col(key).isNotNull()).withColumn("__amount", F.coalesce(amount, F.lit(0)).cast("long")), "unordered")
    names = df.columns

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.int64(0)
        for b in batches:
            upto = total + np.cumsum(b.column("__amount").to_numpy(), dtype=np.int64)
            total = upto[-1] if len(upto) else total
            yield b.append_column("__upto", pa.array(upto))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = staging.table(ranged(held, [key, *order]).mapInArrow(sums, f"{fields}, __amount long, __range int, __upto long"), "ordered")
    # A row for each range: as many as the shuffle has partitions.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = local.groupBy("__range").agg(F.sum("__amount").alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    total = (F.col("__start") + F.col("__upto")).cast("long")
    return local.join(F.broadcast(starts), "__range").withColumn(out, total).select(*[c for c in df.columns if c != out], out)
