"""Gapless positions and running totals within groups of any size.

A window over a whole group would put the group into one task. Here every group is
cut into hash buckets: bucket totals are summed first (with map-side combine), their
running sum is taken over buckets only, and the window runs inside a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most buckets of one group; a running sum over buckets never sees more rows than this.
MAX_BUCKETS = 65_536
#: Bits of the filter of ``thinned``: 65,536 rows of 64 bits, whatever the size of the input.
FILTER_BITS = 22


def bound(build: Callable[[Column], Column], **values: Column) -> Column:
    """``build(v)`` where ``v[name]`` is each value, computed once a row.

    A lambda of a fold evaluates all it mentions at every step, so what doesn't change
    from step to step goes in here.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.get(F.transform(F.array(row), build), F.lit(0))


def bucket_count(rows: int, per_bucket: int = 1024) -> int:
    """Buckets for groups of up to ``rows`` rows, between 1 and ``MAX_BUCKETS``."""
    return max(1, min(MAX_BUCKETS, -(-rows // per_bucket)))


def offsets(narrow: DataFrame, group: str, bucket: str, amount: Column, out: str) -> DataFrame:
    """(group, bucket, out): the sum of ``amount`` in the group's earlier buckets."""
    sums = narrow.groupBy(group, bucket).agg(F.sum(amount).cast("long").alias("__sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias(out))


def positions(df: DataFrame, starts: DataFrame, group: str, bucket: str, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the running sum of ``amount`` before each row, in (bucket, order) within the group.

    ``starts`` comes from ``offsets`` over the same rows. ``group`` must never be null: a
    null-safe join would be keyed by other expressions than the window, and the rows would
    move a second time. With plain equality the join takes the window's partitioning.
    """
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long"))
    base = starts.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), F.col(out).alias("__start"))
    joined = placed.join(base, (F.col(group) == F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(out, F.col(out) + F.col("__start")).drop("__g", "__b", "__start")


def thinned(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` (a 64-bit hash) isn't among ``wanted``'s.

    A bit filter of fixed size tests rows where they are read, so a join on found keys
    that follows moves few others. Strays remain; with very many keys all rows may. The
    join decides, so the filter never changes a result.
    """
    spot = lambda k: F.pmod(k, F.lit(1 << FILTER_BITS)).cast("int")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot(k), F.lit(64)))
    words = wanted.select(F.shiftright(spot(F.col(key)), 6).alias("__word"), bit(F.col(key)).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    # At most 2**FILTER_BITS / 64 rows.
    held = (F.shiftright(spot(df[key]), 6) == words["__word"]) & (words["__bits"].bitwiseAND(bit(df[key])) != 0)
    return df.join(F.broadcast(words), held, "left_semi")
