"""Running totals over orders whose first key has few values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import ordering

ROWS = 1_000_000


@pytest.fixture
def ranges(spark):
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [1, 3, 800])
def test_rows_of_few_keys_go_to_all_ranges(spark, ranges, keys):
    ids = spark.range(ROWS)
    df = ids.select(F.format_string("k%04d", F.col("id") * 7919 % keys).alias("key"), (F.col("id") * 104_729 % ROWS).alias("line"), (F.col("id") % 11).alias("size"))
    held = [r["n"] for r in ordering.ranged(df, ["key", "line"]).groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert len(held) == ranges and max(held) < 2 * ROWS / ranges
    got = ordering.running(df, "key", ["line"], F.col("size"), "upto").toPandas().sort_values(["key", "line"])
    assert len(got) == ROWS and (got["upto"].to_numpy() == np.cumsum(got["size"].to_numpy())).all()
    sql = ordering.running(df, "key", ["line"], F.col("size"), "upto").agg(F.sum(F.col("upto") % 1009)).first()[0]
    assert sql == int((got["upto"] % 1009).sum())


def test_equal_rows_are_split_too(spark, ranges):
    df = spark.range(200_000).select(F.lit("same").alias("key"))
    held = [r["n"] for r in ordering.ranged(df, ["key"]).groupBy("__range").agg(F.count("*").alias("n")).collect()]
    assert len(held) == ranges and max(held) < 2 * 200_000 / ranges
    got = ordering.running(df, "key", [], F.lit(1), "n").agg(F.count_distinct("n"), F.max("n")).first()
    assert tuple(got) == (200_000, 200_000)


def test_the_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(5000).selectExpr("concat('k', id % 3) AS key", "id").mapInArrow(count, "key string, id long")
    assert ordering.running(df, "key", ["id"], F.lit(2), "n").agg(F.max("n")).first()[0] == 10_000
    assert seen.value == 5000


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("b", 1), (None, 9), ("a", None), ("a", 4)], "key string, size int")
    assert sorted(r["n"] for r in ordering.running(df, "key", ["size"], F.col("size"), "n").collect()) == [0, 4, 5]
    assert ordering.running(df.limit(0), "key", [], F.col("size"), "n").columns == ["key", "size", "n"]
    assert ordering.running(df, "key", ["size"], F.col("size"), "size").columns == ["key", "size"]
