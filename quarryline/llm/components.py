"""Connected components by contraction: each round joins every node to its least neighbour.

Nodes take a hashed order, so that no numbering of the ids makes long chains; a round
shrinks the edges by a constant part. Every table of a round is written, so a lost
executor costs one task, and joins on a hot node meet plain tables on both sides,
which lets adaptive execution split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; ``component`` is its smallest reachable node.

    ``a`` and ``b`` are longs. Edges may repeat, run either way or join a node to
    itself; an edge with a null end counts for nothing. No edges: no rows.
    """
    with scratch.passing(edges.sparkSession):
        label, least = _labels(edges, a, b)
    return label.join(least, "label").select("node", "component")


def _labels(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(node, label) and (label, component), two kept tables; the tables of the rounds go."""
    # xxhash64 maps single longs one to one, so hashed nodes stay distinct.
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = ends.select(F.explode(F.array(a, b)).alias("node")).distinct().select("node", F.xxhash64("node").alias("u"))
    left = scratch.table(_ordered(ends.select(F.xxhash64(a).alias("u"), F.xxhash64(b).alias("v"))), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        parent = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        moved = left.join(parent.select("u", F.col("p").alias("pu")), "u").join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        left = scratch.table(_ordered(moved.select(F.col("pu").alias("u"), F.col("pv").alias("v"))), "edges")
        steps.append(parent)
    label = nodes.withColumn("label", F.col("u"))
    for parent in steps:
        label = label.join(parent.select(F.col("u").alias("label"), "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label"))
    label = scratch.table(label.select("node", "label"), "labels", kept=True)
    return label, scratch.table(label.groupBy("label").agg(F.min("node").alias("component")), "least", kept=True)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
