"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, components.

Links across cells aren't lost. A vector at most ``gap`` from another one lies at most
``gap`` behind the plane between their two cells, so it visits the cells whose plane is
that near, and only those. Equal vectors are compared once and counted as many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import scratch, vectors
from quarryline.llm.components import components

#: Vectors per cell that are aimed at, most cells (their centres are broadcast), and vectors on either side of a block.
PER_CELL, MAX_CELLS, BLOCK = 4096, 4096, 2048


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, from unit rows ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return np.unique(centres, axis=0)


#: A cell's number is the vectors' length times this, plus the number of the nearest centre of that length.
CELLS = 1 << 20


def _visits(x: np.ndarray, centres: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The own cell of each unit row, and (rows, cells) of its visits: lower cells whose plane is within ``gap``."""
    near = x @ centres.T
    own = near.argmax(axis=1)
    # Rounding may only make centres seem farther apart, which lets more visits through.
    space = np.sqrt(np.maximum(2 - 2 * centres[own] @ centres.T, 0) + 1e-12)
    behind = (near[np.arange(len(x)), own][:, None] - near) / space
    return own, *np.nonzero((behind <= gap + 1e-9) & (np.arange(len(centres))[None, :] < own[:, None]))


def _celled(distinct: DataFrame, centres: dict[int, np.ndarray], gap: float) -> DataFrame:
    """A row (cell, visitor, node, n, vector) for the own cell of each vector and for each lower cell that it visits."""
    held = distinct.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                for d, rows in vectors.by_length(batch.column(2)).items():
                    part = batch.take(pa.array(rows))
                    x = vectors.unit(vectors.matrix(part.column(2)))
                    # A length without centres of its own has one cell.
                    own, i, other = _visits(x, held.value.get(d, np.eye(1, d)), gap)
                    taken = part.take(pa.array(np.concatenate((np.arange(len(x)), i))))
                    cell = d * CELLS + np.concatenate((own, other))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.arange(len(cell)) >= len(x)), *taken.columns], ["cell", "visitor", "node", "n", "vector"])

    return distinct.select("node", "n", "vector").mapInArrow(run, f"cell long, visitor boolean, node long, n long, vector {distinct.schema['vector'].dataType.simpleString()}")


def _linked(pairs: DataFrame, least: float) -> DataFrame:
    """(node, links, root) for each vector with links in a pair of blocks: how many vectors it links to, and the least node joined to it there."""

    def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        items = column.flatten()
        return items.field("node").to_numpy(), items.field("n").to_numpy(), vectors.unit(vectors.matrix(items.field("vector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py()
                a, n_a, x = side(batch.column(1).slice(k, 1))
                b, n_b, y = side(batch.column(2).slice(k, 1))
                found = []
                for i in range(0, len(a), 256):
                    p, q = np.nonzero(x[i : i + 256] @ y.T >= least)
                    found.append((p + i, q))
                p, q = (np.concatenate(f) for f in zip(*found, strict=True))
                if same:
                    p, q = p[a[p] != b[q]], q[a[p] != b[q]]
                links = {0: np.bincount(p, n_b[q], len(a)).astype(np.int64), 1: np.bincount(q, n_a[p], len(b)).astype(np.int64)}
                root_a, root_b, before = a.copy(), b.copy(), None
                while before is None or (before != root_a.sum()):
                    before = root_a.sum()
                    np.minimum.at(root_b, q, root_a[p])
                    np.minimum.at(root_a, p, root_b[q])
                np.minimum.at(root_b, q, root_a[p])
                out = [(a, links[0], root_a)] + ([] if same else [(b, links[1], root_b)])
                node, count, root = (np.concatenate([o[m][o[1] > 0] for o in out]) for m in range(3))
                if len(node):
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(count), pa.array(root)], ["node", "links", "root"])

    return pairs.mapInArrow(run, "node long, links long, root long")


def _pairs(celled: DataFrame, block: int) -> DataFrame:
    """(same, left, right): blocks of each cell's members with each other, and of its visitors with its members."""
    sizes = celled.groupBy("cell", "visitor").agg(F.count("*").alias("rows"))
    blocks = scratch.table(sizes.select("cell", "visitor", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "embed-blocks")
    dealt = celled.join(blocks, ["cell", "visitor"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # A list holds about ``block`` vectors: rows are dealt to blocks by a hash.
    packed = scratch.table(dealt.groupBy("cell", "visitor", "block").agg(F.collect_list(F.struct("node", "n", "vector")).alias("rows")), "embed-packed")
    members = blocks.where("not visitor").select("cell", F.col("blocks").alias("others"))
    against = F.explode(F.sequence(F.when(F.col("visitor"), 0).otherwise(F.col("block")), F.col("others") - 1))
    left = packed.join(members, "cell").select("cell", "visitor", "block", F.col("rows").alias("left"), against.alias("other"))
    right = packed.where("not visitor").select("cell", F.col("block").alias("other"), F.col("rows").alias("right"))
    return left.join(right, ["cell", "other"]).select((~F.col("visitor") & (F.col("block") == F.col("other"))).alias("same"), "left", "right")


def near_vectors(df: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, per_cell: int = PER_CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``df``.

    Vectors link when their cosine in double precision is ``least`` or more (0 < least
    <= 1). ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest vec_id reachable and ``kept`` marks the row that bears it.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; vectors of any other kind are compared with those of their own length. Equal
    vectors link. A null vec_id takes part, is never kept, and its component is null where no other id
    is reachable. An empty table gives an empty result. Other columns are ignored. The
    centres are fitted on at most ``vectors.MAX_SAMPLE`` vectors.
    """
    with scratch.passing(df.sparkSession):
        named, smallest = _named(df, least, vec_id, vector, block, per_cell)
    return named.join(smallest, "group", "left").select(
        "vec_id", "n_links", F.when(F.col("group").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _named(df: DataFrame, least: float, vec_id: str, vector: str, block: int, per_cell: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links, group) of each row and (group, component_id), two kept tables."""
    usable = vectors.finite(vector)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable, F.xxhash64(vector)).alias("node"), F.when(usable, F.col(vector)).alias("vector"))
    distinct = scratch.table(rows.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("n")), "embed-distinct")
    count = distinct.count()
    fitted = vectors.sample(distinct, "vector", count)
    known = sum(map(len, fitted.values()))
    cells = {d: max(1, min(MAX_CELLS, len(x), round(count * len(x) / known / per_cell))) for d, x in fitted.items()}
    centres = {d: spherical_kmeans(vectors.unit(x), cells[d]) for d, x in fitted.items()}
    celled = scratch.table(_celled(distinct, centres, math.sqrt(max(0.0, 2 - 2 * least))), "embed-cells")
    linked = scratch.table(_linked(_pairs(celled, block), least), "embed-links")
    links = scratch.table(linked.groupBy("node").agg(F.sum("links").alias("links")).join(distinct.select("node", "n"), "node", "right").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "embed-counts")
    found = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = scratch.table(links.join(found, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("group")), "embed-groups")
    named = scratch.table(rows.select("vec_id", "node").join(info, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "group"), "embed-named", kept=True)
    return named, scratch.table(named.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("component_id")), "embed-least", kept=True)
