"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until
every splitter meets its tolerance; then one exchange.

Only DataFrame functions run on the executors. The driver sees histograms of at most
``shards * 2**PROBE_BITS`` cells, whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import layout, scratch

#: Each round probes this many further bits of the key of every open bracket.
PROBE_BITS = 12
MAX_LONG = 2**63 - 1


@dataclass(frozen=True)
class Bracket:
    """A range of keys that still holds a splitter: keys whose bits above ``width`` equal ``prefix``.

    ``first`` is None while the first key is being split; later it is that key's one
    value (a hot group) and ``prefix`` belongs to the second key.
    """

    first: int | None
    prefix: int
    width: int
    below: int
    targets: tuple[int, ...]


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def _inside(b: Bracket) -> Column:
    key = F.col("k1" if b.first is None else "k2")
    hit = F.lit(True) if b.width >= 64 else F.shiftright(key, b.width) == F.lit(b.prefix)
    return hit if b.first is None else hit & (F.col("k1") == F.lit(b.first))


def _histogram(keys: DataFrame, open_: list[Bracket]) -> dict[int, list]:
    """Exact bytes and rows of each probed cell of each open bracket, in key order."""
    which = F.lit(None).cast("int")
    cell = F.lit(None).cast("long")
    for i, b in enumerate(open_):
        key = F.col("k1" if b.first is None else "k2")
        which = F.when(_inside(b), i).otherwise(which)
        cell = F.when(_inside(b), F.shiftright(key, max(0, b.width - PROBE_BITS))).otherwise(cell)
    rows = (
        keys.select(which.alias("b"), cell.alias("cell"), "k1", "k2", "size")
        .where("b is not null")
        .groupBy("b", "cell")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("k1").alias("lo1"), F.max("k1").alias("hi1"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2"))
        .collect()
    )
    cells: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["b"], r["cell"])):
        cells.setdefault(r["b"], []).append(r)
    return cells


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (k1, k2) whose bytes below are within ``tolerance`` of equal shares.

    A bracket is refined until the nearer edge of the cell with the target is within
    ``tolerance * total / shards`` bytes or the cell is one key; a first key that is
    too heavy (a hot group of equal texts) is split by the second.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    open_ = [Bracket(None, 0, 64, 0, tuple(total * i // shards for i in range(1, shards)))]
    while open_:
        nxt: dict[tuple, Bracket] = {}
        for i, cells in _histogram(keys, open_).items():
            b, below = open_[i], open_[i].below
            width = max(0, b.width - PROBE_BITS)
            waiting = list(b.targets)
            for c in cells:
                above = below + c["bytes"]
                for target in [t for t in waiting if t <= above]:
                    waiting.remove(target)
                    one = c["lo1"] == c["hi1"] and c["lo2"] == c["hi2"]
                    if min(target - below, above - target) <= slack or one:
                        edge = (c["cell"] if target - below <= above - target else c["cell"] + 1) << width
                        found[target] = (edge, -MAX_LONG - 1) if b.first is None else (b.first, edge)
                    elif b.first is None and c["lo1"] == c["hi1"]:
                        k = (c["lo1"], 0, 64)
                        nxt[k] = Bracket(c["lo1"], 0, 64, below, (*(nxt[k].targets if k in nxt else ()), target))
                    else:
                        k = (b.first, c["cell"], width)
                        nxt[k] = Bracket(b.first, c["cell"], width, below, (*(nxt[k].targets if k in nxt else ()), target))
                below = above
        open_ = list(nxt.values())
    return [found[t] for t in sorted(found)]


def _shard_of(bounds: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the row's key."""
    shard = F.lit(0)
    for a, b in bounds:
        if a > MAX_LONG:
            continue
        at = F.col("__hs_k1") == F.lit(a)
        after = F.col("__hs_k1") > F.lit(a)
        if b <= MAX_LONG:
            after = after | (at & (F.col("__hs_k2") >= F.lit(b)))
        shard = shard + after.cast("int")
    return shard.cast("int")


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, size: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``shard`` and ``slot`` (long, gapless from 0 in each shard).

    Law: shards hold near-equal sums of ``size`` (default: UTF-8 bytes plus 1). The sort
    key is (hash of the text, hash of text and id), so equal texts are neighbours and
    leave a shard only where a boundary falls into their group; slots follow a fixed
    pseudo-random order.

    Nulls: a null text has size 1; a null id is a key like any other. Rows equal in id
    and text share a key: they stay in one shard and take neighbouring slots in any
    order. An empty table gives an empty result. Input columns called ``size``,
    ``shard`` or ``slot`` are replaced.
    """
    size = text_bytes(text) if size is None else size
    rows = docs.withColumns({"__hs_size": size, "__hs_k1": F.xxhash64(text), "__hs_k2": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), doc_id)})
    keys = scratch.table(rows.select(F.col("__hs_k1").alias("k1"), F.col("__hs_k2").alias("k2"), F.col("__hs_size").alias("size")), "shard-keys")
    bounds = splitters(keys, shards, tolerance)
    buckets = layout.bucket_count(keys.count() // shards)
    placed = lambda df: df.withColumns({"shard": _shard_of(bounds)}).withColumn("__hs_bucket", F.pmod("__hs_k2", F.lit(buckets)).cast("int"))
    narrow = placed(keys.select(F.col("k1").alias("__hs_k1"), F.col("k2").alias("__hs_k2")))
    starts = layout.offsets(narrow, "shard", "__hs_bucket", F.lit(1), "slot")
    out = layout.positions(placed(rows.drop("size", "shard", "slot")), starts, "shard", "__hs_bucket", ["__hs_k2", "__hs_k1"], F.lit(1), "slot")
    return out.withColumn("size", F.col("__hs_size")).drop("__hs_size", "__hs_k1", "__hs_k2", "__hs_bucket")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes one folder per shard; rows carry their slot.

    Null and empty texts and repeated rows are written like any other; an empty table
    writes no shard's folder. The path must not exist.
    """
    sharded.write.partitionBy("shard").parquet(path)
