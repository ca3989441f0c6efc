"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then
seeded block selection.

Only DataFrame functions run on the executors. The driver handles one row per source
(at most ``MAX_SOURCES``, checked) and never a document.
"""

from __future__ import annotations

import heapq
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import layout, scratch

#: A word, and a word with the white space after it.
WORD = r"[^\x20\x09-\x0D]+"
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Most distinct sources; their quotas are broadcast (about 200 bytes each).
MAX_SOURCES = 100_000
#: Blocks of one source must stay below 2**40 (7e13 words): the permutation multiplies by parts of 20 bits in longs.
BLOCK_BITS = 40
WEIGHTS = (3.0, 1.0, 2.0)


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last.

    ``share``: all words of the mix as a part of all words there are. ``most``: no
    source and no document is taken more than so many times.
    """

    weights: tuple[float, ...] = WEIGHTS
    share: float = 1.5
    most: int = 2
    block_words: int = 64
    shards: int = 16
    seed: int = 17


def words(text: str = "text") -> Column:
    """The number of words of the text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words wanted of each source: by weight, at most ``most`` times its size, the excess reshared."""
    weight = [mix.weights[i % len(mix.weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = mix.share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if unit * weight[i] > mix.most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in over:
            out[i] = float(mix.most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients vote / (2k + 1); equal quotients go to the earlier source."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    won = lambda x: [math.floor((v / x + 1) / 2) for v in votes]  # noqa: E731  quotients of at least x
    low, high = 0.0, 2 * max(votes)  # no quotient reaches high
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or sum(won(mid)) > seats:
            low = mid
        else:
            high = mid
    out = won(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _plan(sources: list[tuple[str | None, int]], mix: Mix) -> list[tuple]:
    """(number, source, source_size, target, blocks, step, shift, quotas up to each shard), by source.

    A source's wish is counted in blocks of its own mean size, for its last block may be
    short: a source of ten words has one block of ten.
    """
    sizes = [n for _, n in sources]
    want = targets(sizes, mix)
    blocks = [-(-n // mix.block_words) for n in sizes]
    if max(blocks, default=0) >= 1 << BLOCK_BITS:
        raise ValueError(f"a source has 2**{BLOCK_BITS} blocks or more")
    votes = [w * b / n if n else 0.0 for w, b, n in zip(want, blocks, sizes, strict=True)]
    seats = round(sum(votes))
    # Divisor methods are house-monotone: the seats of the first j shards are a prefix of all.
    upto = [sainte_lague(votes, seats * j // mix.shards) for j in range(1, mix.shards + 1)]
    rng, rows = random.Random(mix.seed), []
    for i, (name, size) in enumerate(sources):
        # The step ranges over all blocks, so that neighbours are dealt far apart whatever their number.
        step = rng.randrange(1, max(2, blocks[i]))
        while blocks[i] and math.gcd(step, blocks[i]) != 1:
            step = rng.randrange(1, max(2, blocks[i]))
        shift = rng.randrange(max(1, blocks[i]))
        rows.append((i, name, size, want[i], blocks[i], step, shift, [min(u[i], mix.most * blocks[i]) for u in upto]))
    return rows


def _dealt(block: Column, step: Column, shift: Column, blocks: Column) -> Column:
    """(block * step + shift) mod blocks, without overflow: the block's number is taken in two parts of 20 bits."""
    half = F.lit(1 << (BLOCK_BITS // 2)).cast("long")
    high = F.pmod(F.floor(block / half) * step, blocks)
    return F.pmod(high * half + F.pmod(block, half) * step + shift, blocks)


def mix_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``pieces``.

    A source's words stand in a seeded order of its documents and are cut into blocks of
    ``block_words``. Its quota of blocks goes to the blocks in the order of a seeded
    permutation, ``most`` rounds at the utmost, and the permutation's order deals them to
    the shards. ``pieces`` lists what is taken of a document: (round, shard, block,
    from_word, to_word), words counted from 0; ``taken`` adds up their words.

    Nulls: a null text has no words and nothing is taken; a null source is a source of
    its own, last in order; null ids are ordered like any. Rows that are equal in id and
    text are interchangeable. Empty tables give empty results. Input columns with the
    added names are replaced. More than ``MAX_SOURCES`` sources are refused.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "taken", "pieces")
    rows = docs.drop(*added).withColumns({"size": words(text), "__mx_key": F.xxhash64(F.col(doc_id), F.lit(mix.seed)), "__mx_tie": F.xxhash64(text)})
    narrow = scratch.table(rows.select(F.col(source).alias("source"), "size", "__mx_key"), "mix-sizes")
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sorted(((r["source"], r["size"]) for r in by_source), key=lambda s: (s[0] is None, s[0] or ""))
    buckets = layout.bucket_count(max((r["n"] for r in by_source), default=0))
    bucket = F.pmod("__mx_key", F.lit(buckets)).cast("int")
    plan = spark.createDataFrame(_plan(sources, mix), "__mx_source int, __s string, source_size long, target double, __mx_blocks long, __mx_step long, __mx_shift long, __mx_quotas array<long>")
    # At most MAX_SOURCES rows, checked above. A source's number, unlike its name, is never null.
    numbers = F.broadcast(plan.select(F.col("__s").alias("__n"), F.col("__mx_source")))
    numbered = lambda t, name: t.join(numbers, F.col(name).eqNullSafe(F.col("__n"))).drop("__n").withColumn("__mx_bucket", bucket)
    starts = layout.offsets(numbered(narrow, "source"), "__mx_source", "__mx_bucket", F.col("size"), "__mx_at")
    placed = layout.positions(numbered(rows, source), starts, "__mx_source", "__mx_bucket", ["__mx_key", "__mx_tie"], F.col("size"), "__mx_at")
    joined = placed.join(F.broadcast(plan), "__mx_source")
    width, at, end = F.lit(mix.block_words).cast("long"), F.col("__mx_at"), F.col("__mx_at") + F.col("size")
    first, last = F.floor(at / width), F.floor((end - 1) / width)

    def piece(again: Column, block: Column) -> Column:
        index = _dealt(block, F.col("__mx_step"), F.col("__mx_shift"), F.col("__mx_blocks")) + again * F.col("__mx_blocks")
        shard = F.size(F.filter(F.col("__mx_quotas"), lambda q: q <= index))
        return F.struct(again.cast("int").alias("round"), shard.alias("shard"), block.alias("block"), (F.greatest(at, block * width) - at).alias("from_word"), (F.least(end, (block + 1) * width) - at).alias("to_word"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(mix.most - 1)), lambda again: F.transform(F.sequence(first, last), lambda block: piece(again, block))))
    none = F.array().cast("array<struct<round:int,shard:int,block:bigint,from_word:bigint,to_word:bigint>>")
    out = joined.withColumn("pieces", F.when(F.col("size") > 0, F.filter(every, lambda p: p["shard"] < mix.shards)).otherwise(none))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["to_word"] - p["from_word"])
    return out.withColumn("taken", taken).drop("__s", "__mx_source", "__mx_at", "__mx_key", "__mx_tie", "__mx_bucket", "__mx_blocks", "__mx_step", "__mx_shift", "__mx_quotas")


def taken_documents(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as documents: one row for each document and round that takes words of it.

    A round that takes the whole document keeps its text; else the text is its taken
    words with the white space after each. Columns added by ``mix_sources`` go, but for
    ``round``. A document of which nothing is taken goes.
    """
    rounds = mixed.where(F.size("pieces") > 0).withColumn("round", F.explode(F.array_distinct(F.transform("pieces", lambda p: p["round"]))))
    mine = F.filter("pieces", lambda p: p["round"] == F.col("round"))
    part = rounds.withColumn("__mine", mine).withColumn("__n", F.aggregate("__mine", F.lit(0).cast("long"), lambda n, p: n + p["to_word"] - p["from_word"]))
    pieces = F.regexp_extract_all(F.col(text), F.lit(WORD_AND_GAP), F.lit(0))
    cut = lambda all_: F.array_join(F.flatten(F.transform("__mine", lambda p: F.slice(all_, (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")))), "")
    partial = part.withColumn("__w", F.when(F.col("__n") < F.col("size"), pieces)).withColumn(text, F.when(F.col("__n") < F.col("size"), cut(F.col("__w"))).otherwise(F.col(text)))
    return partial.drop("__mine", "__n", "__w", "size", "source_size", "target", "taken", "pieces")
