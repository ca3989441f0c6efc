"""Phrase collocations: count-min sketches choose, exact counts decide.

The texts are read level by level. At each level every task counts its n-grams in a sketch
of fixed size; the sketches are merged by adding cells, and of the sum only one bit a cell
is kept: whether it reached the bound. A sketch never counts too little, so an n-gram
with an unset bit is rare, and one whose parts are rare isn't counted at all. A last pass
counts the survivors exactly, which drops those that only shared cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import scratch
from quarryline.llm.batches import pieces

#: Occurrences of a candidate, its most words, and phrases reported for each language.
LEAST, WORDS, TOP = 100, 5, 2000
#: Sizes of n-grams that share a sketch, in the order of the passes; each needs the ones before.
LEVELS = ((1,), (2,), (3, 4, 5))
#: Rows of a sketch; cells of a row are a power of two near a 32nd of the words, between these two: 16 to 256 MB a worker, and 2 to 32 MB of bits.
ROWS, FEWEST, MOST = 2, 1 << 23, 1 << 27
#: Cells of a slice, the piece in which sketches are merged.
SLICE = 1 << 16
#: Rows and bytes of texts that are counted at once.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Bytes of texts that a task takes, about, where the input's own parts are smaller.
TASK_BYTES = 256 << 20
#: Phrases whose counts a task holds before it hands them on.
HELD = 500_000
#: Shares in which a language's phrases are ranked before the last ranking sees the best of each.
SHARES = 32

# Bytes that end a piece, and those that end a word.
BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Batch:
    """The words of some texts: ``word`` (place in ``names``), ``piece``, ``lang`` (place in ``langs``) of each word in order."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        bodies = [t or b"" for t in pc.cast(texts, pa.binary()).to_pylist()]
        raw = _LOWER[np.frombuffer(b"\n".join(bodies), np.uint8)]
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        begins = np.cumsum([0, *(len(b) + 1 for b in bodies[:-1])])
        self.langs, codes = [], {}
        own = []
        for lang in langs.to_pylist():
            lang = "und" if lang is None else lang
            own.append(codes.setdefault(lang, len(codes)))
        self.langs = list(codes)
        self.lang = np.array(own, np.int64)[np.searchsorted(begins, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
        upto = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=upto[1:])
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(raw[inside])])
        coded = packed.dictionary_encode()
        self.word, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def hashes(self) -> Iterator[np.ndarray]:
        """For 1, 2, ... ``WORDS`` words: a hash of the n-gram that begins at each word and of its language; the last words have none."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names], np.uint64)[self.word] if self.names else np.zeros(0, np.uint64)
        lang = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in self.langs], np.uint64)[self.lang] if len(self.lang) else np.zeros(0, np.uint64)
        h = _mixed(own ^ lang)
        yield h
        for k in range(2, WORDS + 1):
            h = _mixed(h[: max(0, len(own) - k + 1)] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :])
            yield h

    def whole(self, k: int) -> np.ndarray:
        """True where the ``k`` words from a word on are in one piece."""
        return self.piece[k - 1 :] == self.piece[: max(0, len(self.piece) - k + 1)]


def _cells(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (((h >> np.uint64(32)) + np.uint64(row) * (h | np.uint64(1))) & np.uint64(cells - 1)).astype(np.int64)


class _Filters:
    """The bits of the finished levels."""

    def __init__(self, bits: list[bytes], cells: int):
        self.cells = cells
        self.level = {k: np.frombuffer(b, np.uint8).reshape(ROWS, -1) for ks, b in zip(LEVELS, bits) for k in ks}

    def pass_(self, k: int, h: np.ndarray) -> np.ndarray:
        """True where an n-gram of ``k`` words may be frequent."""
        out = np.ones(len(h), bool)
        for row in range(ROWS):
            cell = _cells(h, row, self.cells)
            out &= (self.level[k][row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out

    def alive(self, batch: _Batch, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hashes, where) for each size up to the largest of ``sizes``: n-grams inside a piece whose parts may all be frequent, and that may be so themselves where their level is finished."""
        before = None
        for k, h in enumerate(batch.hashes(), 1):
            if k > max(sizes):
                return
            where = batch.whole(k)
            if before is not None:
                where &= before[: len(where)] & before[1 : len(where) + 1]
            if k in self.level:
                at = np.flatnonzero(where)
                where[at] = self.pass_(k, h[at])
            yield k, h, where
            before = where


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Batch]:
    for b in pieces(batches, "text", rows=BATCH_ROWS, size=BATCH_BYTES):
        yield _Batch(b.column("text"), b.column("lang"))


def _sketch(docs: DataFrame, sizes: tuple[int, ...], done: Broadcast, cells: int, least: int) -> bytes:
    """The merged sketch's bits of n-grams of ``sizes``: ``ROWS`` times ``cells`` bits.

    Counts are cut at ``least`` when they leave a task; sums of cut counts reach ``least`` just
    where the whole sums do.
    """
    width, sparse = np.dtype("u1" if least < 256 else "<u4"), SLICE // 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, counts = _Filters(done.value, cells), None
        for batch in _texts(batches):
            counts = np.zeros((ROWS, cells), width) if counts is None else counts
            for k, h, where in filters.alive(batch, sizes):
                if k in sizes:
                    some, n = np.unique(h[where], return_counts=True)
                    for row in range(ROWS if len(some) else 0):
                        cell = _cells(some, row, cells)
                        order = np.argsort(cell)
                        cell, first = np.unique(cell[order], return_index=True)
                        counts[row][cell] = np.minimum(counts[row][cell] + np.add.reduceat(n[order], first), least)
        if counts is None:
            return
        for at, part in enumerate(counts.reshape(-1, SLICE)):
            where = np.flatnonzero(part)
            if len(where):
                # Places of 16 bits and their counts, or all counts where many are set.
                packed = [where.astype("<u2").tobytes(), part[where].tobytes()] if len(where) < sparse else [b"", part.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["slice", "places", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, places, part in zip(b.column("slice").to_pylist(), b.column("places"), b.column("cells")):
                held = sums.setdefault(at, np.zeros(SLICE, np.uint64))
                held[np.frombuffer(places.as_buffer(), "<u2") if places.as_buffer().size else slice(None)] += np.frombuffer(part.as_buffer(), width)
                np.minimum(held, least, out=held)
        for at, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    parts = docs.mapInArrow(count, "slice int, places binary, cells binary").repartition("slice").mapInArrow(merge, "slice int, bits binary")
    out = bytearray(ROWS * cells // 8)
    for r in parts.collect():  # ROWS * cells bits at most
        out[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = r["bits"]
    return bytes(out)


def _exact(docs: DataFrame, done: Broadcast, cells: int) -> DataFrame:
    """(lang, words, phrase, n): counts of the surviving n-grams, and of all words as ``words`` 0; phrases are told apart by their words, not by hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, seen = _Filters(done.value, cells), {}
        for batch in _texts(batches):
            for lang, n in zip(batch.langs, np.bincount(batch.lang, minlength=len(batch.langs)).tolist()):
                held = seen.setdefault((lang, 0), {})
                held[b""] = held.get(b"", 0) + n
            ids = batch.lang
            for k, _, where in filters.alive(batch, (WORDS,)):
                at = np.flatnonzero(where)
                if not len(at):
                    break
                # The number of the first k - 1 words, and the word after them.
                key = ids[at] << 32 | batch.word[at + k - 1]
                _, first, number, counted = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                ids = np.full(len(batch.word), -1, np.int64)
                ids[at] = number
                words = [list(map(batch.names.__getitem__, batch.word[at[first] + j].tolist())) for j in range(k)]
                for lang, phrase, n in zip(batch.lang[at[first]].tolist(), map(b" ".join, zip(*words)), counted.tolist()):
                    held = seen.setdefault((batch.langs[lang], k), {})
                    held[phrase] = held.get(phrase, 0) + n
            if sum(map(len, seen.values())) > HELD:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    def rows(seen: dict[tuple[str, int], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, k), held in seen.items():
            columns = [pa.array([lang] * len(held), pa.string()), pa.array([k] * len(held), pa.int32()), pa.array(map(bytes.decode, held), pa.string()), pa.array(held.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame, least: int = LEAST, cells: int | None = None) -> DataFrame:
    """(lang, words, phrase, n): every phrase of 1 to ``WORDS`` words that occurs ``least`` times or more in its language, and all words as ``words`` 0 and the empty phrase.

    Without ``cells`` the sketch's width follows the bytes of the texts. A narrow sketch
    costs more exact counting and changes no result.
    """
    if least < 1:
        raise ValueError("a phrase occurs at least once")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size, context = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, docs.sparkSession.sparkContext
    # A task's sketch and counts are handed on once, so tasks are large, but for two a core at least.
    rows = rows.coalesce(max(2 * context.defaultParallelism, -(-size // TASK_BYTES)))
    if cells is None:
        cells = min(MOST, max(FEWEST, 1 << (size // 192).bit_length()))
    if cells < SLICE or cells & (cells - 1):
        raise ValueError(f"the cells of a row must be a power of two, {SLICE} at least")
    bits: list[bytes] = []
    for sizes in LEVELS:
        bits.append(_sketch(rows, sizes, context.broadcast(list(bits)), cells, least))
    return _exact(rows, context.broadcast(bits), cells).where((F.col("n") >= least) | (F.col("words") == 0))


def _part(words: str, begin: str, length: str) -> F.Column:
    return F.array_join(F.expr(f"slice({words}, {begin}, {length})"), " ")


def scored(counted: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, n, score, cut) of phrases of two words or more, each with its lowest-scoring cut, the first of equals.

    The score, 1000 * a * n / (l * r) without its fraction, is taken from decimals of 38
    digits, which hold the products of any counts below 10**12 and ``n`` below 10**18.
    """
    long = counted.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = long.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "words", "phrase", "a", "cut", _part("w", "1", "cut").alias("head"), _part("w", "cut + 1", "words - cut").alias("tail"))
    heads = counted.select(F.col("lang").alias("hl"), F.col("phrase").alias("head"), F.col("n").alias("l"), F.col("words").alias("hw")).where("hw > 0").drop("hw")
    tails = heads.select(F.col("hl").alias("tl"), F.col("head").alias("tail"), F.col("l").alias("r"))
    total = counted.where("words = 0").select(F.col("lang").alias("nl"), F.col("n").alias("total"))
    parts = cuts.join(heads.withColumnRenamed("head", "hp"), (F.col("lang") == F.col("hl")) & (F.col("head") == F.col("hp")))
    parts = parts.join(tails.withColumnRenamed("tail", "tp"), (F.col("lang") == F.col("tl")) & (F.col("tail") == F.col("tp"))).join(total, F.col("lang") == F.col("nl"))
    score = F.expr("cast((cast(1000 * a as decimal(19, 0)) * cast(total as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(18, 0))) as long)")
    best = parts.withColumn("score", score).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r", F.col("total").alias("n"))).alias("best"))
    return best.select("lang", "words", "phrase", "a", "best.l", "best.r", "best.n", "best.score", "best.cut")


def subsumed(counted: DataFrame) -> DataFrame:
    """(lang, phrase, f): the largest count of a longer phrase that contains ``phrase``, for each phrase of two words or more that some longer one contains."""
    w = counted.where("words >= 3").select("lang", "words", "n", F.split("phrase", " ").alias("w"))
    sizes = w.withColumn("size", F.explode(F.expr("sequence(2, words - 1)"))).withColumn("begin", F.explode(F.expr("sequence(1, words - size + 1)")))
    return sizes.select("lang", _part("w", "begin", "size").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("f"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 100, cells: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score, count and phrase.

    A phrase goes if a longer one that contains it has ``share`` hundredths of its count or
    more. ``docs`` has ``text`` and ``lang``; a null text is empty, a null language ``und``;
    other columns are left out, so none can clash. Repeated rows count each time. Texts
    of any length are counted whole, empty tables give no rows, ties go to the smaller phrase.
    """
    counted = scratch.table(counts(docs, least, cells), "phrases", kept=True)
    kept = scored(counted).join(subsumed(counted), ["lang", "phrase"], "left").where(F.col("f").isNull() | (100 * F.col("f") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    # SHARES * top rows of a language at most.
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
