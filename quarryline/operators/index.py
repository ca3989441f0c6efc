"""Incremental indexing: which chunks are new, their vectors, and the keyed append."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import ordering

MAX_INPUT_BYTES = 24_576
BATCH = 16
Embedder = Callable[[list[str]], list[list[float]]]


def new_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose hash isn't stored yet, each hash once."""
    return chunks.join(store.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])


def stored_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    return chunks.join(store.select("content_hash"), "content_hash", "left_semi")


def upserted(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """The store after an insert-if-absent; nothing is deleted, so chunks of removed files stay."""
    return store.unionByName(new_chunks(chunks, store).select(*store.columns))


def embed_input(text: Column) -> Column:
    """What a model is given: the first ``MAX_INPUT_BYTES`` bytes."""
    return X.cut_bytes(text, MAX_INPUT_BYTES)


def batches(chunks: DataFrame, size: int = BATCH, key: str = "rel_path", order: tuple[str, ...] = ("line_start", "content_hash")) -> DataFrame:
    """Adds ``batch`` and ``place`` (long): consecutive rows of all chunks, by path and line, ``size`` to a batch."""
    if size < 1:
        raise ValueError("a batch needs at least one row")
    n = F.col("__n") - 1
    numbered = ordering.running(chunks, key, list(order), F.lit(1), "__n")
    return numbered.withColumns({"batch": F.floor(n / size).cast("long"), "place": (n % size).cast("long")}).drop("__n")


def hashing_embedder(dim: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed hashed counts of words, scaled to length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).tolist()

    return embed


def _model_batches(parts: Iterator[pa.RecordBatch], batch: int) -> Iterator[pa.RecordBatch]:
    """The rows again, one model batch at a time: those of one number in ``batch`` if there is that column, else ``batch`` rows that follow each other."""
    held: list[pa.RecordBatch] = []
    now, seen = None, 0
    for part in parts:
        if "batch" in part.schema.names:
            numbers = part.column("batch").to_numpy(zero_copy_only=False)
        else:
            numbers, seen = np.arange(seen, seen + part.num_rows) // batch, seen + part.num_rows
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), part.num_rows]
        for at, to in zip(cuts, cuts[1:]):
            if at == to:
                continue
            if held and numbers[at] != now:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = numbers[at]
            held.append(part.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def embed(chunks: DataFrame, embedder: Embedder, batch: int = BATCH, text: str = "content_text") -> DataFrame:
    """Adds ``embedding``, ``status`` ("embedded" or "failed") and ``error``.

    Texts go to the model in the batches that ``batches`` has numbered, wherever its
    columns are there, and else in runs of ``batch`` rows. Where a batch fails or returns another
    number of vectors, its texts are tried one by one, and only those that fail alone
    are marked.
    """
    if batch < 1:
        raise ValueError("a batch needs at least one row")
    if {"batch", "place"} <= set(chunks.columns):
        chunks = chunks.repartition("batch").sortWithinPartitions("batch", "place")
    rows = chunks.withColumn("__input", embed_input(F.col(text)))
    names = [f.name for f in chunks.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields), "embedding array<float>, status string, error string"])

    def one(texts: list[str]) -> list[list[float]]:
        got = embedder(texts)
        if len(got) != len(texts):
            raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
        return got

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _model_batches(parts, batch):
            inputs, vectors, errors = some.column("__input").to_pylist(), [], []
            try:
                vectors, errors = one(inputs), [None] * len(inputs)
            except Exception:  # a batch that fails is retried text by text
                for text_ in inputs:
                    try:
                        vectors += one([text_])
                        errors.append(None)
                    except Exception as e:
                        vectors.append(None)
                        errors.append(str(e))
            made = [pa.array(vectors, pa.list_(pa.float32())), pa.array(["failed" if e is not None else "embedded" for e in errors]), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), *made], [*names, "embedding", "status", "error"])

    return rows.mapInArrow(run, schema)


def index_counts(embedded: DataFrame) -> DataFrame:
    """(status, n)"""
    return embedded.groupBy("status").agg(F.count("*").alias("n"))
