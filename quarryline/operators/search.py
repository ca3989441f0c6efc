"""Exact top-k cosine search over stored vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X


def scored(store: DataFrame, query: list[float], k: int, key: str = "content_hash", vector: str = "embedding", norm: str | None = None) -> DataFrame:
    """(key, score): the ``k`` largest cosines with ``query``, ties to the smaller key.

    Only keys and vectors, and norms where a column has them, are read. A task scores a
    batch of vectors as one matrix and keeps ``k`` rows; sums of products run in the
    same order for each row, so equal vectors have equal scores wherever they lie.
    """
    length = math.sqrt(sum(x * x for x in query))
    kind = store.schema[key].dataType.simpleString()
    some = store.where((F.size(vector) == len(query)) & F.lit(length > 0 and k > 0)).select(key, vector, *([norm] if norm else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, wanted, kept = [], np.array(query, np.float64), None
        for b in batches:
            kept = b.schema.field(key).type
            rows = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(query))
            size = b.column(norm).to_numpy(zero_copy_only=False).astype(np.float64) if norm else np.sqrt((rows * rows).sum(axis=1))
            with np.errstate(all="ignore"):
                score = (rows * wanted).sum(axis=1) / (size * length)
            good = np.flatnonzero(np.isfinite(score) & (size > 0))
            if len(good) > k:
                good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
            keys = b.column(key).take(pa.array(good)).to_pylist()
            best = sorted([*best, *zip((-score[good]).tolist(), keys)])[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in best], kept), pa.array([-x[0] for x in best])], [key, "score"])

    return some.mapInArrow(run, f"`{key}` {kind}, score double").orderBy(F.desc("score"), key).limit(k)


def search(store: DataFrame, query: list[float], k: int = 10, languages: list[str] | None = None, key: str = "content_hash", vector: str = "embedding", language: str = "language", norm: str | None = None) -> DataFrame:
    """The ``k`` rows of the largest cosine with ``query``, with ``score`` and ``rank``; ties by ``key``, which no two rows share.

    Rows of another dimension, of length 0 or with numbers that aren't finite are passed
    over, and a query of length 0 finds nothing. An empty list of languages is no filter;
    names match exactly. The other columns are read for the ``k`` keys only, which the
    reader looks up.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    some = store.where(F.col(language).isin(*languages)) if languages else store
    found = scored(some, query, k, key, vector, norm).collect()  # k rows at most
    top = store.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(found, 1)], f"`{key}` {store.schema[key].dataType.simpleString()}, score double, rank int")
    rows = some.where(F.col(key).isin([r[0] for r in found])) if found else some.where(F.lit(False))
    return rows.join(F.broadcast(top), key).select(*store.columns, "score", "rank")


def rendered(results: DataFrame, prefix: str = "   ") -> DataFrame:
    """(rank, head, detail, body): what a terminal shows of each result."""
    return results.select(
        "rank",
        F.concat(F.col("rel_path"), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("head"),
        F.concat(F.lit("("), F.col("kind"), F.lit(" · "), F.col("language"), F.lit(" · score="), F.format_string("%.3f", F.col("score")), F.lit(")")).alias("detail"),
        X.indent(F.col("content_text"), prefix).alias("body"),
    )


def as_json(results: DataFrame, query: str, k: int) -> DataFrame:
    """One row ``json``: {query, k, results}, each result by the names that consumers know; in rank order, of which there are k at most."""
    names = {"chunkId": "content_hash", "relPath": "rel_path", "language": "language", "kind": "kind", "lineStart": "line_start", "lineEnd": "line_end", "score": "score", "content": "content_text"}
    item = F.struct(*[F.col(column).alias(name) for name, column in names.items()])
    ranked = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    return results.agg(F.to_json(F.struct(F.lit(query).alias("query"), F.lit(k).alias("k"), F.transform(ranked, lambda r: r["item"]).alias("results"))).alias("json"))
