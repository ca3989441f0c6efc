"""Vectors in array columns: which take part, and their numpy form inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most vectors that a model is fitted on; they are collected to the driver.
MAX_SAMPLE = 16_384


def finite(vector: str) -> Column:
    """True for vectors that aren't null, empty or zero and whose components are all finite numbers."""
    value = F.col(vector).cast("array<double>")
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(value, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from lists of one length."""
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so that squares can't vanish or overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-320)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> dict[int, np.ndarray]:
    """For each length of the lists the positions that have it."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return {int(d): np.flatnonzero(length == d) for d in np.unique(length)}


def sample(df: DataFrame, vector: str, rows: int, most: int = MAX_SAMPLE) -> dict[int, np.ndarray]:
    """By length, some of ``rows`` vectors, at most ``most``, chosen by a hash of their values.

    All are taken where there are no more than ``most``; else a tenth of the bound is left
    for the hash's scatter, so the bound itself doesn't choose.
    """
    part = 1.0 if rows <= most else 0.9 * most / rows
    chosen = F.pmod(F.xxhash64(vector, F.lit(5)), F.lit(10**9)) < F.lit(int(part * 10**9))
    got = df.where(chosen).select(F.col(vector).cast("array<double>").alias("v")).limit(most).toArrow().column("v").combine_chunks()
    return {d: matrix(got.take(pa.array(at))) for d, at in by_length(got).items()}
