"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer
network whose probabilities are calibrated by one temperature.

Fitting uses a bounded sample of labelled documents; scoring is one pass over all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import scratch
from quarryline.llm.batches import pieces

#: Word ids (hashed), vector length, non-zero entries of an index vector, neighbours on either side.
WORDS, SIZE, SPIKES, NEAR = 16_384, 64, 8, 2
#: Most labelled documents that the model is fitted on.
SAMPLE = 12_000
#: Documents with a score below this are rejected.
LEAST = 0.3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: The first ids are kept for a token's form; ids of words follow.
FORMS = 64
#: Tokens that a worker remembers, none of more characters than this (about 10 MB), and tokens whose vectors are held at once.
MAX_CACHE, MAX_LETTERS = 50_000, 64
STRETCH = 1 << 16


class _Ids(dict):
    """Token -> word id * FORMS + form."""

    def __missing__(self, token: str) -> int:
        if token.isalpha():
            form = 1 if token.islower() else 2 if token[1:].islower() else 3 if token.isupper() and len(token) > 1 else 4
            word = token.lower()
        elif token.isdigit():
            form, word = 5, "0" * min(len(token), 6)
        else:
            form, word = 8 + min(len(token), 4) + 5 * (zlib.crc32(token[:1].encode()) % 10), token[:4]
        out = (FORMS + zlib.crc32(word.encode()) % (WORDS - FORMS)) * FORMS + form
        if len(token) <= MAX_LETTERS:
            if len(self) >= MAX_CACHE:
                self.clear()
            self[token] = out
        return out


_ids = _Ids()


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, form ids and the number of tokens of each text. A word equal to the one before has form 6."""
    found = lambda t: TOKEN.findall(t) if len(t) <= STRETCH else (m[0] for m in TOKEN.finditer(t))
    lists = [np.fromiter(map(_ids.__getitem__, found(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    both = np.concatenate(lists) if lists else np.empty(0, np.int32)
    word, form = both // FORMS, both % FORMS
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (form[1:] < 8)
    form[again] = 6
    return word, form, counts


def index_vectors(seed: int = 3) -> np.ndarray:
    """A sparse row of plus and minus ones for each id."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS, SIZE), np.float32)
    for _ in range(SPIKES):
        out[np.arange(WORDS), rng.integers(0, SIZE, WORDS)] += rng.choice([-1.0, 1.0], WORDS)
    return out


def context_sums(texts: list[str | None], index: np.ndarray, into: np.ndarray) -> None:
    """Adds to each id's row of ``into`` the index vectors of its neighbours in the same text.

    Index vectors are whole numbers, so the sums in double precision are exact and the
    order of texts doesn't matter.
    """
    word, form, counts = tokens(texts)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    for at in range(0, len(word), STRETCH):
        to = min(at + STRETCH, len(word))
        low, high = max(0, at - NEAR), min(len(word), to + NEAR)
        mine, where = index[word[low:high]] + index[form[low:high]], text[low:high]
        near = np.zeros_like(mine)
        for d in range(1, NEAR + 1):
            same = where[d:] == where[:-d]
            near[d:][same] += mine[:-d][same]
            near[:-d][same] += mine[d:][same]
        near = near[at - low : to - low]
        for ids in (word[at:to], form[at:to]):
            order = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[order], prepend=-1))
            into[ids[order][first]] += np.add.reduceat(near[order], first)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """The mean word vector and the mean form vector of each text, side by side (no tokens: zeros).

    A text's sums depend on the text alone, whatever stands beside it: texts are taken
    together up to ``STRETCH`` tokens, longer ones alone and in stretches from their start.
    """
    word, form, counts = tokens(texts)
    out = np.zeros((len(texts), 2 * SIZE))
    ends = np.cumsum(counts)
    k = 0
    while k < len(texts):
        start = ends[k] - counts[k]
        to = max(k + 1, int(np.searchsorted(ends, start + STRETCH, "right")))
        some = np.arange(k, to)[counts[k:to] > 0]
        for ids, half in ((word, slice(0, SIZE)), (form, slice(SIZE, 2 * SIZE))):
            if to == k + 1:
                for at in range(start, ends[k], STRETCH):
                    out[k, half] += np.add.reduceat(vectors[ids[at : min(at + STRETCH, ends[k])]], [0])[0]
            elif len(some):
                out[some, half] = np.add.reduceat(vectors[ids[start : ends[to - 1]]], (ends - counts)[some] - start)
        k = to
    return (out / np.maximum(counts, 1)[:, None]).astype(np.float32)


@dataclass(frozen=True)
class Network:
    """Scores are sigmoid(logit / temperature); without labels of both kinds, always ``prior``."""

    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...] | None
    temperature: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.spread @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        z = self.logit(pooled(texts, self.vectors)) / self.temperature
        return 0.5 * (1 + np.tanh(z / 2))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, rounds: int = 400, seed: int = 5) -> Network:
    """Fits the layers by Adam on four fifths of the rows and the temperature on the rest."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(np.unique(y)) < 2 or len(y) < 10:
        return Network(vectors, np.zeros(1), np.ones(1), None, 1.0, prior)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit, rest = order[len(y) // 5 :], order[: len(y) // 5]
    mean, spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
    z = (x - mean) / spread
    w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, rounds + 1):
        some = fit if len(fit) <= 2048 else rng.choice(fit, 2048, replace=False)
        h = np.tanh(z[some] @ w[0] + w[1])
        p = 0.5 * (1 + np.tanh((h @ w[2] + w[3]) / 2))
        d = (p - y[some]) / len(some)
        back = d[:, None] * w[2] * (1 - h * h)
        grads = [z[some].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(vectors, mean, spread, tuple(w), 1.0, prior)
    logit, truth = net.logit(x[rest]), y[rest]
    heats = np.geomspace(0.25, 8, 61)
    loss = [np.logaddexp(0, np.where(truth > 0, -logit, logit) / t).mean() for t in heats]
    return Network(vectors, mean, spread, tuple(w), float(heats[int(np.argmin(loss))]), prior)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE) -> Network:
    """A network learned from at most ``rows`` labelled documents that aren't held out, chosen by a hash of the id.

    Labels are 0 or 1; null labels and labels of null ids count for nothing; of several
    labels of a document the smallest holds, of several texts the one of least hash. Null
    and empty texts take part as texts without words. Without labels of both kinds, or
    with fewer than ten, every score is the share of label 1 (0.5 without any label).
    Only texts are inputs; other columns are ignored. Equal input gives an equal network.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.min(target).cast("double").alias("y"))
    known = known.withColumn("__at", F.pmod(F.xxhash64(doc_id, F.lit(9)), F.lit(1_000_000)))
    count = known.count()
    # At most ``rows`` small rows are broadcast; a tenth of the bound is left for the hash's scatter.
    part = 1.0 if count <= rows else 0.9 * rows / count
    chosen = known.where(F.col("__at") < part * 1_000_000).limit(rows).select(F.col(doc_id).alias("__id"), "y")
    found = docs.select(F.col(doc_id).alias("__d"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("__d") == F.col("__id"))
    # One row an id, combined before it moves, so that a hot id can't swell the sample.
    alone = found.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("at"), "text", "y")).alias("row"))
    sample = scratch.table(alone.select("__id", "row.text", "row.y").repartition(16, "__id"), "quality-sample").select("text", "y")
    spark, index = docs.sparkSession, index_vectors()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((WORDS, SIZE))
        for batch in pieces(batches, "text"):
            context_sums(batch.column(0).to_pylist(), index, into)
        # The rows of words that were seen, in 16 parts.
        for part, rows in enumerate(into.reshape(16, -1, SIZE)):
            seen = np.flatnonzero(rows.any(axis=1)).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen.tobytes()]), pa.array([rows[seen].tobytes()])], ["part", "ids", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros((WORDS // 16, SIZE))
        for ids, rows in zip(group.column("ids").to_pylist(), group.column("sums").to_pylist(), strict=True):
            total[np.frombuffer(ids, "<i4")] += np.frombuffer(rows).reshape(-1, SIZE)
        return pa.table({"part": group.column("part").slice(0, 1).cast(pa.int32()), "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    # Fixed sizes: 16 parts of WORDS * SIZE numbers.
    made = sample.select("text").mapInArrow(sums, "part int, ids binary, sums binary").groupBy("part").applyInArrow(added, "part int, sums binary").collect()
    context = np.zeros((WORDS, SIZE), np.float32)
    for r in made:
        context.reshape(16, -1)[r["part"]] = np.frombuffer(r["sums"], np.float32)
    length = np.sqrt((context * context).sum(axis=1, keepdims=True))
    # A word that wasn't seen keeps its index vector.
    vectors = np.where(length > 0, context / np.maximum(length, 1e-9), index / np.sqrt(SPIKES)).astype(np.float32)
    held = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(pooled(part.column(0).to_pylist(), held.value)), pa.list_(pa.float32()))], ["y", "x"])

    got = sample.mapInArrow(features, "y double, x array<float>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, 2 * SIZE)
    y = np.array(got.column("y").to_pylist(), float)
    # A fixed order, whatever the order of arrival.
    order = np.lexsort((*x.T, y)) if len(y) else []
    return train(x[order], y[order], vectors)


def score(docs: DataFrame, model: Network, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with ``out``, the probability of label 1 (0 to 1).

    Whole texts are read. Null and empty texts have no words and all get the same score;
    equal texts get equal scores; an empty table stays empty; a column ``out`` is replaced.
    """
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rest.schema.fields)}, `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            texts = batch.column(text).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(texts), pa.float64())], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``least``.

    Null and empty texts get one score and all stay or all go; repeated rows are judged
    alike; an empty table stays empty; a column called ``__score`` is replaced.
    """
    scored = score(docs, fit(docs, labels, text=text), text=text, out="__score")
    return scored.where(F.col("__score") >= least).drop("__score")
