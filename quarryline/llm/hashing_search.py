"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A code is cut into substrings and each substring is an index of its own. By the pigeonhole
principle every code within ``radius`` bits of a query's agrees with it in one substring
up to ``reach`` bits, or in one of the first ``further`` substrings up to a bit more, so
looking up the few substring values that near finds all of them, and many farther ones.
Codes and probes meet by a join on (substring, value); what is found up to ``wide`` bits
off is ranked by exact products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import scratch, vectors

#: About the bits of a code, and the least and most bits of a substring; between these an index value has about ``BUCKET`` rows.
BITS, LEAST_SUB, MOST_SUB, BUCKET = 512, 10, 24, 64
#: Substrings that are indexed: as many for any number of vectors, so the index grows as they do.
INDEXED = 20
#: Most bits of reach with these; where more would be needed, all substrings are indexed.
MOST_REACH = 3
#: Queries whose true neighbours set the radius and the width, and the parts of these that each must keep.
TRIALS, REACHED, WITHIN = 256, 0.98, 0.97
#: Vectors and queries of a block where queries with too few finds are compared with everything.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Most vectors that the rotations are learned from.
LEARNED = 4096


@dataclass(frozen=True)
class Model:
    """Codes are the signs of (lifted x - centre) @ rotation, cut into ``m`` substrings of ``sub`` bits.

    ``turns`` has (centre, rotation) for each length of vectors that was learned; other
    lengths take a seeded random rotation. The first ``used`` substrings are indexed;
    ``reach`` is the bits in which a probed value may differ, one more in the first
    ``further`` substrings; ``wide`` is the bits in which a whole code may.
    """

    longest: float
    sub: int
    turns: dict[int, tuple[np.ndarray, np.ndarray]]
    reach: int = 0
    wide: int = BITS
    used: int = BITS
    further: int = 0

    @property
    def m(self) -> int:
        return BITS // self.sub

    @property
    def radius(self) -> int:
        """Every code at most so many bits off in the indexed substrings is found: one of these is within its reach."""
        return self.used * (self.reach + 1) + self.further - 1

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """The m substring values of each lifted row's code."""
        centre, rotation = self.turns.get(x.shape[1] - 1) or (np.zeros(x.shape[1]), random_turn(x.shape[1], self.m * self.sub))
        bits = ((x - centre) @ rotation > 0).reshape(len(x), self.m, self.sub)
        return bits @ (1 << np.arange(self.sub, dtype=np.int64))

    def index(self, x: np.ndarray) -> np.ndarray:
        return self.substrings(lifted(x, self.longest))

    def query(self, q: np.ndarray) -> np.ndarray:
        return self.substrings(np.hstack((vectors.unit(q), np.zeros((len(q), 1)))))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows of one length whose cosines with (q, 0) are in the order of the products with q."""
    rest = np.sqrt(np.maximum(0.0, 1 - ((x / longest) ** 2).sum(axis=1, keepdims=True)))
    return np.hstack((x / longest, rest))


def turn(d: int, bits: int, learn: np.ndarray | None = None, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Stacked rotations of ``d`` dimensions for ``bits`` bits, each learned by iterative quantisation: signs, then the best rotation onto them."""
    rng, parts = np.random.default_rng(seed), []
    for _ in range(-(-bits // d)):
        part = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if learn is not None else 0):
            u, _, v = np.linalg.svd(learn.T @ np.where(learn @ part > 0, 1.0, -1.0))
            part = u @ v
        parts.append(part)
    return np.hstack(parts)[:, :bits]


@cache
def random_turn(d: int, bits: int) -> np.ndarray:
    return turn(d, bits)


def fit(sample: dict[int, np.ndarray], longest: float, rows: int) -> Model:
    """A model of ``rows`` vectors, its rotations learned from a sample by length; radius and width are set by ``tried``."""
    sub = min(MOST_SUB, max(LEAST_SUB, round(math.log2(max(1, rows / BUCKET)))))
    turns = {}
    for d, x in sample.items():
        z = lifted(x, longest)
        centre = z.mean(axis=0)
        turns[d] = (centre, turn(d + 1, BITS // sub * sub, (z - centre)[:LEARNED]))
    return Model(longest, sub, turns, used=BITS // sub)


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows the differing bits of each substring."""
    return np.bitwise_count((a ^ b).astype(np.uint64)).astype(np.int64)


def tried(model: Model, queries: np.ndarray, found: np.ndarray, rows: int | None = None) -> Model:
    """The model with the least radius of ``INDEXED`` substrings that finds ``REACHED`` of true pairs (query, neighbour), and the width that holds ``WITHIN`` of them.

    A larger radius probes all values of a smaller one and more, so the least one costs
    least, for any number of rows: ``rows`` has no effect.
    """
    if not len(queries):
        return model
    apart = bits_between(model.query(queries), model.index(found))
    wide, used = int(np.quantile(apart.sum(axis=1), WITHIN, method="higher")), min(INDEXED, model.m)
    # A pair is found from the first (reach, further) on that has one of its substrings: substring j is probed up to a bit more once further > j.
    least = np.where(apart > 0, (apart - 1) * used + np.arange(model.m) + 1, 0)[:, :used].min(axis=1)
    reach, further = divmod(int(np.quantile(least, REACHED, method="higher")), used)
    if reach + (further > 0) <= MOST_REACH:
        return replace(model, reach=reach, wide=wide, used=used, further=further)
    # Neighbours as far as others: the least reach that all substrings allow.
    return replace(model, reach=int(np.quantile(apart.min(axis=1), REACHED, method="higher")), wide=wide, used=model.m, further=0)


def ball(radius: int, bits: int) -> list[int]:
    """Every number of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(bits), n)]


def _per_word(model: Model) -> int:
    """Substrings of a long that holds parts of a code."""
    return 63 // model.sub


def _coded(df: DataFrame, model: Model, name: str, asked: bool) -> DataFrame:
    """(name, d, name0, name1, ...): each vector's length and its code in longs of ``_per_word`` substrings."""
    held, per, m, sub = df.sparkSession.sparkContext.broadcast(model), _per_word(model), model.m, model.sub
    words = -(-m // per)
    names = [name, f"{name}_d", *[f"{name}{i}" for i in range(words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                for d, rows in vectors.by_length(batch.column(1)).items():
                    part = batch.take(pa.array(rows))
                    x = vectors.matrix(part.column(1))
                    value = held.value.query(x) if asked else held.value.index(x)
                    packed = np.zeros((len(x), words), np.int64)
                    for j in range(m):
                        packed[:, j // per] |= value[:, j] << (j % per * sub)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(x), d, np.int32)), *map(pa.array, packed.T)], names)

    return df.select("rep", "v").mapInArrow(run, ", ".join(f"{n} {'int' if n.endswith('_d') else 'long'}" for n in names))


def _values(model: Model, name: str) -> list[Column]:
    """The substring values of a coded row."""
    per, mask = _per_word(model), F.lit((1 << model.sub) - 1).cast("long")
    return [F.shiftright(F.col(f"{name}{j // per}"), j % per * model.sub).bitwiseAND(mask) for j in range(model.used)]


def _keyed(coded: DataFrame, model: Model, name: str, probes: bool) -> DataFrame:
    """The coded rows once for each substring (and, as ``probes``, each value within reach of it) with ``name_key`` of length, substring and value."""
    key = lambda j, value: (F.col(f"{name}_d").cast("long") * BITS + j) * (1 << MOST_SUB) + value
    out = coded.select("*", F.posexplode(F.array(*[key(j, v) for j, v in enumerate(_values(model, name))])).alias("__j", f"{name}_key"))
    if probes and (model.reach or model.further):
        # Constant arrays; the value stands in the key's lowest bits.
        near, more = (F.split(F.lit(",".join(map(str, ball(reach, model.sub)))), ",").cast("array<long>") for reach in (model.reach, model.reach + 1))
        out = out.withColumn("__near", F.explode(F.when(F.col("__j") < model.further, more).otherwise(near)) if model.further else F.explode(near))
        out = out.withColumn(f"{name}_key", F.col(f"{name}_key").bitwiseXOR(F.col("__near"))).drop("__near")
    return out.drop("__j")


def _met(index: DataFrame, queries: DataFrame, model: Model) -> DataFrame:
    """(q, i): the pairs that a probe finds, at most ``wide`` bits apart, each once: by the first substring that finds it."""
    per, words = _per_word(model), -(-model.m // _per_word(model))
    differ = [F.col(f"q{w}").bitwiseXOR(F.col(f"i{w}")) for w in range(words)]
    mask = F.lit((1 << model.sub) - 1).cast("long")
    mine = (F.shiftright(F.col("i_key"), MOST_SUB) - F.col("i_d").cast("long") * BITS).cast("int")
    # A lambda, looked at for pairs that are near enough only: written out for each substring, the condition is too long to be compiled.
    part = lambda all_, j: F.bit_count(F.call_function("shiftright", F.get(all_, F.floor(j / per).cast("int")), F.pmod(j, F.lit(per)) * model.sub).bitwiseAND(mask))
    later = F.exists(F.array(*[F.struct(F.array(*differ).alias("all"), mine.alias("mine"))]), lambda v: F.exists(F.sequence(F.lit(0), v["mine"]), lambda j: (j < v["mine"]) & (part(v["all"], j) <= model.reach + (j < model.further).cast("int"))))
    on = (F.col("q_key") == F.col("i_key")) & (reduce(add, map(F.bit_count, differ)) <= model.wide) & ~later
    # Neither side may be broadcast: both are many times the tables that they come from.
    return _keyed(queries, model, "q", True).hint("merge").join(_keyed(index, model, "i", False), on).select("q", "i")


def _scored(pairs: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, i, score): exact products in double precision of the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                for rows in vectors.by_length(batch.column(2)).values():
                    part = batch.take(pa.array(rows))
                    # One product at a time in a fixed order: equal vectors get equal scores.
                    score = (vectors.matrix(part.column(2)) * vectors.matrix(part.column(3))).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score)], ["q", "i", "score"])

    both = pairs.join(index.select(F.col("rep").alias("i"), F.col("v").alias("i_v")), "i").join(queries.select(F.col("rep").alias("q"), F.col("v").alias("q_v")), "q")
    return both.select("q", "i", "i_v", "q_v").mapInArrow(run, "q long, i long, score double")


def _top(df: DataFrame, by: str, score: str, item: str, k: int) -> DataFrame:
    """The ``k`` rows of each ``by`` with the largest scores, ties to the smaller item, with ``rank``; tasks cut before they shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _compared(index: DataFrame, queries: DataFrame, rows: int, asked: int, k: int) -> DataFrame:
    """(q, i, score): for each query the k largest products of each block of the index, compared one and all, block by block."""
    pack = lambda t, name, blocks: t.groupBy(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(blocks)).cast("int").alias(name), F.size("v").alias("d")).agg(F.collect_list(F.struct("rep", "v")).alias(f"{name}_rows"))
    blocks, query_blocks = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    met = pack(queries, "q", query_blocks).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(pack(index, "i", blocks), ["i", "d"])

    def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        items = column.flatten()
        return items.field("rep").to_numpy(), vectors.matrix(items.field("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q = side(batch.column(0).slice(r, 1))
                ids, x = side(batch.column(1).slice(r, 1))
                got = []
                for one, rough in zip(q, q @ x.T, strict=True):
                    # The matrix product leaves out what is clearly lower; exact products are made one at a time.
                    least = np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
                    near = np.flatnonzero(rough >= least - 1e-9 * np.abs(rough).max())
                    score = (x[near] * one).sum(axis=1)
                    best = np.lexsort((ids[near], -score))[:k]
                    got.append((ids[near][best], score[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(s) for _, s in got])), *(pa.array(np.concatenate([g[n] for g in got])) for n in range(2))], ["q", "i", "score"])

    return met.select("q_rows", "i_rows").mapInArrow(run, "q long, i long, score double")


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    good = df.where(vectors.finite(vector) & F.col(vec_id).isNotNull())
    return good.select(F.col(vec_id).cast("long").alias("id"), F.xxhash64(vector).alias("node"), F.col(vector).alias("v")).distinct()


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows of ``df`` that were found, by largest inner product.

    ``queries`` has the same columns; a query's own id isn't among its results. Scores
    are products in double precision of the original vectors; ranks count from 1, ties
    to the smaller vec_id. All candidates are returned where there are fewer than k.

    Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, nor do rows without id; others meet those of their own length. Rows equal in id
    and vector count once; an id with several vectors is a candidate, and asks, by each,
    and its queries may get fewer than k. Empty tables give an empty result; other columns
    are ignored. The model is fitted on at most ``vectors.MAX_SAMPLE`` vectors and tried
    on the true neighbours of ``TRIALS`` queries; every row is indexed. A query for which
    probing finds fewer than k is compared with every row.
    """
    with scratch.passing(df.sparkSession):
        asked, best = _best(df, queries, k, vec_id, vector)
    mine = asked.join(best, F.col("rep") == F.col("q")).where(F.col("id") != F.col("found")).select(F.col("id").alias("query_id"), F.col("found").alias("vec_id"), "score").distinct()
    return _top(mine, "query_id", "score", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def model_of(reps: DataFrame, asked: DataFrame, k: int) -> Model:
    """The model for the distinct vectors ``reps`` (rep, v) and the queries ``asked`` (rep, v), tried on some queries' true neighbours."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    stats = reps.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    model = fit(vectors.sample(reps, "v", stats["n"]), stats["longest"], stats["n"])
    # At most TRIALS queries and k neighbours of each come to the driver.
    trials = scratch.table(asked.orderBy(F.xxhash64("rep"), "rep").limit(TRIALS), "search-trials")
    true = _top(_compared(reps, trials, stats["n"], TRIALS, k + 1), "q", "score", "i", k + 1).where("q <> i")
    pairs = true.join(trials.select(F.col("rep").alias("q"), F.col("v").alias("q_v")), "q").join(reps.select(F.col("rep").alias("i"), F.col("v").alias("i_v")), "i").select("q_v", "i_v").toArrow()
    q, found = (pairs.column(c).combine_chunks() for c in ("q_v", "i_v"))
    usual = max(vectors.by_length(q).values(), key=len, default=np.empty(0, np.int64))
    return tried(model, *(vectors.matrix(c.take(pa.array(usual))) for c in (q, found)))


def _best(df: DataFrame, queries: DataFrame, k: int, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rep, id) of every query, and (q, found, score), the k + 1 nearest ids of each distinct query vector: two kept tables."""
    # Of equal vectors only the k + 1 smallest ids can be among k results; the smallest stands for all.
    same = Window.partitionBy("node", "v").orderBy("id")
    alike = _usable(df, vec_id, vector).withColumn("at", F.row_number().over(same)).where(F.col("at") <= k + 1)
    reps = scratch.table(alike.where("at = 1").select(F.col("id").alias("rep"), "node", "v"), "search-reps")
    of_reps = scratch.table(alike.join(reps.select("rep", "node", F.col("v").alias("__v")), "node").where(F.col("v") == F.col("__v")).select("rep", F.col("id").alias("found")), "search-alike")
    asking = _usable(queries, vec_id, vector)
    first = scratch.table(asking.groupBy("node", "v").agg(F.min("id").alias("rep")), "search-asking")
    asked = scratch.table(asking.join(first.select("rep", "node", F.col("v").alias("__v")), "node").where(F.col("v") == F.col("__v")).select("rep", "id"), "search-asked", kept=True)
    if first.isEmpty() or reps.isEmpty():
        return asked, scratch.table(df.sparkSession.createDataFrame([], "q long, found long, score double"), "search-best", kept=True)
    model = model_of(reps, first.select("rep", "v"), k)
    index = scratch.table(_coded(reps, model, "i", False), "search-codes")
    met = _met(index, scratch.table(_coded(first, model, "q", True), "search-queries"), model)
    scored = _top(_scored(scratch.table(met, "search-pairs"), reps, first), "q", "score", "i", k + 1).drop("rank")
    expand = lambda t: _top(t.join(of_reps.withColumnRenamed("rep", "i"), "i").select("q", "found", "score"), "q", "score", "found", k + 1)
    best = scratch.table(expand(scored).select("q", "found", "score"), "search-best", kept=True)
    few = first.join(best.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > k), F.col("rep") == F.col("q"), "left_anti")
    short = scratch.table(few, "search-short")
    if short.isEmpty():
        return asked, best
    rest = _top(_compared(reps, short, reps.count(), short.count(), k + 1), "q", "score", "i", k + 1).drop("rank")
    others = best.join(short.select(F.col("rep").alias("q")), "q", "left_anti")
    return asked, scratch.table(others.unionByName(expand(rest).select("q", "found", "score")), "search-all", kept=True)
