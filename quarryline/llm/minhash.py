"""Near-duplicate texts: banded SetSketch registers propose, a joint likelihood estimate
filters, full shingle sets confirm, connected components group.

A group of g near copies has g*g/2 pairs, so pairs are never listed for a whole group.
First every text meets one partner, a leader of its buckets. Confirmed links are joined
into components. Only texts whose buckets still hold several components are then
compared with all they share a bucket with, in blocks, and only across components:
pairs inside one can't change the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import layout, scratch, setsketch, shingles
from quarryline.llm.batches import pieces
from quarryline.llm.components import components

#: 32 bands of 4 registers: a pair at 0.75 shares no band in 5 of a million cases.
BAND = 4
BANDS = setsketch.REGISTERS // BAND
#: Pairs estimated below this are dropped before the full sets are compared (four standard errors).
LEAST_ESTIMATE = 0.59
#: Most texts on either side of a block of comparisons.
BLOCK = 512
#: Texts whose sets are made at once in a block.
ROWS = 400


def _sketched(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, node, n_shingles, regs); equal texts share ``node``, a 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingles.sets(batch.column(2), width)
            regs = setsketch.registers(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "node", "n_shingles", "regs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, n_shingles long, regs binary")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers make a similarity of ``LEAST_ESTIMATE`` or more the likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(part.num_rows, -1) for k in (2, 3))
                n_x, n_y = (part.column(k).to_numpy().astype(float) for k in (4, 5))
                likely = setsketch.estimate((x > y).sum(-1), (x < y).sum(-1), n_x, n_y)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(likely >= LEAST_ESTIMATE))

    side = lambda x: sketches.select(F.col("node").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * common >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text_a", "text_b"):
            a, b = batch.column(0), batch.column(1)
            # b repeats (it leads a bucket): its set is made once in a piece.
            b_first = {n: i for i, n in reversed(list(enumerate(b.to_pylist())))}
            sets_a = shingles.sets(batch.column(2), width)
            sets_b = dict(zip(b_first, shingles.sets(batch.column(3).take(pa.array(list(b_first.values()), pa.int64())), width), strict=True))
            ok = [_similar(x, sets_b[n], percent) for x, n in zip(sets_a, b.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _join_block(group: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between components found in a block: ``some`` rows against all others.

    Pairs go from the likeliest down; a pair whose components a link has joined
    meanwhile is passed over, so at most one link less than there are components results.
    """
    some, n = group.column("some").to_numpy(), group.column("n_shingles").to_numpy().astype(float)
    node, comp = group.column("node").to_numpy(), group.column("comp").to_numpy()
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(len(node), -1)
    x_all, y_all = np.flatnonzero(some), np.flatnonzero(~some)
    cut = setsketch.REGISTERS * LEAST_ESTIMATE * 0.8
    pairs = []
    for i in range(0, len(x_all), 32):
        part = x_all[i : i + 32]
        equal = (regs[part, None, :] == regs[None, y_all, :]).sum(-1)
        p, q = np.nonzero((equal >= cut) & (comp[part, None] != comp[None, y_all]))
        p, q = part[p], y_all[q]
        above, below = ((f(regs[p], regs[q])).sum(-1) for f in (np.greater, np.less))
        likely = setsketch.estimate(above, below, n[p], n[q])
        pairs.append(np.stack((likely, p, q), axis=1)[likely >= LEAST_ESTIMATE])
    pairs = np.concatenate(pairs) if pairs else np.empty((0, 3))
    pairs = pairs[np.argsort(-pairs[:, 0], kind="stable")]
    used, sets = np.unique(pairs[:, 1:].astype(np.int64)), {}
    for i in range(0, len(used), ROWS):
        part = used[i : i + ROWS]
        sets.update(zip(part.tolist(), shingles.sets(group.column("text").take(pa.array(part)).combine_chunks(), width), strict=True))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    links = []
    for _, p, q in pairs.tolist():
        p, q = int(p), int(q)
        c, d = find(comp[p]), find(comp[q])
        if c != d and _similar(sets[p], sets[q], percent):
            root[max(c, d)] = min(c, d)
            links.append((node[p], node[q]))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _across(members: DataFrame, sketches: DataFrame, texts: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the components that ``links`` leaves, among texts that share a bucket.

    A bucket with several components has a major one. The texts of all buckets with one
    major component are compared together, once however many buckets they share: those
    outside it with each other and with those inside, in blocks.
    """
    found = scratch.table(components(links), "near-found")
    placed = scratch.table(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "near-placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count("*").alias("parts")).where("parts > 1")
    mixed = scratch.table(mixed.select("key", "major"), "near-mixed")
    seen = scratch.table(placed.join(mixed, "key").select("major", "node", "comp").distinct(), "near-seen")
    sizes = seen.groupBy("major").agg(F.count("*").alias("all"), F.count_if(F.col("comp") != F.col("major")).alias("some"))
    sizes = scratch.table(sizes.select("major", F.ceil(F.col("some") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("cols")), "near-sizes")
    seat = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    as_all = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda u: F.struct(u.alias("u"), seat("cols").alias("v"), F.lit(False).alias("some")))
    as_some = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda v: F.struct(seat("rows").alias("u"), v.alias("v"), F.lit(True).alias("some")))
    seated = seen.join(sizes, "major").withColumn("at", F.explode(F.when(F.col("comp") == F.col("major"), as_all).otherwise(F.concat(as_all, as_some))))
    dealt = seated.select("major", "at.u", "at.v", "at.some", "node", "comp").join(sketches, "node").join(texts, "node")
    # A group is one block: about BLOCK texts on either side, since seats are hashed.
    return dealt.groupBy("major", "u", "v").applyInArrow(lambda group: _join_block(group, width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Texts link when 100 * common >= ``percent`` * union of their sets of distinct
    ``width``-word shingles, counted on the full sets; ``component_id`` is the smallest
    doc_id reachable by links and ``kept`` marks the row that bears it.

    Null, empty and wordless texts have no shingles and link with nothing, each its own
    component. Equal texts always link. A null doc_id takes part by its text, is never
    kept, and its component is null where no other id is reachable. Rows equal in id and
    text are all kept or all not. An empty table gives an empty result. Other columns
    are ignored.
    """
    return _with_nodes(docs, percent, width, doc_id, text).drop("node")


def _with_nodes(docs: DataFrame, percent: int, width: int, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with ``node``, the hash of the row's text."""
    with scratch.passing(docs.sparkSession):
        named, least = _named(docs, percent, width, doc_id, text)
    return named.join(least, "group", "left").select(
        "doc_id", "node", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _named(docs: DataFrame, percent: int, width: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_shingles, group) of each row and (group, component_id), two kept tables."""
    rows = scratch.table(_sketched(docs, doc_id, text, width), "near-rows")
    sketches = scratch.table(rows.where("n_shingles > 0").select("node", "n_shingles", "regs").dropDuplicates(["node"]), "near-sketches")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * BAND * i + 1, 2 * BAND)) for i in range(BANDS)])
    bands = sketches.select("node", F.explode(keys).alias("key"))
    buckets = scratch.table(bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n"), "near-buckets")
    members = scratch.table(bands.join(buckets, "key").select("key", "node", "n"), "near-members")
    best = scratch.table(_likely(_partners(members), sketches), "near-best")
    texts = _texts_of(docs, rows, members, doc_id, text)
    links = scratch.table(_confirmed(best, texts, width, percent), "near-links")
    links = links.union(_across(members.select("key", "node"), sketches, texts, links, width, percent))
    found = scratch.table(components(scratch.table(links, "near-links")), "near-found")
    named = scratch.table(rows.join(found, "node", "left").select("doc_id", "node", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("group")), "near-named", kept=True)
    return named, scratch.table(named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id")), "near-least", kept=True)


def _partners(members: DataFrame) -> DataFrame:
    """(a, b): for each text the one partner it meets first.

    A bucket is led by its text with the most company over all buckets, such as the text
    that the others were copied from; a text's partner is the leader it shares most
    buckets with.
    """
    company = scratch.table(members.groupBy("node").agg(F.sum("n").alias("company")), "near-company")
    known = members.join(company, "node")
    leaders = scratch.table(known.groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("leader")), "near-leaders")
    shared = members.join(leaders, "key").where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    return shared.groupBy("node").agg(F.max_by("leader", F.struct("n", "leader")).alias("b")).select(F.col("node").alias("a"), "b")


def _texts_of(docs: DataFrame, rows: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, text), once for each member of a bucket: read from its row with the smallest id."""
    wanted = members.select("node").distinct()
    first = scratch.table(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("__id")).select(F.col("node").alias("__node"), "__id"), "near-wanted")
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), F.col(text).alias("text"))
    hit = layout.thinned(own, "node", wanted).join(first, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return scratch.table(hit.select("node", "text").dropDuplicates(["node"]), "near-texts")


def keep_first(docs: DataFrame, percent: int = 75, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has a near duplicate of a smaller doc_id in its component.

    Rows without a doc_id stay. Of rows equal in id and text all stay or all go; rows of
    one id and different texts are judged each by its text.
    """
    found = _with_nodes(docs, percent, width, doc_id, text)
    gone = found.where("doc_id is not null and not kept").select(F.col("doc_id").alias("__gone"), F.col("node").alias("__node")).distinct()
    return docs.join(gone, (F.col(doc_id) == F.col("__gone")) & (F.xxhash64(text) == F.col("__node")), "left_anti")
