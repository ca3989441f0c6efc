"""Substring dedup: hash every run of several consecutive sentences, join globally, and
remove the sentences that a repeated run covers anywhere but at its first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import scratch
from quarryline.llm.batches import pieces
from quarryline.llm.shingles import PIECE, _powers, mixed, word_table

#: A run has at least two sentences and so many words.
RUN_WORDS = 24
#: A full stop after fewer words since the last one ends no sentence; longer sentences are cut.
LEAST_WORDS, MOST_WORDS = 3, 20
#: In a longer sentence, of so many neighbouring words that with the least hash ends a part.
CUT_WINDOW = 6
#: What ends a sentence: full stops, exclamation and question marks of several scripts.
STOPS = ".!?。！？।؟"
_BASE = 0xD6E8FEB86659FD93


def sentences(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """For each sentence of all texts: text number, first word, word after the last, first byte; then the words' hashes.

    A sentence ends with a line, or with a word that ends in one of ``STOPS`` at
    least ``LEAST_WORDS`` words after the previous such word. One of more than
    ``MOST_WORDS`` words is cut where its words say so, see ``_inner_cuts``; equal
    stretches in such sentences have equal cuts but for ``CUT_WINDOW`` words at
    their edges, whatever stands before them.
    """
    data, offsets, word, doc, start, end = word_table(texts)
    n = len(word)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, none, word
    k = np.arange(n)
    feeds = np.flatnonzero(data == 10)
    last = np.concatenate((doc[1:] != doc[:-1], [True]))
    line = last | (np.searchsorted(feeds, np.concatenate((start[1:], [len(data)]))) > np.searchsorted(feeds, end))
    stop = _stopped(data, start, end) | line
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(stop, k, -1))[:-1]))
    full = line | (stop & (k - before >= LEAST_WORDS))
    full |= _inner_cuts(word, full)
    stops = np.flatnonzero(full) + 1
    starts = np.concatenate(([0], stops[:-1]))
    return doc[starts], starts, stops, start[starts], word


def _stopped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word whether its last character is one of ``STOPS``."""
    out = np.zeros(len(end), bool)
    for mark in map(str.encode, STOPS):
        same = end - start >= len(mark)
        for k, byte in enumerate(mark):
            same &= data[np.maximum(end - (len(mark) - k), 0)] == byte
        out |= same
    return out


def _inner_cuts(word: np.ndarray, full: np.ndarray) -> np.ndarray:
    """For each word whether a part of a sentence of more than ``MOST_WORDS`` words ends with it.

    In each window of ``CUT_WINDOW`` words of the sentence the last one of least hash
    is chosen (winnowing), so parts have ``CUT_WINDOW`` words at most. Where chosen
    words stand closer than ``LEAST_WORDS``, every ``LEAST_WORDS``-th of them is taken:
    words that repeat all the time would make parts of one word.
    """
    n = len(word)
    out = np.zeros(n, bool)
    if n < CUT_WINDOW:
        return out
    ends = np.flatnonzero(full)
    size = np.diff(ends, prepend=-1)
    sentence = np.repeat(np.arange(len(ends)), size)
    at = np.flatnonzero(size[sentence] > MOST_WORDS)
    at = at[at + CUT_WINDOW <= n]
    at = at[sentence[at] == sentence[at + CUT_WINDOW - 1]]
    # The last word of a document ends a sentence, so no window spans two documents.
    rank, parts = mixed(word), []
    for low in range(0, len(at), PIECE):
        first = at[low : low + PIECE]
        least, where = rank[first], first.copy()
        for step in range(1, CUT_WINDOW):
            here = rank[first + step]
            lower = here <= least
            least, where = np.where(lower, here, least), np.where(lower, first + step, where)
        parts.append(np.unique(where))
    chosen = np.unique(np.concatenate(parts)) if parts else at
    if len(chosen):
        near = np.concatenate(([False], (np.diff(chosen) < LEAST_WORDS) & (np.diff(sentence[chosen]) == 0)))
        k = np.arange(len(chosen))
        chosen = chosen[(k - np.maximum.accumulate(np.where(near, 0, k))) % LEAST_WORDS == 0]
    out[chosen] = True
    return out


def runs(doc: np.ndarray, first: np.ndarray, after: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, last sentence): from each sentence on and up to each sentence, the shortest run of two or more with ``RUN_WORDS`` words."""
    n = len(doc)
    k = np.arange(n)
    to = np.maximum(k + 1, np.searchsorted(after, first + RUN_WORDS, "left"))
    ok = (to < n) & (doc[np.minimum(to, n - 1)] == doc) if n else k > 0
    back = np.minimum(k - 1, np.searchsorted(first, after - RUN_WORDS, "right") - 1)
    ok_back = (back >= 0) & (doc[np.maximum(back, 0)] == doc) if n else ok
    a, b = np.concatenate((k[ok], back[ok_back])), np.concatenate((to[ok], k[ok_back]))
    pairs = np.unique(a * n + b) if n else np.empty(0, np.int64)
    a, b = pairs // max(n, 1), pairs % max(n, 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * _powers(_BASE, len(word)))))
        turned = (sums[after[b]] - sums[first[a]]) * _powers(pow(_BASE, -1, 2**64), len(word) + 1)[first[a]]
        return mixed(turned + (after[b] - first[a]).astype(np.uint64)).view(np.int64), a, b


def _runs_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            doc, first, after, _, word = sentences(batch.column(2))
            key, a, b = runs(doc, first, after, word)
            text = doc[a] if len(a) else a
            base = np.searchsorted(doc, text)
            rows = batch.select([0, 1]).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(key), *rows.columns, pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], ["run", "doc_id", "tie", "a", "b"])

    return docs.mapInArrow(run, "run long, doc_id long, tie long, a int, b int")


def _cut(docs: DataFrame, fields: str) -> DataFrame:
    """Drops the covered sentences from ``text``; adds counts and the removed parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            names = batch.schema.names
            column = batch.column(names.index("__text"))
            doc, first, after, byte, _ = sentences(column)
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            text, count, gone, words, cut = [], [], [], [], []
            for i, (value, spans) in enumerate(zip(column.to_pylist(), batch.column(names.index("__spans")).to_pylist(), strict=True)):
                lo, hi = bounds[i], bounds[i + 1]
                drop = np.zeros(hi - lo, bool)
                for s in spans or []:
                    drop[s["a"] : s["b"] + 1] = True
                raw = None if value is None else value.encode()
                if drop.any():
                    edges = np.concatenate((byte[lo:hi] - byte[lo], [0]))
                    head = len(raw) - len(raw.lstrip(b" \t\n\v\f\r"))
                    edges = edges + head
                    edges[-1] = len(raw)
                    left = [raw[:head] if not drop[0] else b""] + [raw[edges[j] : edges[j + 1]] for j in np.flatnonzero(~drop)]
                    cut.append([raw[edges[j] : edges[j + 1]].decode().strip() for j in np.flatnonzero(drop)])
                    value = b"".join(left).decode()
                else:
                    cut.append([])
                text.append(value)
                count.append(hi - lo)
                gone.append(int(drop.sum()))
                words.append(int((after[lo:hi] - first[lo:hi])[drop].sum()))
            kept = [c for n, c in zip(names, batch.columns, strict=True) if n not in ("__text", "__spans")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), pa.array(words, pa.int64()), pa.array(cut, pa.list_(pa.string())), pa.array(text, pa.string())],
                [*(n for n in names if n not in ("__text", "__spans")), "n_sentences", "n_removed", "removed_words", "removed", "text"],
            )

    return docs.mapInArrow(run, fields)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text without repeated passages, and ``n_sentences``, ``n_removed``, ``removed_words``, ``removed``.

    A run of two or more sentences with ``RUN_WORDS`` words or more that occurs at
    several places stays only at the first, by (doc_id, position); runs may overlap and
    may repeat inside one text. Words are compared, A-Z lower-cased, white space isn't.

    Null, empty and wordless texts stay as they are. Rows without doc_id come after all
    others in order. Rows equal in id and text count as one place and get one result. A
    text of which all is repeated becomes empty. An empty table stays empty. Added
    columns replace those of the same name.
    """
    added = ("n_sentences", "n_removed", "removed_words", "removed")
    rows = docs.drop(*added).withColumns({"__id": F.col(doc_id).cast("long"), "__tie": F.xxhash64(text), "__text": F.col(text)})
    found = scratch.table(_runs_of(rows.select("__id", "__tie", F.col("__text").alias("text"))), "runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "a")
    firsts = scratch.table(found.groupBy("run").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi or (lo.doc_id is null) <> (hi.doc_id is null)").select("run", "lo"), "run-firsts")
    later = found.join(firsts, "run").where(~(F.col("doc_id").eqNullSafe(F.col("lo.doc_id")) & (F.col("tie") == F.col("lo.tie")) & (F.col("a") == F.col("lo.a"))))
    spans = scratch.table(later.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("a", "b")).alias("__spans")).select(F.col("doc_id").alias("__d"), F.col("tie").alias("__t"), "__spans"), "run-spans")
    joined = rows.drop(text).join(spans, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__tie") == F.col("__t")), "left").drop("__id", "__tie", "__d", "__t")
    kept = [f for f in joined.schema.fields if f.name not in ("__text", "__spans")]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_sentences long, n_removed long, removed_words long, removed array<string>, text string"])
    out = _cut(joined, fields)
    return out.withColumnRenamed("text", text) if text != "text" else out
