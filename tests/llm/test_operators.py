"""The training-data operators against brute force, on a small table and on odd rows."""

from __future__ import annotations

import dataclasses
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarryline.llm import bpe, catalog, embedding_dedup, hashing_search, line_dedup, minhash, mixing, quality, secretscan, setsketch, sharding, shingles, substring_dedup
from quarryline.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = "Was it so? " + " ".join(f"word{i} and{i % 7}" for i in range(9000)) + ".\n" + "z" * 3000
ODD = [
    (1, "One two three four five six.\nOne two three four five six seven.", "en", "a", 10), (1, "One two three four five six.\nOne two three four five six seven.", "en", "a", 10),
    (2, "", "en", "a", 0), (3, None, "en", None, None), (None, "no id here at all, none", None, "b", 3), (4, " \n\t ", "de", "b", 4), (5, LONG, "de", "é", len(LONG)),
    (6, "One two three four five six.\nOne two three four five six seven.", None, "a", 10), (7, "a", "en", "a", 1), (8, "same line that is quite long here\nsame line that is quite long here", "en", "a", 5),
    (9, "same line that is quite long hexe\nother", "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("size", "shard", "slot", "node", "key", "h", "n", "a", "b", "y", "pos", "line", "round", "ids", "score", "pieces", "target", "taken", "findings", "tie", "run", "vector", "component", "doc")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def shingle_set(text):
    w = re.findall(WORD, low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# 1


def test_sharding(spark, sf, rows):
    got = catalog.op1_histogram_sort(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]].encode())
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    share, largest = sum(r["size"] for r in got) / 16, max(r["size"] for r in got)
    assert all(abs(sum(r["size"] for r in v) - share) <= largest + 0.002 * share for v in by.values())


def test_sharding_splits_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = sharding.shard(df, shards=8).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    sizes = [r["bytes"] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 60


def test_documents_move_once(spark, docs):
    def exchanges(df):
        """The exchanges above the scan of the documents, by the executed plan."""
        df.write.format("noop").mode("overwrite").save()
        text = df._jdf.queryExecution().executedPlan().toString()
        lines = text[: text.find("Initial Plan")].split("\n") if "Initial Plan" in text else text.split("\n")
        at = next(i for i, line in enumerate(lines) if "documents.parquet" in line)
        depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789")), 0
        for line in reversed(lines[:at]):
            here = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if here < depth:
                depth = here
                above += bool(re.match(r"[ :+*()0-9-]*Exchange hashpartitioning", line))
        return above

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(sharding.shard(docs)) == 1
        assert exchanges(mixing.mix_sources(docs)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sharding_of_odd_rows(odd, empty):
    got = sharding.shard(odd, shards=4).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(4))
    assert sharding.shard(empty).count() == 0


# 2


def test_bpe_of_every_character():
    """Letters and numbers are those that the library knows, at every code point."""
    lib = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, "rb") as f:
        codec = bpe.Codec(f.read())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}.{c} {c}" for c in every[at : at + 32]) for at in range(0, len(every), 32)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want.ids, ascii(text[:20])


def test_bpe_equals_the_library(spark, sf, rows):
    lib = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: r for r in catalog.op2_segment_tree_bpe(spark, sf).collect()}
    for i, text in rows.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_bpe_merges_many_words_side_by_side():
    """Each row as if it were merged alone, and new words of many texts in less time than one by one."""
    lib, codec = Tokenizer.from_file(TOKENIZER), bpe.Codec(open(TOKENIZER, "rb").read())
    rng = random.Random(5)
    drawn = {"".join(rng.choice("etaoinshrdluéßж" if n % 3 else "ab") for _ in range(rng.randrange(1, 65 if n % 50 == 0 else 14))) for n in range(12000)}
    words = sorted(drawn)
    assert {1 << (len(w.encode()) - 1).bit_length() for w in words} >= {1, 2, 4, 8, 16, 32, 64}
    one_by_one, start = {}, time.process_time()
    for word in words:
        raw = word.encode()
        one_by_one[word] = np.array(bpe.merge_word([*(codec.first[b] for b in raw[:-1]), codec.last[raw[-1]]], codec.ranks), "<u4").tobytes()
    alone, start = time.process_time() - start, time.process_time()
    codec.learn(drawn)
    together = time.process_time() - start
    assert len(codec) > 0.99 * len(words) and all(one_by_one[w] == ids for w, ids in codec.items())
    assert together < 0.6 * alone
    texts = [" ".join(words[at : at + 40]) for at in range(0, len(words), 40)] + ["", "<|endoftext|>x", "y" * 300]
    fresh = bpe.Codec(open(TOKENIZER, "rb").read())
    assert [np.frombuffer(ids, "<u4").tolist() for ids in fresh.encode_all(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_forgets_words_and_still_encodes_them(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 50)
    lib, codec = Tokenizer.from_file(TOKENIZER), bpe.Codec(open(TOKENIZER, "rb").read())
    texts = [" ".join(f"{a}{b}{c}" for a in "abcdef" for b in "xyz" for c in part) for part in ("gh", "ghi", "klmnop", "gh")]
    for some in (texts[:1], texts[1:3], texts):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in codec.encode_all(some)] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_bpe_on_odd_texts(spark, odd, empty):
    lib, codec = Tokenizer.from_file(TOKENIZER), bpe.Codec(open(TOKENIZER, "rb").read())
    rng = random.Random(3)
    parts = ["a", "THE", "'s", "'LL", "1", "23", "²", " ", "\n", " ", "é", "é", "Σ", "ς", "İ", "ß", "ﬁ", "中文", "🙂", "<|endoftext|>", "<|startoftext|>", "<|end", "...", "_", "힣", "\x00", "x" * 50]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
        assert codec.decode(codec.encode(text)) == lib.decode(ids, skip_special_tokens=False)
    got = bpe.decode(bpe.encode(odd, TOKENIZER), TOKENIZER).collect()
    assert len(got) == len(ODD) and {bytes(r["ids"]) for r in got if r["doc_id"] in (2, 3, 4)} == {b""}
    assert bpe.encode(empty, TOKENIZER, decoded="decoded").count() == 0


# 3


def test_vector_links(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:10] + 0.2 * rng.standard_normal((10, 16)), base[:5] + 0.35 * rng.standard_normal((5, 16)), np.repeat(base[:1], 30, 0), 3 * base[1:2]])
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0] * 3, []]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, [float(v) for v in base[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "node": F.lit("x"), "cell": F.lit(2)})
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, 0.9, block=8, per_cell=12).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    groups = Groups()
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.join(int(a), int(b))
    for i in range(len(x)):
        assert got[i]["n_links"] == near[i].sum() - 1 + (i == 20)
        assert (got[i]["component_id"], got[i]["kept"]) == (groups.find(i), groups.find(i) == i)
    for i in range(1000, 1000 + len(bad)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["n_links"] == near[20].sum() and not got[None]["kept"]
    short = [(2000 + i, [1.0, float(i // 2), 0.5, 0.0]) for i in range(8)] + [(2100, [2.0, 0.0]), (2101, [1.0, 0.0]), (2102, [0.0, 1.0])]
    more = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df.select("vec_id", "embedding").union(spark.createDataFrame(short, "vec_id long, embedding array<double>")), 0.9, block=8, per_cell=12).collect()}
    assert all(more[i] == got[i] for i in range(len(x)))
    assert [more[2000 + i]["component_id"] for i in range(8)] == [2000, 2000, 2002, 2002, 2002, 2002, 2002, 2002]
    assert [(more[i]["n_links"], more[i]["component_id"]) for i in (2100, 2101, 2102)] == [(1, 2100), (1, 2100), (0, 2102)]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_vector_query(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(i for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v))
    x = np.array([vectors[i] for i in ids], float)
    near = (unit := x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T >= 0.9
    groups = Groups()
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.join(ids[a], ids[b])
    links = dict(zip(ids, near.sum(1) - 1, strict=True))
    got = {r["vec_id"]: r for r in catalog.op3_spherical_kmeans_dedup(spark, sf).collect()}
    assert sorted(got) == sorted(vectors)
    for i in vectors:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links.get(i, 0), groups.find(i), groups.find(i) == i)


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["node"]: r["component"] for r in components(chain.union(spark.createDataFrame([(900, 901), (901, 901), (None, 5)], "a long, b long"))).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}


# 4


def test_near_duplicates(spark, sf, rows):
    sets, groups = {i: shingle_set(t) for i, t in rows.items()}, Groups()
    for a, b in combinations(sorted(rows), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            groups.join(a, b)
    got = {r["doc_id"]: r for r in catalog.op4_setsketch_near_duplicates(spark, sf).collect()}
    for i in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), groups.find(i), groups.find(i) == i)


def test_near_copies_of_one_text(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        texts.append(" ".join(w))
    sets, groups = [shingle_set(t) for t in texts], Groups()
    for a, b in combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            groups.join(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {i: groups.find(i) for i in range(len(texts))}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert (by[6]["component_id"], by[6]["kept"]) == (1, False)
    assert all((by[i]["n_shingles"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in (2, 3, 4))
    assert by[7]["n_shingles"] == 1 and not by[None]["kept"]
    assert minhash.near_duplicates(empty).count() == 0
    kept = [r["doc_id"] for r in minhash.keep_first(odd).collect()]
    assert sorted(k for k in kept if k) == [1, 1, 2, 3, 4, 5, 7, 8, 9] and None in kept


def test_one_id_on_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "vw")
    df = spark.createDataFrame([(1, one), (5, one), (5, two), (9, two)], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.keep_first(df).collect()) == [(1, one), (5, two)]


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(2)
    for true in (0.3, 0.75, 0.95):
        a, b, union = [], [], []
        for _ in range(100):
            n = int(2000 * true / (1 + true))
            all_ = rng.integers(0, 2**63, 2000 - n, dtype=np.uint64)
            a.append(all_[:1000])
            b.append(all_[1000 - n :])
            union.append(all_)
        x, y = setsketch.registers(a), setsketch.registers(b)
        got = setsketch.estimate((x > y).sum(1), (x < y).sum(1), np.full(100, 1000.0), np.full(100, 1000.0))
        assert abs(got.mean() - true) < 0.03
        assert (setsketch.merge(x, y) == setsketch.registers(union)).all()


def test_shingles_of_short_texts():
    got = shingles.sets(pa.array(["", None, "a b", "A  B", "a b c d e", "a b c d e f", "b a"]))
    assert [len(s) for s in got] == [0, 0, 1, 1, 1, 2, 1] and got[2] == got[3] and got[2] != got[6]


# 5


def test_mix(spark, sf, docs, rows):
    got = {r["doc_id"]: r for r in catalog.op5_sainte_lague(spark, sf).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size, taken = Counter(), Counter()
    for i, text in rows.items():
        n = len(re.findall(WORD, text))
        assert got[i]["size"] == n and 0 <= got[i]["taken"] <= 2 * n
        size[source[i]] += n
        taken[source[i]] += got[i]["taken"]
    for i in rows:
        assert got[i]["source_size"] == size[source[i]]
        assert abs(taken[source[i]] - got[i]["target"]) <= 3 * mixing.Mix().block_words
    names = sorted(size)
    assert sum({source[i]: got[i]["target"] for i in rows}.values()) == pytest.approx(1.5 * sum(size.values()))
    assert [got[next(i for i in rows if source[i] == n)]["target"] for n in names] == pytest.approx(mixing.targets([size[n] for n in names], mixing.Mix()))


def test_sources_below_one_block(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(10, "a"), (7, "b"), (3, "c"), (1, None), (5000, "d"), (0, "e"), (90, "f")])]
    got = {r["source"]: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for r in got.values():
        assert abs(r["taken"] - r["target"]) <= max(1, min(64, r["source_size"]))
    assert (got["a"]["taken"], got["b"]["taken"], got["c"]["taken"], got[None]["taken"]) == (20, 14, 6, 2)


def test_permutation_reaches_every_block_of_a_large_source(spark):
    for n in (1, 2, 97, 10**6 + 3, (1 << 40) - 87):
        step = next(x for x in range(max(1, n * 5 // 8), n + 1) if math.gcd(x, n) == 1)
        blocks = sorted({0, n - 1, n // 2, *range(min(n, 50))})
        df = spark.createDataFrame([(b,) for b in blocks], "b long")
        longs = [F.lit(x).cast("long") for x in (step, n // 3, n)]
        got = [(r["b"], r["at"]) for r in df.select("b", mixing._dealt(F.col("b"), *longs).alias("at")).collect()]
        assert got == [(b, (b * step + n // 3) % n) for b, _ in got]


def test_quotas_follow_the_highest_quotients():
    rng = random.Random(5)
    for _ in range(200):
        votes, seats = [rng.choice([0, 1, 5, 10, rng.random() * 100]) for _ in range(rng.randrange(1, 7))], rng.randrange(0, 60)
        best = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats) if v > 0))[:seats]
        want = Counter(i for _, i in best)
        got = mixing.sainte_lague(votes, seats)
        assert sum(got) == (seats if sum(votes) else 0)
        quotient = lambda q: sorted(v / (2 * k + 1) for v, n in zip(votes, q, strict=True) for k in range(n))
        assert quotient(got) == pytest.approx(quotient([want[i] for i in range(len(votes))]))


def test_mixed_documents(odd, empty, docs):
    mixed = mixing.mix_sources(odd)
    rows = mixed.collect()
    assert len(rows) == len(ODD) and all(r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    out = mixing.taken_documents(mixing.mix_sources(docs)).select("doc_id", "text").collect()
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(re.findall(WORD, r["text"]))
    want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).select("doc_id", "taken").collect()}
    assert all(words[i] == n for i, n in want.items())
    assert mixing.mix_sources(empty).count() == 0


# 6


def within(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1] <= k


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        p = rng.randrange(len(out) + 1)
        out[p : p + rng.randrange(2)] = [rng.choice("abcé")] * rng.randrange(2)
    return "".join(out)


def test_edit_distance_and_keys(spark):
    rng = random.Random(6)
    pairs = [(a, edited(rng, a, rng.randrange(5))) for a in ("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 34))) for _ in range(1500))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "h long, a string, b string")
    for k in (1, 2):
        near, far = F.levenshtein("a", "b") <= k, line_dedup.edit_distance_within(F.col("a"), F.col("b"), k)
        assert df.where(near != far).count() == 0
        side = lambda x: line_dedup.widened(df.select("h", F.col(x).alias("line")))  # noqa: E731, B023
        shared = line_dedup.index_keys(side("a"), k, 6).join(line_dedup.probe_keys(side("b"), k, 6), ["h", "key"]).select("h").distinct()
        near = F.levenshtein("a", "b") <= line_dedup.allowed(F.length("a"), k, 6)
        some = df.where(near & (F.length("b") >= F.length("a")) & (F.length("a") >= 6))
        assert some.count() > 50 and some.join(shared, "h", "left_anti").count() == 0


def deduplicated(texts):
    """For each text: its lines, the positions that go, and the text that is left."""
    places, groups, gone = defaultdict(list), Groups(), defaultdict(set)
    for i, text in texts.items():
        for p, line in enumerate((text or "").split("\n")):
            if re.search(WORD, line):
                places[line].append((i, p))
    # All pairs; an edit changes the counts of two characters by one each, which passes over most.
    lines = sorted(places, key=len)
    counts = np.array([np.bincount([ord(c) % 64 for c in x], minlength=64) for x in lines]) if lines else []
    size = np.array([len(x) for x in lines])
    for k, x in enumerate(lines):
        to = np.searchsorted(size, size[k] + line_dedup.EDITS, "right")
        for j in k + 1 + np.flatnonzero(np.abs(counts[k + 1 : to] - counts[k]).sum(axis=1) <= 2 * line_dedup.EDITS):
            if within(x, lines[j], min(line_dedup.EDITS, len(x) // line_dedup.PER_EDIT)):
                groups.join(x, lines[j])
    together = defaultdict(list)
    for line, at in places.items():
        together[groups.find(line)] += at
    for at in together.values():
        for i, p in at:
            if (i, p) != min(at):
                gone[i].add(p)
    return {i: (sum(bool(re.search(WORD, x)) for x in t.split("\n")), len(gone[i]), "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])) for i, t in texts.items() if t is not None}


def test_line_dedup(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(5, 60))) + "x" for _ in range(40)]
    texts = {i: "\n".join(rng.choice(["", base[i % 3], edited(rng, rng.choice(base), rng.randrange(4)), rng.choice(base)]) for _ in range(6)) for i in range(60)}
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, want in deduplicated(texts).items():
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["text"]) == want


def test_line_dedup_query(spark, sf, rows):
    got = {r["doc_id"]: r for r in catalog.op6_segment_line_dedup(spark, sf).collect()}
    want = deduplicated(rows)
    assert sorted(got) == sorted(want) and any(n for _, n, _ in want.values())
    for i, w in want.items():
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["text"]) == w


@pytest.mark.parametrize("frequent", [1, 128])
def test_lines_of_frequent_segments(spark, monkeypatch, frequent):
    """Lines that share their beginning, end, middle or both ends, differ in few letters or in digits, and are edited anywhere."""
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    rng = random.Random(17)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    shapes = ["Copyright of all that follows: {}", "{} of all this and what may follow", "{} is the middle of it {}", "From here on {} and up to the end of it", "aaaaaaaaaaaaaaaaaaaaaa{}aaaaa", "transfer no. {}"]
    lines = [shape.format(some(letters, n), some(letters, n)) for shape in shapes for letters, n in (("abcdefghij klmno", 20), ("0123456789", 9), ("01", 6)) for _ in range(12)]
    texts = {i: "\n".join([line, edited(rng, lines[-1 - i], 2)]) for i, line in enumerate(lines)}
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, want in deduplicated(texts).items():
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["text"]) == want


def test_lines_of_one_segment_arent_compared_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FREQUENT", 16)
    compared, plain = [], line_dedup._near
    monkeypatch.setattr(line_dedup, "_near", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    rng = random.Random(3)
    ids = [f"transaction reference {rng.randrange(10**14):014d}" for _ in range(1000)]
    rows = [(i, x) for i, x in enumerate(ids)] + [(5000, ids[7][:-1] + "x"), (5001, ids[8][:22] + ids[8][24:]), (5002, ids[9])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(compared) < 20 * len(ids)
    assert got == {i: "" if i >= 5000 else x for i, x in rows}


def test_line_dedup_of_odd_rows(odd, empty):
    got = line_dedup.remove_repeated_lines(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] == "" and by[3]["text"] is None and by[4]["text"] == " \n\t " and by[6]["text"] == ""
    assert by[1]["text"] == "One two three four five six.\nOne two three four five six seven."
    assert by[8]["text"] == "same line that is quite long here" and by[9]["text"] == "other"
    assert line_dedup.remove_repeated_lines(empty).count() == 0


# 7


def loud(text):
    spans = []
    rule = secretscan.Entropy()
    for m in re.finditer(secretscan.CANDIDATE, text):
        s = m[0]
        if any(re.search(p, s) for p in rule.allowed):
            continue
        least = rule.least["hex" if re.search(secretscan.HEX_CLASS, s) else "alnum" if re.search(secretscan.ALNUM_CLASS, s) else "base64"]
        w = rule.window
        hits = [i for i in range(len(s) - w + 1) if -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) >= least - 1e-12]
        if hits:
            spans.append((m.start() + hits[0], 3, m.start() + hits[-1] + w, "entropy"))
    return spans


def found(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secretscan.ASSIGN[4:], text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans + loud(text))


def test_secrets(spark):
    rng = random.Random(8)
    parts = ["pass" + "word", "toKEN", "api" + "_key", "=", ": ", '"', " ", "\n", "secret", "é", "🙂", "AK" + "IA", "ABCDEFGH12345678", "deadbeef01234567", "x", "Zq9/+", "a1B2c3D4e5F6g7H8i9", "hello", "01234567-89ab-cdef-0123-456789abcdef", "0123456789", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 24))) for _ in range(400)] + ["", None, "f" * 5000, "0a1b" * 2000 + " " + "".join(rng.choice("0123456789abcdef") for _ in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("findings", F.lit("clash"))
    got = {r["doc_id"]: [tuple(f) for f in r["findings"]] for r in secretscan.find_secrets(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == found(text)
    assert any(k == "entropy" for v in got.values() for *_, k in v)
    clean = {r["doc_id"]: r["text"] for r in secretscan.redact(secretscan.find_secrets(df)).collect()}
    for i, text in enumerate(texts):
        if not found(text):
            assert clean[i] == text
        else:
            assert "[secret]" in clean[i]


def test_secrets_of_empty_and_repeated_rows(spark, empty):
    assert secretscan.find_secrets(empty).count() == 0
    text = ("tok" + "en = abcdef123 ") * 20_000
    got = secretscan.find_secrets(spark.createDataFrame([(1, text), (1, text), (2, "")], "doc_id long, text string")).collect()
    want = found(text)
    assert len(want) == 20_000
    assert [[tuple(f) for f in r["findings"]] for r in got] == [want, want, []]


def test_secrets_beside_harmless_parts(spark):
    rng = random.Random(21)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    hidden = ["b3BlbnNzaC1rZXktdjEAAAAABG5vbm" + key, "config/sample/" + key, key + "A" * 30 + key, key + "0123456789", "dummy" * 2000 + key, key + "example" + key[:8] + "sample" + key]
    harmless = ["sample" + key[:19], key[:19] + "0123456789" + key[:19], key[:15] + "example" + key[:15] + "AAAAA" + key[:15], "ab1" * 5000]
    df = spark.createDataFrame(list(enumerate(hidden + harmless)), "doc_id long, text string")
    got = {r["doc_id"]: [(f["start"], f["end"]) for f in r["findings"] if f["kind"] == "entropy"] for r in secretscan.find_secrets(df).collect()}
    for i, text in enumerate(hidden):
        at = text.index(key)
        assert any(a < at + 60 and b > at for a, b in got[i]), text[:80]
        assert got[i] == [(a, b) for a, _, b, _ in loud(text)]
    assert all(got[len(hidden) + i] == [] for i in range(len(harmless)))


def test_secret_query(spark, sf, rows):
    for r in catalog.op7_entropy_secrets(spark, sf).collect():
        spans = [f"{k}:{a}:{b}" for a, _, b, k in found(rows[r["doc_id"]])]
        assert r["spans"] == ",".join(spans)
        assert r["base_sha256"] == hashlib.sha256(",".join(s for s in spans if not s.startswith("entropy")).encode()).hexdigest()


# 8


def test_quality(spark, sf, odd, empty):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in catalog.op8_random_indexing_quality(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    again = {r["doc_id"]: r["score"] for r in catalog.op8_random_indexing_quality(spark, sf).collect()}
    assert all(again[i] == r["score"] for i, r in got.items())
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(odd, quality.fit(odd, none))
    assert {r["score"] for r in scored.collect()} == {0.5}
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in catalog.op8_random_indexing_quality(spark, sf).where("held_out").collect() if r["doc_id"] in labels]
    good, bad = ([s for s, q, _ in held if q == k] for k in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    above = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.95 and sum(p == q for _, q, p in held) / len(held) > 0.9


def test_one_id_on_many_rows_is_learned_from_once(spark):
    rows = [(i, f"{'good stone river' if i % 2 else '%%% $$$'} {i}") for i in range(1, 60)] + [(1, f"many {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality, "train", lambda x, y, v: seen.append(len(y)) or quality.Network(v, np.zeros(1), np.ones(1), None, 1.0, 0.5))
        quality.fit(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 60))]


def test_calibration_learns():
    rng = np.random.default_rng(9)
    good = [" ".join(rng.choice(["stone", "river", "walks", "slowly", "home"], 30)) + "." for _ in range(120)]
    bad = [" ".join(f"{w}%%%" for w in rng.choice(["stone", "river", "walks"], 30)) for _ in range(120)]
    index = quality.index_vectors()
    into = np.zeros_like(index)
    quality.context_sums(good + bad, index, into)
    net = quality.train(quality.pooled(good + bad, into).astype(float), np.array([1.0] * 120 + [0.0] * 120), into)
    assert net.score(good).min() > 0.5 > net.score(bad).max() and net.temperature > 0
    assert 0 <= net.score(["", None])[0] == net.score(["", None])[1] <= 1


# 9


def test_search_recall(spark, sf):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    got = defaultdict(list)
    for r in sorted(catalog.op9_multi_index_hashing(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    hits = 0
    for q, found_ in got.items():
        score = x @ vectors[q]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & {r["vec_id"] for r in found_})
        assert [r["rank"] for r in found_] == list(range(1, 21))
        assert all(abs(r["score"] - vectors[q] @ vectors[r["vec_id"]]) < 1e-12 for r in found_)
        assert [(-r["score"], r["vec_id"]) for r in found_] == sorted((-r["score"], r["vec_id"]) for r in found_)
    assert hits >= 0.9 * 20 * len(got)


def test_probes_meet_every_code_within_the_radius(spark):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((60, 12))
    x = np.concatenate([base, base + 0.05 * rng.standard_normal((60, 12)), base + 0.3 * rng.standard_normal((60, 12))])
    model = hashing_search.fit({12: x}, float(np.sqrt((x * x).sum(1)).max()), 180)
    model = dataclasses.replace(model, reach=1, wide=140)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rep long, v array<double>")
    met = hashing_search._met(hashing_search._coded(df, model, "i", False), hashing_search._coded(df.where("rep < 60"), model, "q", True), model)
    got = [(r["q"], r["i"]) for r in met.collect()]
    apart = hashing_search.bits_between(model.query(x[:60])[:, None, :], model.index(x)[None, :, :])
    near = apart.sum(-1)
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero((apart.min(-1) <= 1) & (near <= 140)), strict=True))
    assert set(zip(*np.nonzero(near <= min(model.radius, 140)), strict=True)) <= set(got) and model.radius == 2 * model.m - 1


def test_reach_and_substrings_are_those_of_least_cost(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("rep"), F.col("embedding").alias("v"))
    model = hashing_search.model_of(rows, rows.where("rep % 5 = 0"), 20)
    x = np.array([r["v"] for r in rows.orderBy("rep").collect()], float)
    met = hashing_search.bits_between(model.query(x)[:, None, :], model.index(x)[None, :, :])[:, :, : model.used] <= model.reach
    assert model.used < model.m and met.sum(axis=2).mean() < 1.5  # with all substrings within this reach: 2.9
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:21]
    assert np.take_along_axis(met.any(axis=2), near, axis=1).mean() > 0.95
    far = hashing_search.tried(model, x[:20], -x[:20], len(x))
    assert far.used == far.m and far.reach > hashing_search.MOST_REACH


def test_the_index_grows_as_the_vectors_do():
    """The given tables' kind of vectors, five times as many: as many rows of index each, and the radius keeps the trial pairs."""
    x, used = np.random.default_rng(9).standard_normal((51282, 64)), []
    x[5000:] += 0.5 * x[np.random.default_rng(10).integers(0, 5000, 46282)]
    for n in (10256, 51282):
        part = x[:n]
        asked = np.arange(0, n, n // 128)[:128]
        score = part[asked] @ part.T
        score[np.arange(len(asked)), asked] = -np.inf
        near = part[np.argpartition(-score, 20, axis=1)[:, :20].ravel()]
        pairs = np.repeat(part[asked], 20, axis=0), near
        model = hashing_search.tried(hashing_search.fit({64: part[:4096]}, float(np.sqrt((part * part).sum(axis=1)).max()), n), *pairs, n)
        used.append(model.used)
        apart = hashing_search.bits_between(model.query(pairs[0]), model.index(near))[:, : model.used]
        kept = lambda reach, further: (apart <= reach + (np.arange(model.used) < further)).any(axis=1).mean()
        before = divmod(model.reach * model.used + model.further - 1, model.used)
        assert kept(model.reach, model.further) >= hashing_search.REACHED > kept(*before)
    assert used[0] == used[1] == hashing_search.INDEXED


def test_probes_reach_further_in_the_first_substrings(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((40, 12))
    x = np.concatenate([base, base + 0.2 * rng.standard_normal((40, 12)), base + 0.4 * rng.standard_normal((40, 12))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rep long, v array<double>")
    for reach, further in ((0, 5), (1, 3)):
        model = dataclasses.replace(hashing_search.fit({12: x}, float(np.sqrt((x * x).sum(1)).max()), 120), reach=reach, further=further, used=9, wide=200)
        met = hashing_search._met(hashing_search._coded(df, model, "i", False), hashing_search._coded(df.where("rep < 40"), model, "q", True), model)
        got = [(r["q"], r["i"]) for r in met.collect()]
        apart = hashing_search.bits_between(model.query(x[:40])[:, None, :], model.index(x)[None, :, :])
        hit = (apart[:, :, :9] <= reach + (np.arange(9) < further)).any(axis=2) & (apart.sum(axis=2) <= 200)
        assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(hit), strict=True))
        assert hit[(apart[:, :, :9].sum(axis=2) <= model.radius) & (apart.sum(axis=2) <= 200)].all() and model.radius == 9 * (reach + 1) + further - 1


def test_results_come_from_probes(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    compared, plain = [], hashing_search._compared
    monkeypatch.setattr(hashing_search, "_compared", lambda index, queries, *rest: compared.append(queries.count()) or plain(index, queries, *rest))
    got = defaultdict(set)
    for r in hashing_search.nearest(rows, rows.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    # Only the trial queries are compared with everything, to set the model; no result comes from there.
    assert compared == [sum(i % 20 == 0 for i in range(2000))] and len(got) == 100
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    hits = sum(len((set(ids[np.argsort(-(x @ vectors[q]))[:21]].tolist()) - {q}) & found_ids) for q, found_ids in got.items())
    assert hits >= 0.9 * 20 * len(got)


def test_search_on_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit("y"), "score": F.lit(0)})
    got = hashing_search.nearest(df, df.where("vec_id in (1, 5, 8)"), k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 2, 2.0), (1, 2, 3, 1.0), (1, 3, 4, 1.0), (8, 1, 9, 3.0)]
    assert hashing_search.nearest(df.limit(0), df.limit(0)).count() == 0


def test_search_among_copies(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((400, 8))
    x[100:300] = x[100]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hashing_search.nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    # A copy's nearest are the smallest ids of the others, unless a longer vector's product is larger.
    for q in range(100, 300, 20):
        larger = [i for i in np.argsort(-(x @ x[q]), kind="stable") if (x[i] * x[q]).sum() > (x[q] * x[q]).sum()]
        assert got[q][-1] in range(100, 300) or len(larger) >= 5
        copies = [i for i in got[q] if 100 <= i < 300]
        assert copies == [i for i in range(100, 300) if i != q][: len(copies)]


# 10


def inner_ends(words):
    """Where a long sentence is cut: after the last word of least hash of each window; of such words that crowd, every third."""
    if len(words) <= substring_dedup.MOST_WORDS:
        return set()
    rank = [int(shingles.mixed(shingles.word_table(pa.array([w]))[2])[0]) for w in words]
    width = substring_dedup.CUT_WINDOW
    chosen = sorted({min(range(a, a + width), key=lambda i: (rank[i], -i)) for a in range(len(words) - width + 1)})
    ends, crowd = set(), 0
    for n, at in enumerate(chosen):
        crowd = crowd + 1 if n and at - chosen[n - 1] < substring_dedup.LEAST_WORDS else 0
        if crowd % substring_dedup.LEAST_WORDS == 0:
            ends.add(at)
    return ends


def sentences(text):
    words, whole, cur, raw = [(m[0], m.start(), m.end()) for m in re.finditer(WORD, text)], [], [], 0
    for k, (word, a, b) in enumerate(words):
        cur.append((low(word), a))
        raw += 1
        line = k + 1 == len(words) or "\n" in text[b : words[k + 1][1]]
        stop = word[-1] in substring_dedup.STOPS or line
        if line or (stop and raw >= substring_dedup.LEAST_WORDS):
            whole.append(cur)
            cur = []
        raw = 0 if stop else raw
    out = []
    for s in whole:
        start = 0
        for end in sorted(inner_ends([w for w, _ in s]) | {len(s) - 1}):
            out.append(([w for w, _ in s[start : end + 1]], s[start][1]))
            start = end + 1
    return out


def test_sentence_spans(spark, sf, rows):
    cut = {i: sentences(t) for i, t in rows.items()}
    places, gone = defaultdict(set), defaultdict(set)
    for i, s in cut.items():
        for a in range(len(s)):
            for order in (range(a + 1, len(s)), range(a - 1, -1, -1)):
                for b in order:
                    lo, hi = min(a, b), max(a, b)
                    words = tuple(w for x in s[lo : hi + 1] for w in x[0])
                    if len(words) >= substring_dedup.RUN_WORDS:
                        places[words].add((i, lo, hi))
                        break
    for at in places.values():
        first = min(at)
        for i, a, b in at:
            if (i, a) != first[:2]:
                gone[i].update(range(a, b + 1))
    got = {r["doc_id"]: r for r in catalog.op10_sentence_spans(spark, sf).collect()}
    for i, text in rows.items():
        ends = [a for _, a in cut[i]] + [len(text)]
        want = text if not gone[i] else "".join(([] if 0 in gone[i] else [text[: ends[0]]]) + [text[ends[k] : ends[k + 1]] for k in range(len(cut[i])) if k not in gone[i]])
        assert (got[i]["n_sentences"], got[i]["n_removed"], got[i]["text"]) == (len(cut[i]), len(gone[i]), want)


def test_sentences_of_several_scripts():
    texts = ["a b c. d e f! g h i? j", "一 二 三。 四 五 六！ 七 八 九", "क ख ग। घ ङ च", "。", "x。"]
    doc, first, after, _, _ = substring_dedup.sentences(pa.array(texts))
    assert [[(int(a), int(b)) for d, a, b in zip(doc, first - first[doc == k][0], after - first[doc == k][0], strict=True) if d == k] for k in range(5)] == [[(0, 3), (3, 6), (6, 9), (9, 10)], [(0, 3), (3, 6), (6, 9)], [(0, 3), (3, 6)], [(0, 1)], [(0, 1)]]
    assert [len(s[0]) for s in sentences(texts[1])] == [3, 3, 3]


def test_repeated_passage(spark, odd, empty):
    passage = " ".join(f"w{i}" for i in range(30)) + ". " + " ".join(f"v{i}" for i in range(25)) + "."
    df = spark.createDataFrame([(1, f"Own start of one.\n{passage}\nOwn end of one."), (2, f"Other start here now.\n{passage}"), (3, passage), (4, "All my own words are here. And some more of them too.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert got[1]["n_removed"] == got[4]["n_removed"] == 0
    assert got[2]["text"] == "Other start here now.\n" and got[3]["text"] == "" and " ".join(got[3]["removed"]) == passage
    rows = substring_dedup.remove_repeats(odd).collect()
    assert len(rows) == len(ODD) and {r["text"] for r in rows if r["doc_id"] == 3} == {None}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeated_passages_inside_long_sentences(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    many = lambda n: [word() for _ in range(n)]
    shared = [many(51 + i % 20) for i in range(40)]
    later = [many(7 + 3 * i % 23) + s + many(11) for i, s in enumerate(shared)]
    early = [many(i % 19) + s + many(30) for i, s in enumerate(shared)]
    grown = ["same", "lead", "in"] + many(30) + shared[0][:25] + ["inserted"] + shared[0][25:]
    rows = [(i, " ".join(t)) for i, t in enumerate(early)] + [(100 + i, " ".join(t)) for i, t in enumerate(later)] + [(200, " ".join(many(500))), (300, " ".join(grown))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, s in enumerate(shared):
        left = got[100 + i]["text"].split()
        assert got[i]["n_removed"] == 0
        assert got[100 + i]["removed_words"] >= substring_dedup.RUN_WORDS
        assert [w for w in left if w not in s] == [w for w in later[i] if w not in s]
        assert len(later[i]) - len(left) == got[100 + i]["removed_words"]
    assert got[200]["n_removed"] == 0
    assert set(grown) - set(shared[0]) <= set(got[300]["text"].split())


# very long texts

LONG_TEXT = """
import resource
import numpy as np, pyarrow as pa, public_tokenizers
from quarryline.llm import batches, bpe, quality, setsketch, shingles, substring_dedup
from hashlib import sha256
rng = np.random.default_rng(1)
words = np.array(["w%x" % i for i in rng.integers(0, 2**20, 200_000)])
text = " ".join(words[rng.integers(0, len(words), 8_000_000)].tolist())
assert len(text) > 45_000_000
batch = pa.RecordBatch.from_arrays([pa.array(["a b c", text, None, "d"])], ["text"])
got = list(batches.pieces(iter([batch]), "text"))
assert [p.num_rows for p in got] == [1, 1, 2]
resource.setrlimit(resource.RLIMIT_DATA, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024 + 1_800_000_000,) * 2)
column = got[1].column(0)
if KIND == "sets":
    sets = shingles.sets(column)
    assert len(sets[0]) > 7_000_000 and setsketch.registers(sets).shape == (1, 128)
if KIND == "runs":
    doc, first, after, _, word = substring_dedup.sentences(column)
    assert len(substring_dedup.runs(doc, first, after, word)[0]) > 100_000
if KIND == "quality":
    assert quality.pooled([text, "a b"], quality.index_vectors()).shape == (2, 128)
if KIND == "tokens":
    codec = bpe.Codec(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    few = " ".join(words[rng.integers(0, 2000, 7_500_000)].tolist())
    assert codec.decode(codec.encode(few)).count(" ") > 7_500_000
print("done")
"""


@pytest.mark.parametrize("kind", ["sets", "runs", "quality", "tokens"])
def test_a_text_of_fifty_megabytes_in_bounded_memory(kind):
    done = subprocess.run([sys.executable, "-c", LONG_TEXT.replace("KIND", repr(kind))], cwd=Path(__file__).resolve().parents[2], env=os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}, capture_output=True, text=True)
    assert done.stdout.strip() == "done", done.stderr[-2000:]


# the pipeline


def test_pipeline(spark, sf, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-duplicate documents", "source mix", "token encoding"]
    lib, seen = Tokenizer.from_file(TOKENIZER), docs
    for _, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, sf).cache()
        if stage is not corpus_pipeline.token_stage:
            assert seen.columns == docs.columns
        assert seen.count() > 0
    texts = Counter((r["doc_id"], r["source"], len(lib.encode(r["text"], add_special_tokens=False).ids)) for r in before.collect())
    assert texts == Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in seen.collect())


def test_pipeline_stages_on_odd_rows(spark, sf, odd, empty):
    ids = lambda df: sorted(((r["doc_id"], r["source"]) for r in df.select("doc_id", "source").collect()), key=str)
    every = ids(odd)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf)
        assert stage(spark, empty, sf).count() == 0
        if name == "quality classifier":
            scored = catalog.quality.score(odd, catalog.quality.fit(odd, spark.read.parquet(f"{sf}/labels.parquet")))
            assert ids(got) == ids(scored.where(F.col("score") >= catalog.quality.LEAST))
        elif name == "line dedup":
            # Both lines of doc 6 stand in doc 1 too.
            assert ids(got) == sorted((x for x in every if x[0] != 6), key=str)
            assert {r["text"] for r in got.where("doc_id = 3").collect()} == {None}
        elif name == "near-duplicate documents":
            assert ids(got) == sorted((x for x in every if x[0] != 6), key=str)
        elif name == "source mix":
            assert not {2, 3, 4} & {i for i, _ in ids(got)} and {i for i, _ in ids(got)} <= {i for i, _ in every}
        else:
            rows = got.collect()
            assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0}


def test_pipeline_run_leaves_its_last_documents_only(spark, sf):
    import glob

    from quarryline.llm import scratch

    out = corpus_pipeline.run(spark, sf)
    folders = [p for p in glob.glob(scratch.root(spark).removeprefix("file://") + "/*") if "source-mix" in p or "line-dedup" in p or "near-duplicate" in p or "quality-classifier" in p]
    assert len(folders) == 1 and "source-mix" in folders[0]
    assert out.count() > 0
