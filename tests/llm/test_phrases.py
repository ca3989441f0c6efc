"""Phrase collocations against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarryline.llm import catalog, phrases

A = bytes(range(65, 91)).decode()
SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
ODD = [
    (1, "Big data, big data; big DATA!\nbig data", "en"), (1, "Big data, big data; big DATA!\nbig data", "en"), (2, None, "en"), (3, "", None), (4, " \t ,,\r\n", "de"),
    (5, "new york city new york city. new york", None), (6, "new york new york", "und"), (7, "É x é x É x é x ÄB äb", "de"), (8, "x\x0by z\x0cx y\x00 z", "en"),
    (None, "big data big data big data", "en"), (9, "word " * 9000, "fr"), (10, "a b c d e f g. " * 400, "long"),
]


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans(A, A.lower()))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if a >= least}
        inner = Counter()
        for p, a in often.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    s = " ".join(w[i : i + k])
                    inner[s] = max(inner[s], a)
        found = []
        for p, a in often.items():
            w = p.split(" ")
            if len(w) > 1 and inner[p] < a:
                score, _, l, r = min((1000 * a * n[lang] // (often[" ".join(w[:k])] * often[" ".join(w[k:])]), k, often[" ".join(w[:k])], often[" ".join(w[k:])]) for k in range(1, len(w)))
                found.append((-score, -a, p.encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_the_table_equals_its_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in catalog.op11_count_min_phrases(spark, sf).collect())
    assert got and got == sorted(duckdb.sql(catalog.PHRASES_SQL).fetchall())


@pytest.mark.parametrize("least", [1, 2, 300])
def test_odd_rows(spark, least):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=7).collect())
    assert got and got == brute([r[1:] for r in ODD], least, 7)
    assert phrases.collocations(df.where("doc_id > 99"), least=least).count() == 0


def test_a_full_sketch_changes_nothing(spark, sf):
    """With so few cells that all fill up, every n-gram passes, and only the exact counts decide."""
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60).persist()
    narrow = phrases.counts(df, least=5, cells=phrases.SLICE)
    wide = phrases.counts(df, least=5, cells=1 << 21)
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.collect()))
    df.unpersist()


def test_no_frequent_phrase_fails_a_merged_sketch(spark):
    df = spark.range(3000).select(F.concat(F.lit("rare"), "id", F.lit(" common words here rare"), "id").alias("text"), F.lit("en").alias("lang")).repartition(5)
    once = spark.sparkContext.broadcast([])
    words = phrases._sketch(df, (1,), once, phrases.SLICE, 100)
    pairs = phrases._sketch(df, (2,), spark.sparkContext.broadcast([words]), phrases.SLICE, 100)
    filters = phrases._Filters([words, pairs], phrases.SLICE)
    batch = phrases._Batch(pa.array(["common words here zzz"]), pa.array(["en"]))
    one, two = (h for h, _ in zip(batch.hashes(), range(2)))
    assert filters.pass_(1, one)[:3].all() and filters.pass_(2, two)[:2].all()
    assert np.unpackbits(np.frombuffer(words, np.uint8)).sum() < 0.05 * phrases.ROWS * phrases.SLICE


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", 0, "", 10**17), ("en", 1, "a", 7 * big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).first()
    assert got["score"] == 1000 * big * 10**17 // (7 * big * (big + 1))
