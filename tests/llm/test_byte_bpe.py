"""Byte-level BPE against the tiktoken library, on the table, on odd rows and on hard pieces."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarryline.llm import byte_bpe, catalog

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def table():
    with open(FILE, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def lib(table):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(FILE, "rb") as f:
        return byte_bpe.Codec(f.read(), public_tokenizers.PATTERN)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_the_table_equals_the_library(spark, sf, lib):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in catalog.op13_monoid_byte_bpe(spark, sf).collect()}
    assert set(got) == set(rows)
    for doc_id, text in rows.items():
        ids = lib.encode_ordinary(text)
        assert (got[doc_id]["n_tokens"], got[doc_id]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert got[doc_id]["decoded_sha256"] == sha(text.encode())


def test_odd_rows(spark, lib):
    texts = [None, "", " ", "\n\n  \t", "<|endoftext|>", "don't  stop", "a" * 3000, "x ὠ0é" * 9000, "same", "same"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, piece string")
    got = {r["doc_id"]: r for r in byte_bpe.encode(df, FILE, decoded="decoded").collect()}
    assert [got[i]["ids"] for i in range(len(texts))] == [lib.encode_ordinary(t or "") for t in texts]
    assert all(bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["piece"] == "y" for i, t in enumerate(texts))
    assert byte_bpe.encode(df.where("doc_id < 0"), FILE).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(df, FILE).withColumn("decoded", F.lit(1)), FILE).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    cut = spark.createDataFrame([(None,), ([],), ([lib.encode_ordinary("é")[0]],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(cut, FILE).collect()][:2] == [b"", b""]


def test_seams_of_any_tree(table, lib, codec):
    """Whatever the leaves and the place of the cut, the joined halves are the encoding of the whole."""
    draw, fine = random.Random(3), byte_bpe.Ranks(table, leaf=1)
    for _ in range(3000):
        piece = "".join(draw.choice(["a", "aa", "the", "ing", "zz", "é", "=", "==", "1", "tion", "中"]) for _ in range(draw.randint(1, 40))).encode()
        whole, at = codec.ranks._by_heap(piece), draw.randint(0, len(piece))
        assert whole == codec.ranks._by_scans(piece) == fine._halves(piece) == codec.ranks._halves(piece)
        assert fine.joined(fine._halves(piece[:at]), fine._halves(piece[at:])) == whole
        if piece not in table:
            assert lib._core_bpe.encode_single_piece(piece) == whole


@pytest.mark.parametrize("piece", ["a", "z", "=", "1", " ", "\n", "é", "ab", "中"])
def test_long_runs_shift_whole_windows(piece, lib, codec):
    for n in (257, 5001):
        assert codec.encode(piece * n).tolist() == lib.encode_ordinary(piece * n)


def test_classes_of_all_characters(lib, codec):
    """Letters, numbers and white space are told apart as the library does, at every code point."""
    for lo in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}.{chr(c)}  " for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
        if text and codec.encode(text).tolist() != lib.encode_ordinary(text):
            raise AssertionError(hex(lo))


def test_a_table_without_a_byte_is_refused(table):
    with pytest.raises(ValueError, match="1 single bytes"):
        byte_bpe.Ranks({k: v for k, v in table.items() if k != b"a"})
