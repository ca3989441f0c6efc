"""Every query with SQL gives DuckDB's rows over the same tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarryline.operators import scan

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    want = duck.execute(SQL[name])
    theirs = rows([d[0] for d in want.description], want.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
    assert sum(mine[1].values()) > 0 or name == "entropy_tokens"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_whole_findings_files_and_stores(spark, sf, duck):
    run = lambda name: entry.queries()[name](spark, sf)
    places = [(r["severity_rank"], r["file_path"], r["line_start"], r["seq"]) for r in run("findings_all_sorted").collect()]
    assert places == sorted(places) and len(places) == duck.execute("SELECT count(*) FROM events").fetchone()[0] > 100
    size = duck.execute("SELECT sum(strlen(text)), count(*) FROM documents").fetchone()
    kept, cut = run("scan_total_cap_default"), run("scan_total_cap")
    assert (size[0] > 20_000_000 or kept.count() == size[1]) and 0 < cut.count() < size[1]
    assert run("store_count_all").first() == run("store_count").first() and run("store_count").first()["n"] == run("chunk_lines").count()
    ranked = sorted(run("findings_sorted").collect(), key=lambda r: r["place"])
    assert [r["seq"] for r in ranked] == [p[3] for p in places]


def test_vectors_of_all_chunks(spark, sf):
    """The stand-in model's counts, by plain arithmetic over the words of every chunk."""
    texts = {r["content_hash"]: r["content_text"] for r in entry.queries()["chunk_lines"](spark, sf).collect()}
    got = entry.queries()["embed_chunks"](spark, sf).collect()
    assert {r["content_hash"] for r in got} == set(texts) and {(r["status"], r["error"]) for r in got} == {("embedded", None)}
    for r in got:
        want = [0] * 64
        for word in re.findall(r"\S+", texts[r["content_hash"]].encode()[:24_576].decode(errors="replace")):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            want[h % 64] += 1 if h >= 2**63 else -1
        length = math.sqrt(sum(x * x for x in want)) or 1
        assert max(abs(a - b / length) for a, b in zip(r["embedding"], want, strict=True)) < 1e-6


def test_whole_texts_reach_slugs_snippets_and_cells(spark, sf, duck):
    texts, events = (duck.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("documents", "events"))
    got = {name: entry.queries()[name](spark, sf).collect() for name in ("slug_whole", "snippet_whole", "cell_whole")}
    assert {len(rows) for rows in got.values()} == {texts + events}
    longest = duck.execute("SELECT max(strlen(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) FROM documents").fetchone()[0]
    assert max(len(r["slug"] or "") for r in got["slug_whole"]) >= longest > 200
    assert sum(r["snippet"].endswith("…") for r in got["snippet_whole"] if r["snippet"]) >= duck.execute("SELECT count(*) FROM documents WHERE length(text) > 100").fetchone()[0]


def test_provider_keys_of_documents_are_found(spark, tmp_path):
    key = "AK" + "IA" + "ABCDEFGH12345678"
    spark.createDataFrame([(1, f"first line\nid = '{key}'\nlast"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["secret_regex_all"](spark, str(tmp_path)).where("origin = 'document'").collect()
    assert [(r["id"], r["line_no"], r["match"]) for r in got] == [(1, 2, key)]


def test_total_cap_of_files_in_the_root(spark):
    files = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") * 7919 % 3000).alias("rel_path"), (F.col("id") % 5).alias("size"))
    sizes, total, want = sorted((r["rel_path"], r["size"]) for r in files.collect()), 0, []
    for path, size in sizes:
        total += size
        want += [(path, size, total)] if total <= 4000 else []
    capped = scan.total_cap(files, 4000)
    assert sorted(tuple(r) for r in capped.collect()) == want
    assert scan.total_cap(files.limit(0)).count() == 0
    assert scan.total_cap(files, 10**9).count() == 3000
