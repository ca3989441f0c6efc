"""A real folder: which files are read, how they are cut, indexed, searched and reported."""

from __future__ import annotations

import json
import os
from collections import defaultdict

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from quarryline import api
from quarryline.functions import vectors as V
from quarryline.operators import chunking, index, remote, scan, search
from quarryline.sources import sinks
from quarryline.sources import tree as tree_source
from quarryline.sources.store import ChunkStore, StoreBusy, StoreMismatch, pack_vectors, unpack_vectors
from quarryline.sources.tree import list_tree, read_tree, stream_tree
from quarryline.streaming.incremental import index_stream


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "work"
    put = lambda path, data: ((root / path).parent.mkdir(parents=True, exist_ok=True), (root / path).write_bytes(data))
    put("zero.py", b"")
    put("thirty.py", b"x\n" * 30)
    put("thirty_one.py", b"x\n" * 31)
    put("fifty_six.py", b"\n".join(b"l%d" % i for i in range(56)))
    put("crlf.md", b"a\r\nb\r\r\n")
    put("bad.ts", b"ok\n\xff\xfe\n")
    put("M.PY", b"print()\n")
    put(".md", b"dot\n")
    put("Makefile", b"all:\n")
    put("a.tar.gz", b"z")
    put("pkg/__init__.py", b"\n")
    put(".github/workflows/ci.yml", b"on: push\n")
    put("node_modules/x/i.js", b"no\n")
    put(".backup-20240101T000000Z/a.py", b"no\n")
    put("full.py", b"#" * scan.MAX_FILE_BYTES)
    put("over.py", b"#" * (scan.MAX_FILE_BYTES + 1))
    os.symlink(root / "thirty.py", root / "link.py")
    os.symlink(root / "pkg", root / "linked")
    return root


def test_tree_source(spark, tree):
    files = read_tree(spark, str(tree))
    names = {r["rel_path"] for r in files.select("rel_path").collect()}
    assert names == {"zero.py", "thirty.py", "thirty_one.py", "fifty_six.py", "crlf.md", "bad.ts", "M.PY", ".md", "pkg/__init__.py", ".github/workflows/ci.yml", "full.py"}
    chunks = defaultdict(list)
    for r in chunking.chunk_lines(files.select("rel_path", "language", "text")).orderBy("line_start").collect():
        chunks[r["rel_path"]].append((r["line_start"], r["line_end"], r["content_text"]))
    assert [c[:2] for c in chunks["thirty.py"]] == [(1, 30)]
    assert [c[:2] for c in chunks["thirty_one.py"]] == [(1, 30), (26, 31)]
    assert [c[:2] for c in chunks["fifty_six.py"]] == [(1, 30), (26, 55), (51, 56)]
    assert chunks["crlf.md"][0][2] == "a\nb\r"
    assert chunks["pkg/__init__.py"] == [(1, 1, "")]
    assert "bad.ts" not in chunks and "zero.py" not in chunks


def test_pruned_root_and_linked_root(spark, tree, tmp_path):
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "a.py").write_text("x\n")
    os.symlink(tree, tmp_path / "other")
    assert read_tree(spark, str(tmp_path / "build")).count() == 0
    assert read_tree(spark, str(tmp_path / "other")).count() == 0


def test_windows_against_a_loop(spark):
    rows = [(f"f{n}", "go", "\n".join(map(str, range(n)))) for n in range(1, 130)]
    got = defaultdict(list)
    for r in chunking.chunk_lines(spark.createDataFrame(rows, "rel_path string, language string, text string")).collect():
        got[r["rel_path"]].append((r["line_start"], r["line_end"]))
    for n in range(1, 130):
        want, start = [], 0
        while True:
            want.append((start + 1, min(start + 30, n)))
            if start + 30 >= n:
                break
            start += 25
        assert sorted(got[f"f{n}"]) == want


def test_index_and_search(spark, tree, tmp_path):
    store = str(tmp_path / "store")
    first = api.index_tree(spark, str(tree), store)
    again = api.index_tree(spark, str(tree), store)
    assert first["embedded"] == first["chunks"] > 0 and first["unchanged"] == 0
    assert again["embedded"] == 0 and again["unchanged"] == first["chunks"]
    assert ChunkStore(spark, store, "hashing-64", 64).count() == first["chunks"]
    with pytest.raises(StoreMismatch):
        ChunkStore(spark, store, "other", 64)
    rows = api.search_store(spark, store, "print()", k=3).collect()
    assert rows[0]["rel_path"] == "M.PY" and [r["rank"] for r in rows] == [1, 2, 3]
    only = api.search_store(spark, store, "print()", k=3, languages=["yaml"]).collect()
    assert {r["language"] for r in only} == {"yaml"}
    assert not api.search_store(spark, store, "print()", k=3, languages=["YAML"]).collect()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a.py", "python", "x\ny\n"), ("b.py", "python", "x\ny\n")], "rel_path string, language string, text string").write.parquet(str(source))
    store = ChunkStore(spark, str(tmp_path / "store"), "hashing-64", 64)
    files = spark.readStream.schema("rel_path string, language string, text string").parquet(str(source))
    for _ in range(2):
        index_stream(files, store, index.hashing_embedder(), str(tmp_path / "check")).awaitTermination()
    assert store.count() == 2


def _chunks(spark, n, first=0):
    rows = spark.range(first, first + n).selectExpr("sha2(cast(id AS string), 256) AS content_hash", "concat('f', id % 7, '.py') AS rel_path", "'lines' AS kind", "cast(id AS int) AS line_start", "cast(id AS int) AS line_end", "concat('word', id, ' text') AS content_text", "'python' AS language")
    return rows


def test_a_stopped_run_keeps_its_parts(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), "hashing-64", 64)
    model, calls = index.hashing_embedder(), spark.sparkContext.accumulator(0)
    order = [r["content_text"] for r in _chunks(spark, 100).orderBy("rel_path", "line_start", "content_hash").collect()]

    def stops(texts):
        if order[70] in texts:
            raise SystemExit("the power went")
        calls.add(len(texts))
        return model(texts)

    def counts(texts):
        calls.add(len(texts))
        assert texts == order[order.index(texts[0]) :][: len(texts)] and len(texts) in (4, 1)
        return model(texts)

    with pytest.raises(Exception, match="power|worker|exit"):
        store.fill(_chunks(spark, 100), stops, batch=4, part=5)
    assert store.count() == 60  # three whole parts of 5 batches of 4
    before = calls.value
    assert store.fill(_chunks(spark, 100), counts, batch=4, part=5) == {"embedded": 40, "failed": 0}
    assert calls.value - before == 40 and store.count() == 100
    assert store.fill(_chunks(spark, 100), counts) == {"embedded": 0, "failed": 0}


def test_the_store_stays_where_it_is(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "it's a store"), "hashing-64", 64, buckets=5)
    assert store.count() == 0
    store.fill(_chunks(spark, 300), index.hashing_embedder())
    store.add(index.embed(_chunks(spark, 400), index.hashing_embedder()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = index.new_chunks(_chunks(spark, 500), store.chunks())
        assert fresh.count() == 100
        text = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.split("\n")
    scan_at = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "content_hash" in x)
    indent, above = len(lines[scan_at]) - len(lines[scan_at].lstrip(" :+-*()0123456789")), []
    for x in reversed(lines[:scan_at]):
        here = len(x) - len(x.lstrip(" :+-*()0123456789"))
        if here < indent:
            indent = here
            above.append(x)
    assert "Bucketed: true" in lines[scan_at] and above and not any("Exchange" in x for x in above)
    other = ChunkStore(spark.newSession(), str(tmp_path / "it's a store"), "hashing-64", 64)
    assert other.buckets == 5 and other.count() == 400
    with store._adding(), pytest.raises(StoreBusy):
        other.add(index.embed(_chunks(spark, 1), index.hashing_embedder()))


def test_search_reads_texts_of_the_found_only(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), "hashing-64", 64)
    store.fill(_chunks(spark, 200), index.hashing_embedder())
    vector = index.hashing_embedder()(["word17 text"])[0]
    plan = search.scored(store.chunks(), vector, 3, norm="norm")._jdf.queryExecution().executedPlan().toString()
    assert "content_text" not in plan and "embedding" in plan
    got = search.search(store.chunks(), vector, 3, norm="norm").orderBy("rank").collect()
    plain = search.search(store.chunks(), vector, 3).orderBy("rank").collect()
    assert got[0]["content_text"] == "word17 text" and round(got[0]["score"], 6) == 1 and [r["content_hash"] for r in got] == [r["content_hash"] for r in plain]
    found = search.search(store.chunks(), vector, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(content_hash" in found


def test_a_folder_is_followed(spark, tmp_path):
    root, opened_files = tmp_path / "code", []
    put = lambda name, text: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_text(text))
    for k in range(5):
        put(f"d{k % 2}/f{k}.py", f"x = {k}\n")
    put("d0/skip.txt", "no")
    store = ChunkStore(spark, str(tmp_path / "store"), "hashing-64", 64)

    def run():
        files = stream_tree(spark, str(root))
        seen = []
        counted = files.writeStream.foreachBatch(lambda df, _: seen.extend(r["rel_path"] for r in df.select("rel_path").collect())).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
        counted.awaitTermination()
        index_stream(files.select("rel_path", "language", "text"), store, index.hashing_embedder(), str(tmp_path / "check")).awaitTermination()
        return sorted(seen)

    assert run() == ["d0/f0.py", "d0/f2.py", "d0/f4.py", "d1/f1.py", "d1/f3.py"] and store.count() == 5
    assert run() == [] and store.count() == 5
    put("d1/new/f9.go", "package x\n")
    put("d0/f0.py", "x = 'changed'\n")
    assert run() == ["d0/f0.py", "d1/new/f9.go"] and store.count() == 7
    # Files of one moment are told apart by their paths.
    reader = tree_source._Stream({"path": str(root)})
    for name in ("d0/f2.py", "d0/f4.py", "d1/f3.py"):
        os.utime(root / name, ns=(10**18, 10**18))
    start, end = {"mtime": 10**18, "path": "d0/f2.py"}, {"mtime": 10**18, "path": "d1/f3.py"}
    reader.reader._content = lambda path: (opened_files.append(path), (b"", None))[1]
    got = [p for part in reader.partitions(start, end) for b in reader.read(part) for p in b.column("rel_path").to_pylist()]
    assert sorted(got) == sorted(opened_files) == ["d0/f4.py", "d1/f3.py"]
    assert tree_source._Stream({"path": str(root), "settleSeconds": "3600"}).latestOffset() == {"mtime": 10**18, "path": "d1/f3.py"}


def test_search_edges(spark):
    rows = [("g", [1.0, float("nan")]), ("h", [None, 1.0]), ("i", None), ("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 2.0]), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", [2.0, 0.0])]
    store = spark.createDataFrame([(k, "go", v) for k, v in rows], "content_hash string, language string, embedding array<float>")
    got = search.search(store, [1.0, 0.0], 10).orderBy("rank").collect()
    assert [(r["content_hash"], round(r["score"], 6)) for r in got] == [("a", 1.0), ("f", 1.0), ("c", 0.0), ("b", -1.0)]
    assert search.search(store, [0.0, 0.0], 10).count() == 0
    assert search.search(store, [], 10).count() == 0
    assert search.search(store, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        search.search(store, [1.0, 0.0], -1)
    assert spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] is None


def test_failed_batches_are_retried_one_by_one(spark):
    def picky(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0]] * len(texts)

    chunks = spark.createDataFrame([(f"h{i}", "bad" if i == 3 else "t") for i in range(20)], "content_hash string, content_text string")
    counts = {r["status"]: r["n"] for r in index.index_counts(index.embed(chunks, picky, 16)).collect()}
    assert counts == {"embedded": 19, "failed": 1}
    with pytest.raises(ValueError):
        index.embed(chunks, picky, 0)


def test_vector_blobs(spark):
    import numpy as np

    df = spark.createDataFrame([(1, bytearray(np.array([1.5, -2], "<f4").tobytes())), (2, bytearray(b"abc")), (3, None)], "i int, embedding binary")
    assert {r["i"]: r["embedding"] for r in unpack_vectors(df).collect()} == {1: [1.5, -2.0], 2: None, 3: None}
    arrays = spark.createDataFrame([(1, [0.1, -3.5]), (2, []), (3, None)], "i int, embedding array<float>")
    packed = pack_vectors(arrays)
    assert {r["i"]: r["embedding"] and bytes(r["embedding"]) for r in packed.collect()}[1] == np.array([0.1, -3.5], "<f4").tobytes()
    assert sorted(map(tuple, unpack_vectors(packed).collect()), key=lambda r: r[0]) == sorted(map(tuple, arrays.collect()), key=lambda r: r[0])


def test_search_json(spark):
    rows = [(2, "h2", "b.go", "go", "lines", 31, 40, 0.25, "y"), (1, "h1", "a.py", "python", "lines", 1, 30, 0.5, "x")]
    df = spark.createDataFrame(rows, "rank int, content_hash string, rel_path string, language string, kind string, line_start int, line_end int, score double, content_text string")
    got = json.loads(search.as_json(df, "what", 2).first()["json"])
    first = {"chunkId": "h1", "relPath": "a.py", "language": "python", "kind": "lines", "lineStart": 1, "lineEnd": 30, "score": 0.5, "content": "x"}
    assert got["query"] == "what" and got["k"] == 2 and got["results"][0] == first and [r["chunkId"] for r in got["results"]] == ["h1", "h2"]


def test_listing_opens_no_file(spark, tree):
    os.chmod(tree / "thirty.py", 0)
    listed = {r["rel_path"]: r["size"] for r in list_tree(spark, str(tree)).collect()}
    assert listed == {r["rel_path"]: r["size"] for r in read_tree(spark, str(tree)).collect()}


def walked(root, **kept):
    """Eligible files by a plain walk."""
    out = {}
    for folder, below, names in os.walk(root):
        below[:] = [d for d in below if d not in scan.SKIPPED and not d.startswith(".backup-")]
        for name in names:
            path = os.path.join(folder, name)
            suffix = name[name.rindex(".") :].lower() if "." in name else ""
            if suffix in scan.LANGUAGES and not os.path.islink(path) and os.path.getsize(path) <= scan.MAX_FILE_BYTES:
                out[os.path.relpath(path, root)] = os.path.getsize(path)
    return out


@pytest.fixture
def wide(tmp_path):
    """Folders of many depths and a folder of many files."""
    root = tmp_path / "wide"
    for k in range(400):
        at = root / "/".join(f"d{(k >> j) % 3}" for j in range(k % 6))
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}.{('py', 'go', 'txt', 'md')[k % 4]}").write_text("x\n" * (k % 50))
    return root


@pytest.mark.parametrize("folders", ["1", "3", "20", "100000"])
def test_walk_is_shared_out_by_folders(spark, wide, folders):
    want = walked(wide)
    got = list_tree(spark, str(wide), folders=folders, files="10", tasks="7").collect()
    assert {r["rel_path"]: r["size"] for r in got} == want and len(got) == len(want)
    reader = tree_source._Reader({"path": str(wide), "folders": folders, "files": "10", "tasks": "7"})
    units = [u for p in reader.partitions() for u in p.units]
    assert len(units) <= int(folders) + 3 + 40 and not any(name in str(units) for name in want if name.count("/") == 0)
    assert all(os.path.isdir(wide / u[0]) for u in units)


def opened(monkeypatch, root, filters, **options):
    """The files that a reader with these filters opens, all in this process."""
    seen = []
    monkeypatch.setattr(tree_source._Reader, "_content", lambda self, path: (seen.append(path), (b"", None))[1])
    reader = tree_source._Reader({"path": str(root), **options})
    assert list(reader.pushFilters(filters)) == []
    for p in reader.partitions():
        list(reader.read(p))
    return sorted(seen)


def test_only_wanted_files_are_opened(monkeypatch, wide):
    every, at = walked(wide), ("rel_path",)
    paths = sorted(every)
    assert opened(monkeypatch, wide, []) == paths
    assert opened(monkeypatch, wide, [], contents="false") == []
    assert opened(monkeypatch, wide, [ds.EqualTo(("language",), "go")]) == [p for p in paths if p.endswith(".go")]
    assert opened(monkeypatch, wide, [ds.In(("language",), ("go", "markdown")), ds.LessThan(("size",), 20)]) == [p for p in paths if p.endswith((".go", ".md")) and every[p] < 20]
    for cut in (paths[0], paths[57], "d1", "d1/", "d1/d2/f", paths[-1]):
        assert opened(monkeypatch, wide, [ds.LessThanOrEqual(at, cut)]) == [p for p in paths if p <= cut]
        assert opened(monkeypatch, wide, [ds.LessThan(at, cut)]) == [p for p in paths if p < cut]
        assert opened(monkeypatch, wide, [ds.GreaterThan(at, cut)]) == [p for p in paths if p > cut]
        assert opened(monkeypatch, wide, [ds.GreaterThanOrEqual(at, cut)]) == [p for p in paths if p >= cut]
        assert opened(monkeypatch, wide, [ds.StringStartsWith(at, cut)]) == [p for p in paths if p.startswith(cut)]
        assert opened(monkeypatch, wide, [ds.EqualTo(at, cut)]) == [p for p in paths if p == cut]
    left = [ds.EqualNullSafe(at, "x"), ds.EqualTo(("content",), b"")]
    assert list(tree_source._Reader({"path": str(wide)}).pushFilters(left)) == left


def test_folders_beyond_a_bound_are_not_entered(monkeypatch, wide):
    looked = []
    real = os.scandir
    monkeypatch.setattr(tree_source.os, "scandir", lambda p: (looked.append(os.path.relpath(p, wide)), real(p))[1])
    opened(monkeypatch, wide, [ds.LessThanOrEqual(("rel_path",), "d0/f")])
    assert looked and all(p == "." or p.startswith("d0") for p in looked)


def test_filters_reach_the_source(spark, wide):
    every = walked(wide)
    got = read_tree(spark, str(wide)).where("language = 'go' AND rel_path <= 'd1/f' AND size < 40 AND text IS NOT NULL")
    assert {r["rel_path"] for r in got.collect()} == {p for p, n in every.items() if p.endswith(".go") and p <= "d1/f" and n < 40}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "source_tree" in plan and not any(x in plan for x in ("= go", "<= d1/f", "< 40"))  # only the filter on text is left above the scan
    result = api.analyze(spark, str(wide), most=200)
    assert result.truncated and result.scanned_files == sum(sum(every[q] for q in sorted(every)[: k + 1]) <= 200 for k in range(len(every)))


def test_unreachable_server(spark):
    wanted = spark.createDataFrame([("m",)], "name string")
    assert "can't reach" in remote.readiness(wanted, None, "http://localhost:1").first()["message"]


def test_analyze_and_reports(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    key = "AK" + "IA" + "ABCDEFGH12345678"
    (root / "config.ts").write_text(f"\nconst k = '{key}';\n")
    (root / "util.ts").write_text(f"const k = '{key}';\n")
    result = api.analyze(spark, str(root))
    found = result.findings
    assert result.over and found.count() == 2 and (result.scanned_files, result.truncated) == (2, False)
    first = api.analyze(spark, str(root), most=45)
    assert (first.scanned_files, first.truncated) == (1, True)
    out = tmp_path / "log.sarif"
    sinks.write_sarif(found, str(out))
    log = json.loads(out.read_text())
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 1 and len(run["results"]) == 2
    assert run["tool"]["driver"]["rules"][0]["id"] == "secrets/aws-access-key" and run["results"][0]["level"] == "error"
    lines = list(sinks.table_lines(found))
    assert lines[0].startswith("[CRITICAL]  config.ts:2  ") and lines[1].startswith("       ↳ ") and lines[-2:] == ["", "2 total — 2 critical"]
    assert list(sinks.table_lines(found.limit(0))) == ["✓ No security findings."]
    assert sinks.summary(found.withColumn("severity", F.lit("odd"))) == "0 findings"
    assert key not in out.read_text()
    sinks.write_ndjson(found, str(tmp_path / "nd"))
    assert spark.read.json(str(tmp_path / "nd")).count() == 2
    os.symlink(out, tmp_path / "link.sarif")
    with pytest.raises(ValueError):
        sinks.write_sarif(found, str(tmp_path / "link.sarif"))
    with pytest.raises(ValueError):
        sinks.write_sarif(found, "/etc/x.sarif")
