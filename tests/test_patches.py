"""Hunks held against files, as git does."""

from __future__ import annotations

import difflib
import random
import subprocess

from quarryline.operators import patches


def verdicts(spark, rows, files):
    got = patches.applicable(spark.createDataFrame(rows, "patch_id string, patch string"), spark.createDataFrame(list(files.items()), "path string, text string"))
    return {r["patch_id"]: (r["verdict"], r["path"], r["line"]) for r in got.collect()}


def diff(path, old, new, context=3):
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}", n=context))


def test_patches_of_documents_against_git(spark, sf, tmp_path):
    draw, rows, files = random.Random(2), [], {}
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) BETWEEN 200 AND 4000").orderBy("doc_id").limit(40).collect()]
    for i, text in enumerate(texts):
        lines = [x.strip("\r\f\v\x1c\x1d\x1e\x85\u2028\u2029") or f"l{i}" for x in text.split("\n")]
        old = "".join(f"{x} {k}\n" for k, x in enumerate(lines * 3))  # the number tells equal lines apart, so that git finds no other place
        changed = old.split("\n")
        for _ in range(3):
            changed[draw.randrange(len(changed) - 1)] = f"--- changed {draw.random()}"
        del changed[draw.randrange(len(changed) - 1)]
        patch = diff(f"d/f{i}.txt", old, "\n".join(changed), draw.randint(1, 3))
        now = old
        if i % 2:
            cut = old.split("\n")
            k = draw.randrange(len(cut) - 1)
            cut[k] += " edited since"
            now = "\n".join(cut)
        files[f"d/f{i}.txt"] = now
        rows.append((str(i), patch))
    got = verdicts(spark, rows, files)
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for i, patch in rows:
        fine = subprocess.run(["git", "-C", str(tmp_path), "apply", "--check", "-"], input=patch.encode(), capture_output=True).returncode == 0
        assert (got[i][0] == "ok") == fine, (i, got[i])
        if not fine:
            assert got[i][1] == f"d/f{i}.txt" and files[got[i][1]].split("\n")[got[i][2] - 1].endswith("edited since")
    assert {v[0] for v in got.values()} == {"ok", "doesn't apply"}


def test_created_deleted_missing_and_header_like_lines(spark):
    files = {"here.txt": "one\n-- two\n++ three\n", "gone.txt": "a\n"}
    rows = [
        ("create", "--- /dev/null\n+++ b/fresh.txt\n@@ -0,0 +1,2 @@\n+x\n+y\n"), ("create there", "--- /dev/null\n+++ b/here.txt\n@@ -0,0 +1 @@\n+x\n"),
        ("delete", "--- a/gone.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"), ("delete other", "--- a/gone.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-b\n"),
        ("missing", "--- a/no.txt\n+++ b/no.txt\n@@ -4 +4 @@\n-a\n+b\n"), ("like headers", "--- a/here.txt\n+++ b/here.txt\n@@ -1,3 +1,3 @@\n one\n--- two\n-++ three\n+++ b/else.txt\n+@@ -9 +9 @@\n"),
        ("two hunks", "--- a/here.txt\n+++ b/here.txt\n@@ -1 +1 @@\n-one\n+1\n@@ -3 +3 @@\n-three\n+3\n"), ("no end", "--- a/here.txt\n+++ b/here.txt\n@@ -3 +3 @@\n-++ three\n\\ No newline at end of file\n+x\n"),
        ("empty", ""), ("words", "nothing"), ("climbs", "--- a/x\n+++ b/../../x\n@@ -0,0 +1 @@\n+x\n"), ("beyond", "--- a/gone.txt\n+++ b/gone.txt\n@@ -9 +9 @@\n-a\n+b\n"),
    ]
    got = verdicts(spark, rows, files)
    assert got["create"] == got["like headers"] == got["no end"] == ("ok", None, None)
    assert got["create there"] == ("doesn't apply", "here.txt", 0) and got["delete"] == got["delete other"] == ("touches no files", None, None)
    assert got["missing"] == ("doesn't apply", "no.txt", 4) and got["two hunks"] == ("doesn't apply", "here.txt", 3) and got["beyond"] == ("doesn't apply", "gone.txt", 9)
    both = "--- a/gone.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-b\n" + rows[0][1]
    assert verdicts(spark, [("both", both)], files)["both"] == ("doesn't apply", "gone.txt", 1)
    assert [got[k][0] for k in ("empty", "words", "climbs")] == ["empty", "touches no files", "unsafe path"]
