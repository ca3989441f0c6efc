"""Unified diffs: touched files, line kinds, plans for backup and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import text as X

ABSENT = ".was-absent"


def _lines(patches: DataFrame) -> DataFrame:
    return patches.select("patch_id", F.posexplode(F.split("patch", "\n", -1)).alias("pos", "line"))


def usable(patches: DataFrame) -> DataFrame:
    """Patches with something in them."""
    return patches.where(X.trimmed(F.col("patch")) != "")


def verdicts(patches: DataFrame) -> DataFrame:
    """(patch_id, n_files, verdict): "empty", "touches no files", "unsafe path", or "ok" for a patch that may be applied."""
    files = patch_files(patches).groupBy("patch_id").agg(F.count("*").alias("n_files"), F.bool_or("unsafe").alias("unsafe"))
    said = F.when(X.trimmed(F.col("patch")) == "", "empty").when(F.col("n_files").isNull(), "touches no files").when(F.col("unsafe"), "unsafe path").otherwise("ok")
    return patches.join(files, "patch_id", "left").select("patch_id", F.coalesce("n_files", F.lit(0)).alias("n_files"), said.alias("verdict"))


def patch_files(patches: DataFrame) -> DataFrame:
    """(patch_id, path, first_pos, unsafe): each file a patch touches, once; one bad path makes the whole patch unsafe."""
    name = F.regexp_replace(F.substring("line", 5, 1 << 30), "^b/", "")
    headers = _lines(patches).where(F.col("line").startswith("+++ ")).select("patch_id", "pos", X.trimmed(F.regexp_replace(name, r"^([^\t]+)\t[\s\S]*\z", "$1")).alias("path"))
    files = headers.where(~F.col("path").isin("", "/dev/null")).groupBy("patch_id", "path").agg(F.min("pos").alias("first_pos"))
    bad = files.groupBy("patch_id").agg(F.bool_or(P.path_problem(F.col("path")).isNotNull()).alias("unsafe"))
    return files.join(bad, "patch_id").select("patch_id", "path", "first_pos", "unsafe")


_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_lines(patches: DataFrame) -> DataFrame:
    """(patch_id, pos, hunk, path, creates, kind, old_line, text): the lines inside hunks, kind "context", "delete" or "add".

    A hunk holds as many lines as its header counts, so text in it that looks like a
    header isn't one. ``old_line`` is the line's number in the file as it was, null for added
    ones; ``path`` is the new name, or the old one of a file that goes; ``creates`` is true
    where there was none.
    """
    upto = Window.partitionBy("patch_id").orderBy("pos")
    inside = Window.partitionBy("patch_id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    part = lambda k: F.regexp_extract("line", _HUNK, k)
    count = lambda k: F.when(part(k) == "", 1).otherwise(part(k).try_cast("int"))
    header = F.col("line").rlike(_HUNK)
    rows = _lines(patches).withColumn("hunk", F.count_if(header).over(upto))
    first = lambda c: F.first(c).over(Window.partitionBy("patch_id", "hunk").orderBy("pos"))
    sign = F.left("line", F.lit(1))
    before = lambda *signs: F.coalesce(F.count_if(sign.isin(*signs) & ~header).over(inside), F.lit(0))
    rows = rows.withColumns({"__old": before(" ", "-", ""), "__new": before(" ", "+", ""), "__at": first(part(1).try_cast("int")), "__olds": first(count(2)), "__news": first(count(4))})
    body = (F.col("hunk") > 0) & ~header & ((F.col("__old") < F.col("__olds")) | (F.col("__new") < F.col("__news")))
    name = lambda c: F.when(~F.col("__body") & F.col("line").startswith(c), X.trimmed(F.regexp_replace(F.regexp_replace(F.substring("line", 5, 1 << 30), "^[ab]/", ""), r"^([^\t]+)\t[\s\S]*\z", "$1")))
    rows = rows.withColumn("__body", body)
    named = rows.withColumns({"__from": F.last(name("--- "), ignorenulls=True).over(upto), "__to": F.last(name("+++ "), ignorenulls=True).over(upto)})
    kept = named.where(F.col("__body") & ~F.col("line").startswith("\\"))
    kind = F.when(sign == "+", "add").when(sign == "-", "delete").otherwise("context")
    return kept.select(
        "patch_id", "pos", "hunk", F.when(F.col("__to") == "/dev/null", F.col("__from")).otherwise(F.col("__to")).alias("path"), (F.col("__from") == "/dev/null").alias("creates"),
        kind.alias("kind"), F.when(sign != "+", F.col("__at") + F.col("__old")).cast("int").alias("old_line"), F.substring("line", 2, 1 << 30).alias("text"),
    )


def applicable(patches: DataFrame, files: DataFrame) -> DataFrame:
    """(patch_id, verdict, path, line): as ``verdicts``, and "doesn't apply" with the first line of the patch that the files (path, text) don't bear out.

    Old lines must stand at the numbers that the hunks give; a file that is created must not
    be there, which fails at line 0. Lines are matched by a join on path and number, and
    only files that some patch names are cut into lines.
    """
    wanted = hunk_lines(patches)
    old = wanted.where("old_line IS NOT NULL")
    there = files.join(wanted.select("path").distinct(), "path", "left_semi")
    lines = there.select("path", F.posexplode(F.split("text", "\n", -1)).alias("__k", "__text")).select("path", (F.col("__k") + 1).alias("old_line"), "__text")
    missed = old.join(lines, ["path", "old_line"], "left").where(F.col("__text").isNull() | (F.col("__text") != F.col("text"))).select("patch_id", "pos", "path", "old_line")
    made = wanted.where("creates").groupBy("patch_id", "path").agg(F.min("pos").alias("pos")).join(there.select("path"), "path", "left_semi").select("patch_id", "pos", "path", F.lit(0).alias("old_line"))
    first = missed.unionByName(made).groupBy("patch_id").agg(F.min(F.struct("pos", "path", "old_line")).alias("__miss"))
    said = verdicts(patches).join(first, "patch_id", "left")
    fails = (F.col("verdict") == "ok") & F.col("__miss").isNotNull()
    return said.select("patch_id", F.when(fails, "doesn't apply").otherwise(F.col("verdict")).alias("verdict"), F.when(fails, F.col("__miss.path")).alias("path"), F.when(fails, F.col("__miss.old_line")).alias("line"))


def line_kind(line: Column) -> Column:
    return F.when(line.startswith("+++") | line.startswith("---") | line.startswith("diff "), "header").when(line.startswith("+"), "add").when(line.startswith("-"), "delete").otherwise("other")


def patch_line_stats(patches: DataFrame) -> DataFrame:
    """(patch_id, kind, n)"""
    return _lines(patches).groupBy("patch_id", line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


def backup_name(as_of: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), X.compact_utc(as_of))


def backup_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """(patch_id, path, action, target): a touched file is copied if it exists, else marked as absent."""
    there = files.join(existing.select("path", F.lit(True).alias("exists")), "path", "left")
    return there.select("patch_id", "path", F.when(F.col("exists"), "copy").otherwise("mark_absent").alias("action"), F.when(F.col("exists"), F.col("path")).otherwise(F.concat("path", F.lit(ABSENT))).alias("target"))


def latest_backup(names: DataFrame, prefix: str, stamp: str | None = None) -> DataFrame:
    """One row ``name``: the newest folder of the prefix, or that of the stamp; null if there is none."""
    some = names.where(F.col("name").startswith(prefix))
    return some.where(F.col("name") == prefix + stamp).agg(F.max("name").alias("name")) if stamp else some.agg(F.max("name").alias("name"))


def restore_plan(entries: DataFrame) -> DataFrame:
    """(rel_path, action, target): marked files are deleted, all others are put back."""
    marked = F.col("rel_path").endswith(ABSENT)
    return entries.select("rel_path", F.when(marked, "delete").otherwise("restore").alias("action"), F.when(marked, F.left("rel_path", F.length("rel_path") - len(ABSENT))).otherwise(F.col("rel_path")).alias("target"))


def restore_counts(plan: DataFrame) -> DataFrame:
    """One row (restored, deleted)."""
    return plan.agg(F.count_if(F.col("action") == "restore").alias("restored"), F.count_if(F.col("action") == "delete").alias("deleted"))


def source_mismatch(a: Column, b: Column) -> Column:
    """True if two sources differ in more than case and both are known."""
    return (a != "") & (b != "") & (F.lower(a) != F.lower(b))
