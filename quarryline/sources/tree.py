"""A source tree as rows (rel_path, size, language, content), read by a Python data source.

Spark's own file listing drops names that begin with a dot or an underscore, so the tree
is walked here: folders are pruned before they are entered, links are never followed. The
driver looks for folders only, breadth first and no more than it takes to busy the tasks; files
are listed and opened by the tasks, and only those that the pushed filters leave.
"""

from __future__ import annotations

import os
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from quarryline.functions import text as X
from quarryline.operators import scan

SCHEMA = "rel_path string, size long, language string, content binary, error string"
#: Folders that the driver finds at most, tasks, and files of one folder that a task gets, about.
FOLDERS, TASKS, FILES = 4096, 1024, 4096


class _Folders(InputPartition):
    """(folder, with all below it, share, shares): the files of a share are those whose names hash to it."""

    def __init__(self, units: list[tuple[str, bool, int, int]]):
        self.units = units


#: For each pushed filter: whether a value passes, and whether a folder, by the least path in it and the end of its paths, may hold one that does.
_TESTS: dict[type, tuple[Callable, Callable]] = {
    EqualTo: (lambda v, f: v == f.value, lambda low, high, f: low <= f.value < high),
    In: (lambda v, f: v in f.value, lambda low, high, f: any(low <= x < high for x in f.value if x is not None)),
    LessThan: (lambda v, f: v < f.value, lambda low, high, f: low < f.value),
    LessThanOrEqual: (lambda v, f: v <= f.value, lambda low, high, f: low <= f.value),
    GreaterThan: (lambda v, f: v > f.value, lambda low, high, f: high > f.value),
    GreaterThanOrEqual: (lambda v, f: v >= f.value, lambda low, high, f: high > f.value),
    StringStartsWith: (lambda v, f: v.startswith(f.value), lambda low, high, f: low.startswith(f.value) or f.value.startswith(low)),
    IsNotNull: (lambda v, f: True, lambda low, high, f: True),
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.prefix = options.get("backupPrefix", scan.BACKUP_PREFIX)
        self.folders, self.tasks, self.files = (int(options.get(k, v)) for k, v in (("folders", FOLDERS), ("tasks", TASKS), ("files", FILES)))
        self.contents = options.get("contents", "true") == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of path, size and language, which none of the rows lack; Spark keeps the others."""
        for f in filters:
            known = type(f) in _TESTS and f.attribute in (("rel_path",), ("size",), ("language",))
            if known and (isinstance(f, IsNotNull) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def _skipped(self, name: str) -> bool:
        return name in scan.SKIPPED or name.startswith(self.prefix)

    def _look(self, folder: str) -> tuple[list[str], int]:
        """The folders to enter in one folder, and how many entries it has besides."""
        below, others = [], 0
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        path = f"{folder}/{e.name}" if folder else e.name
                        if not self._skipped(e.name) and self._may_hold(path):
                            below.append(path)
                    else:
                        others += 1
        except OSError:  # a folder that can't be read has no files, as in any walk
            return [], 0
        return below, others

    def _may_hold(self, folder: str) -> bool:
        low, high = folder + "/", folder + "0"  # "0" is what follows "/"
        return all(_TESTS[type(f)][1](low, high, f) for f in self.filters if f.attribute == ("rel_path",))

    def _files(self, folder: str, share: int, shares: int) -> Iterator[tuple[str, int, str, int]]:
        """(rel_path, size, language, time of change) of a folder's own files that are small enough, of a known language, and pass the filters."""
        try:
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    name = e.name
                    language = scan.LANGUAGES.get(name[name.rindex(".") :].lower()) if "." in name else None
                    if language is None or zlib.crc32(os.fsencode(name)) % shares != share or not e.is_file(follow_symlinks=False):
                        continue
                    row = {"rel_path": f"{folder}/{name}" if folder else name, "language": language}
                    if not self._passes(row):
                        continue
                    known = e.stat(follow_symlinks=False)
                    row["size"] = known.st_size
                    if row["size"] <= scan.MAX_FILE_BYTES and self._passes(row):
                        yield row["rel_path"], row["size"], language, known.st_mtime_ns
        except OSError:
            return

    def _passes(self, row: dict) -> bool:
        return all(_TESTS[type(f)][0](row[f.attribute[0]], f) for f in self.filters if f.attribute[0] in row)

    def partitions(self) -> list[InputPartition]:
        if os.path.islink(self.root) or self._skipped(os.path.basename(self.root)):
            return [_Folders([])]
        waiting, units = deque([""]), []
        while waiting and len(waiting) + len(units) < self.folders:
            folder = waiting.popleft()
            below, others = self._look(folder)
            shares = -(-others // self.files)
            units += [(folder, False, k, shares) for k in range(shares)]
            waiting.extend(below)
        units += [(folder, True, 0, 1) for folder in waiting]
        n = max(1, min(self.tasks, len(units)))
        return [_Folders(units[k::n]) for k in range(n)]

    def changes(self, units: list[tuple[str, bool, int, int]]) -> Iterator[tuple[str, int, str, int]]:
        """(rel_path, size, language, time of change in nanoseconds) of the units' files."""
        for folder, deep, share, shares in units:
            left = [folder]
            while left:
                at = left.pop()
                yield from self._files(at, share, shares)
                if deep:
                    left += self._look(at)[0]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        return self.batches(found[:3] for found in self.changes(partition.units))

    def batches(self, files: Iterable[tuple[str, int, str]]) -> Iterator[pa.RecordBatch]:
        some = []
        for found in files:
            some.append((*found, *(self._content(found[0]) if self.contents else (None, None))))
            if len(some) == 64:
                yield _batch(some)
                some = []
        if some:
            yield _batch(some)

    def _content(self, path: str) -> tuple[bytes | None, str | None]:
        """The file's bytes, or why it can't be read: that is reported, never fatal."""
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return f.read(), None
        except OSError as e:
            return None, str(e)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("rel_path", pa.string()), ("size", pa.int64()), ("language", pa.string()), ("content", pa.binary()), ("error", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), kinds)], [name for name, _ in kinds])


class _Stream(DataSourceStreamReader):
    """Files by (time of change, path): a batch has those after the last one's end. The driver keeps the latest only, and lists no file for the tasks."""

    def __init__(self, options: dict[str, str]):
        self.settle = float(options.get("settleSeconds", 0))
        self.reader = _Reader(options)

    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = (-1, "")
        until = time.time_ns() - int(self.settle * 1e9)
        for path, _, _, changed in self.reader.changes([("", True, 0, 1)]):
            if last < (changed, path) and changed <= until:
                last = (changed, path)
        return {"mtime": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = self.reader.partitions()
        for p in parts:
            p.span = ((start["mtime"], start["path"]), (end["mtime"], end["path"]))
        return parts

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        after, until = partition.span
        return self.reader.batches((path, size, language) for path, size, language, changed in self.reader.changes(partition.units) if after < (changed, path) <= until)

    def commit(self, end: dict) -> None:
        """Nothing is kept for batches that are done."""


class TreeSource(DataSource):
    """``spark.read.format("source_tree").load(path)``; the path must be readable on the driver and the executors."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def _loaded(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The source, which takes filters where the session lets Python sources do so: that is switched on here."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("source_tree").options(**options).load(path)


def stream_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``read_tree`` as a stream: each micro-batch has the files that were added or changed since the last one.

    The offset is the (time of change, path) of the last file; a file that is moved in with
    an older time isn't seen. Files changed within the last ``settleSeconds`` wait for the
    next batch. What was read stays read across restarts, by the query's checkpoint.
    """
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("source_tree").options(**options).load(path).withColumn("text", X.decoded(F.col("content")))


def read_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(rel_path, size, language, content, error, text): every eligible file; ``text`` is null where the bytes aren't UTF-8.

    Filters on path, size and language decide which folders are entered and which files are opened.
    """
    return _loaded(spark, path, options).withColumn("text", X.decoded(F.col("content")))


def list_tree(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(rel_path, size, language): every eligible file, without opening any."""
    return _loaded(spark, path, options | {"contents": "false"}).select("rel_path", "size", "language")
