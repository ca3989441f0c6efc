"""The chunk store: Parquet in buckets of content hashes below languages, and a manifest that commits model and dimension."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import vectors as V
from quarryline.operators import index
from quarryline.sources import staging

SCHEMA = (
    "content_hash string, rel_path string, kind string, line_start int, line_end int, content_text string,"
    " embedding array<float>, norm double, created_at timestamp, language string"
)
VERSION = 2
#: Buckets of a new store, and batches that are stored together.
BUCKETS, PART = 16, 4096


class StoreMismatch(ValueError):
    """The store holds vectors of another model or dimension, or has another layout."""


class StoreBusy(RuntimeError):
    """Another process adds to the store."""


def write_json(path: str | Path, value: object) -> None:
    """Whole or not at all: a sibling file, readable by its owner only, takes the name when it is complete."""
    draft = f"{path}.tmp"
    with os.fdopen(os.open(draft, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        json.dump(value, f, indent=2)
    os.replace(draft, path)


class ChunkStore:
    """A store in a folder that the driver and the executors reach by the same path.

    Rows lie in ``buckets`` buckets by their hash, a number that the manifest keeps, so a
    look for known hashes moves the new chunks to the buckets and leaves the store where
    it is. Choose it by the size to come: a bucket is read by one task.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str, dim: int, buckets: int = BUCKETS):
        self.spark, self.folder = spark, Path(folder).resolve()
        (self.folder / "chunks").mkdir(parents=True, exist_ok=True)
        known = self.manifest()
        if known and (known.get("model"), known.get("dim")) != (model, dim):
            raise StoreMismatch(f"the store holds {known.get('model')} vectors of {known.get('dim')} numbers, not {model} of {dim}")
        if known and known.get("schema_version") != VERSION:
            raise StoreMismatch(f"the store has the layout of version {known.get('schema_version')}, not {VERSION}: index the tree anew")
        if not known:
            write_json(self.folder / "manifest.json", {"schema_version": VERSION, "model": model, "dim": dim, "buckets": buckets, "created_at": _now(), "last_indexed_sha": "", "last_indexed_at": ""})
        self.buckets = self.manifest()["buckets"]

    def manifest(self) -> dict:
        """Empty if there is none or it can't be read; it is then written anew."""
        try:
            found = json.loads((self.folder / "manifest.json").read_text())
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def _table(self) -> str:
        """The name by which this session knows the folder's rows, with the language folders that are there now."""
        name = "chunks_" + hashlib.sha256(str(self.folder).encode()).hexdigest()[:24]
        if not self.spark.catalog.tableExists(name):
            at = str(self.folder / "chunks").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet PARTITIONED BY (language) CLUSTERED BY (content_hash) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        self.spark.catalog.recoverPartitions(name)
        self.spark.catalog.refreshTable(name)
        return name

    def chunks(self) -> DataFrame:
        """The stored rows; a filter on ``language`` reads its folders only, and a join by ``content_hash`` doesn't move them."""
        return self.spark.table(self._table())

    def count(self) -> int:
        return self.chunks().count()

    @contextmanager
    def _adding(self) -> Iterator[None]:
        """One writer at a time looks for known hashes and appends; the lock goes with its process, however that ends."""
        with open(self.folder / "lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                raise StoreBusy(f"another process adds to {self.folder}") from None
            yield

    def _append(self, embedded: DataFrame) -> None:
        rows = embedded.where("status = 'embedded'").withColumns({"created_at": F.current_timestamp(), "norm": V.norm(F.col("embedding"))})
        name = self._table()
        rows.select(*self.spark.table(name).columns).repartition(self.buckets, "content_hash").write.insertInto(name)

    def add(self, embedded: DataFrame) -> None:
        """Appends embedded rows whose hash isn't stored. Run again after a failure, it adds what is missing."""
        with self._adding():
            self._append(index.new_chunks(embedded, self.chunks()))

    def fill(self, chunks: DataFrame, embedder: index.Embedder, batch: int = index.BATCH, part: int = PART) -> dict[str, int]:
        """Embeds and stores the chunks whose hash isn't stored, ``part`` batches at a time; the numbers that were embedded and that failed.

        Each part is stored when it is done. A run that stops has stored the parts before,
        and the next one takes up the rest; a lost executor costs its own batches.
        """
        with self._adding():
            # Batches are numbered by keys alone; texts move once, to where their hash's number is.
            keys = index.batches(index.new_chunks(chunks, self.chunks()).select("content_hash", "rel_path", "line_start"), batch)
            keys = keys.select("content_hash", "batch", "place", F.floor(F.col("batch") / part).alias("part"))
            fresh = chunks.dropDuplicates(["content_hash"]).join(keys, "content_hash")
            path, done = staging.write(fresh, "parts", "part"), {"embedded": 0, "failed": 0}
            last = self.spark.read.schema(fresh.schema).parquet(path).agg(F.max("part")).first()[0]
            for k in range(last + 1 if last is not None else 0):
                seen = Observation(f"part-{k}")
                rows = index.embed(self.spark.read.schema(fresh.drop("part").schema).parquet(f"{path}/part={k}"), embedder, batch)
                self._append(rows.observe(seen, *[F.count_if(F.col("status") == s).alias(s) for s in done]))
                done = {s: n + seen.get[s] for s, n in done.items()}
            staging.drop(self.spark, path)
        return done

    def mark_indexed(self, sha: str) -> None:
        """Only after a run that is complete, or that had nothing to do."""
        write_json(self.folder / "manifest.json", self.manifest() | {"last_indexed_sha": sha, "last_indexed_at": _now()})


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def unpack_vectors(rows: DataFrame, blob: str = "embedding", out: str = "embedding") -> DataFrame:
    """Little-endian 32-bit floats to arrays; a blob of another length than a multiple of 4 gives null."""
    fields = [f for f in rows.schema.fields if f.name not in (blob, out)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` array<float>"])

    def run(batches):
        for b in batches:
            blobs = b.column(b.schema.names.index(blob)).to_pylist()
            vectors = [None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in blobs]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(vectors, pa.list_(pa.float32()))], [*(f.name for f in fields), out])

    return rows.mapInArrow(run, schema)


def pack_vectors(rows: DataFrame, vector: str = "embedding", out: str = "embedding") -> DataFrame:
    """Arrays of floats to little-endian 32-bit floats, the inverse of ``unpack_vectors``; null stays null, an empty array gives an empty blob."""
    fields = [f for f in rows.schema.fields if f.name not in (vector, out)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` binary"])

    def run(batches):
        for b in batches:
            blobs = [None if x is None else np.array(x, "<f4").tobytes() for x in b.column(b.schema.names.index(vector)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(blobs, pa.binary())], [*(f.name for f in fields), out])

    return rows.mapInArrow(run, schema)
