"""The whole tasks: analyze a tree, index it, search it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import chunking, index, report, scan, search, secrets
from quarryline.sources import git, staging
from quarryline.sources.store import PART, ChunkStore
from quarryline.sources.tree import list_tree, read_tree


@dataclass(frozen=True)
class Analysis:
    """``truncated``: files were left out because the scan's bytes were used up; ``over``: the threshold is reached."""

    findings: DataFrame
    scanned_files: int
    truncated: bool
    over: bool


def analyze(spark: SparkSession, path: str, fail_on: str = "high", most: int = scan.MAX_TOTAL_BYTES) -> Analysis:
    """Findings of a tree; at most ``most`` bytes are scanned, in path order."""
    listed = list_tree(spark, path).select("rel_path", "size")
    taken = scan.total_cap(listed, most)
    last, scanned = taken.agg(F.max("rel_path"), F.count("*")).first()
    # What is taken is a beginning of the order of paths, so the files to open are known by the last of them.
    some = read_tree(spark, path).where(F.col("rel_path") <= F.lit(last) if last is not None else F.lit(False))
    found = staging.table(secrets.findings(some.where("text is not null").select("rel_path", "text")), "findings")
    return Analysis(found, scanned, scanned < listed.count(), report.gate(found, fail_on))


def index_tree(spark: SparkSession, path: str, store_folder: str, embedder: index.Embedder | None = None, model: str = "hashing-64", batch: int = index.BATCH, part: int = PART) -> dict[str, int]:
    """Adds a tree's new chunks to a store; counts of files, chunks, unchanged, embedded and failed ones."""
    embedder = embedder or index.hashing_embedder()
    store = ChunkStore(spark, store_folder, model, len(embedder(["hello"])[0]))
    seen = Observation("files")
    files = read_tree(spark, git.root(path)).observe(seen, F.count(F.lit(1)).alias("n"))
    # The tree is read once: written chunks serve the counts, the look into the store and the model.
    chunks = staging.table(chunking.chunk_lines(files.select("rel_path", "language", "text")), "chunks")
    total = chunks.count()
    done = store.fill(chunks, embedder, batch, part)
    store.mark_indexed(git.head(path))
    return {"files": seen.get["n"], "chunks": total, "unchanged": total - sum(done.values()), **done}


def search_store(spark: SparkSession, store_folder: str, query: str, k: int = 10, languages: list[str] | None = None, embedder: index.Embedder | None = None, model: str = "hashing-64") -> DataFrame:
    """The k nearest chunks of a question."""
    if not query.strip():
        raise ValueError("an empty query")
    vector = (embedder or index.hashing_embedder())([query.strip()])[0]
    return search.search(ChunkStore(spark, store_folder, model, len(vector)).chunks(), vector, k, languages, norm="norm").orderBy("rank").withColumn("query", F.lit(query.strip()))
