"""Indexing a stream of files: each micro-batch adds the chunks that aren't stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarryline.operators import chunking, index
from quarryline.sources.store import ChunkStore


def index_stream(files: DataFrame, store: ChunkStore, embedder: index.Embedder, checkpoint: str, batch: int = index.BATCH) -> StreamingQuery:
    """Starts a query over streamed (rel_path, language, text) that ends when what is there has been read.

    A micro-batch that is run again adds nothing twice: rows are keyed by content hash.
    """

    def add(batch_df: DataFrame, _: int) -> None:
        store.fill(chunking.chunk_lines(batch_df), embedder, batch)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
