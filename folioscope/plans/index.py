"""Indexing runs: documents to stored chunks with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.chunking import chunk_documents
from folioscope.operators.embedding import Embedder, embed_chunks
from folioscope.sources.store import ChunkTable, Written, reindex_report


def reindex(docs: DataFrame, table: ChunkTable, embedder: Embedder, rejects: DataFrame | None = None, size: int = 500, overlap: int = 50) -> tuple[DataFrame, Written]:
    """Chunk and embed all documents anew, put them in the table's place, and report every file.

    Readers see the old table or the new one. A document without any text is a success with no chunks.
    """
    written = table.rebuild(embed_chunks(chunk_documents(docs, size, overlap), embedder))
    stored = table.read(written.version).select("source")
    return reindex_report(docs, stored, rejects), written
