"""Hybrid search over a word index and a vector index of the same chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atheneum.operators import vector_index, word_index
from atheneum.operators.retrieval import POOL, TOP_K, fuse, results, within


@dataclass(frozen=True)
class ChunkIndex:
    words: word_index.WordIndex
    vectors: vector_index.VectorIndex

    def search(self, chunks: DataFrame, files: DataFrame, text: str, vector: list[float], top_k: int = TOP_K, folder: str | None = None, kind: str | None = None, window: int = 3, pool: int = POOL) -> DataFrame:
        """As retrieval.search, but each channel reads its index: the postings of the query's words, and the cells in reach of the vector."""
        cand, where = max(pool, top_k), within(folder, kind)
        hits = fuse(self.vectors.nearest(vector, cand, where=where), self.words.match(text, where, cand), min(cand, 3 * top_k))
        return results(hits, chunks, files, top_k, window)


def build(chunks: DataFrame, files: DataFrame, path: str) -> ChunkIndex:
    """Indexes of chunks (chunk_id, file_id, text, kind, embedding) of files (file_id, folder) in a new folder, to be filtered by folder and kind."""
    of = chunks.join(files.select("file_id", "folder"), "file_id").withColumnRenamed("chunk_id", "id")
    words = word_index.build(of.select("id", "text", "folder", "kind"), f"{path}/words")
    return ChunkIndex(words, vector_index.build(of.select("id", F.col("embedding").alias("vector"), "folder", "kind"), f"{path}/vectors"))
