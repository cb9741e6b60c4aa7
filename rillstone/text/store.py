"""A store of documents: parse, post-process, split, index, retrieve."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import bm25, glob_pattern, knn, metadata_filter, rank_fusion
from .split import null_chunks, split_texts


class DocumentStore:
    """docs: ``doc_id``, ``text``, ``metadata`` (Json text with path and modified_at).

    retrieve looks the chunks up by BM25; with an embedder (a column function
    from text to array<double>) by nearest vectors as well, both ranks fused.
    """

    def __init__(self, docs: DataFrame, chunker: Callable[[str], list[str]] | None = None, embedder: Callable[[Column], Column] | None = None, post: Sequence[Callable[[Column], Column]] = ()):
        text = F.col("text")
        for p in post:
            text = p(text)
        d = docs.select("doc_id", text.alias("text"), "metadata")
        cut = split_texts(d, "text", chunker) if chunker else null_chunks(d, "text")
        self.docs = docs
        self.chunks = cut.select(F.struct("doc_id", F.col("chunk_no").cast("int").alias("chunk_no")).alias("key"), "chunk", "metadata")
        self.chunks = self.chunks.withColumn("chunk_id", F.to_json("key"))
        self.embedder = embedder

    def retrieve(self, queries: DataFrame, k: int = 3, where: str | None = None, glob: str | None = None) -> DataFrame:
        """``query_id``, ``rank``, ``score``, ``chunk``, ``metadata`` for queries (query_id, query); where and glob filter by metadata."""
        c = self.chunks
        if where:
            c = c.where(metadata_filter(where, F.col("metadata")))
        if glob:
            c = c.where(F.get_json_object("metadata", "$.path").rlike(glob_pattern(glob)))
        by_text = bm25(c, "chunk_id", "chunk", queries, "query_id", "query", k).select("query_id", F.col("doc_id").alias("data_id"), "score", "rank")
        found = by_text
        if self.embedder:
            v = c.select("chunk_id", self.embedder(F.col("chunk")).alias("v"))
            q = queries.select("query_id", self.embedder(F.col("query")).alias("v"))
            near = knn(v, "chunk_id", "v", q, "query_id", "v", k, "cos").select("query_id", "data_id", "rank")
            found = rank_fusion(by_text.select("query_id", "data_id", "rank"), near, k=k)
        return found.join(c.select(F.col("chunk_id").alias("data_id"), "chunk", "metadata"), "data_id").select("query_id", "rank", "score", "chunk", "metadata")

    def statistics(self) -> DataFrame:
        """``file_count``, ``last_modified``."""
        m = F.get_json_object("metadata", "$.modified_at").cast("bigint")
        return self.docs.agg(F.count(F.lit(1)).alias("file_count"), F.max(m).alias("last_modified"))

    def inputs(self, where: str | None = None, glob: str | None = None) -> DataFrame:
        """The metadata of the documents that the filters take."""
        d = self.docs
        if where:
            d = d.where(metadata_filter(where, F.col("metadata")))
        if glob:
            d = d.where(F.get_json_object("metadata", "$.path").rlike(glob_pattern(glob)))
        return d.select("doc_id", "metadata")


def prompt(context: Column, query: Column, no_answer: str = "No information found.") -> Column:
    """A question-answering prompt from a joined context and a question."""
    return F.concat(F.lit("Answer the question from the context alone. If it holds no answer, say: "), F.lit(no_answer), F.lit("\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query)
