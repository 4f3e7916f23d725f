"""Search by words, by vectors and by documentation together.

Every list that takes part is cut before it is ranked, so windows run over at most
`limit` rows of one question. Lists are keyed by chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.index import Index
from siftwood.operators import fusion, search, vectors


def doc_chunks(index: Index, question: str, limit: int = 50) -> DataFrame:
    """chunk_id, tier and position of the chunks that hold the symbols whose documentation answers, the best first."""
    found = search.search_docs(index, question, limit).join(index.symbols.select("symbol_id", "file_id", F.col("start_line").alias("at")), "symbol_id")
    # the chunks of a few files, without their texts
    lines = index.raw("chunks").select("chunk_id", "file_id", "start_line", "end_line")
    near = lines.join(found.select("file_id").distinct(), "file_id", "left_semi").distinct()
    held = found.join(near, "file_id").where(F.col("at").between(F.col("start_line"), F.col("end_line")))
    best = held.groupBy("chunk_id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), "symbol_id")).alias("m"))
    rows = best.select("chunk_id", F.col("m.tier").alias("tier"), "m.s", "m.symbol_id")
    return rows.withColumn("position", F.row_number().over(Window.orderBy("tier", "s", "symbol_id"))).select("chunk_id", "tier", "position")


def lexical(index: Index, question: str, limit: int = 20) -> DataFrame:
    """chunk_id and position of the ranked search."""
    order = Window.orderBy("class", F.desc("concept"), "ordinal")
    return search.placed(index, question, limit).withColumn("position", F.row_number().over(order)).select("chunk_id", "position")


def plain_search(index: Index, question: str, limit: int = 20) -> DataFrame:
    """chunk_id and position: the ranked search, with up to three chunks that only documentation finds put in."""
    return fusion.doc_recall(lexical(index, question, limit), doc_chunks(index, question, limit), "chunk_id", limit)


def near_chunks(index: Index, embeddings: DataFrame, query: DataFrame, limit: int = 20) -> DataFrame:
    """chunk_id and rank of the chunks whose vectors are nearest to the one row of query (vec_id, embedding)."""
    known = embeddings.join(index.raw("chunks").select(F.col("chunk_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return vectors.nearest(query, known.select("vec_id", "embedding"), limit).select(F.col("vec_id").alias("chunk_id"), "rank")


def hybrid_search(index: Index, question: str, embeddings: DataFrame | None = None, query: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """chunk_id and position: vectors and words fused by reciprocal rank, vectors first on ties, then documentation put in.

    Without vectors, or without one for the question, this is the plain search.
    """
    if embeddings is None or query is None or not query.limit(1).count():
        return plain_search(index, question, limit)
    near = near_chunks(index, embeddings, query, limit).select("chunk_id", F.lit(0).alias("list_no"), "rank")
    words = lexical(index, question, limit).select("chunk_id", F.lit(1).alias("list_no"), F.col("position").alias("rank"))
    fused = fusion.reciprocal_rank(near.unionByName(words), "chunk_id", limit)
    base = fused.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "list_no", "rank"))).select("chunk_id", "position")
    return fusion.doc_recall(base, doc_chunks(index, question, limit), "chunk_id", limit)
