"""Vectors of chunks: quantisation, nearest neighbours, embedding, and what lacks a vector.

Nearest neighbours are exact. Queries and rows are packed into blocks, and every
block of queries meets every block of rows in one matrix product; only the best k
of a query in a block leave it. Neither side is gathered or sent to every task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block.
BLOCK = 2048


def quantized(vector: Column) -> Column:
    """The scale and the values of a vector as signed bytes: scale = largest absolute value / 127; zero stays zero."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = most / 127
    values = F.transform(vector, lambda x: F.when(scale > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale)))).otherwise(0).cast("tinyint"))
    return F.struct(F.round(scale, 9).alias("scale"), values.alias("values"))


def _blocks(vectors: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    n = max(1, -(-vectors.count() // BLOCK))
    packed = vectors.where(F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("b"))
    return packed.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v"))).alias("rows")).select(
        F.col("rows.k").alias(f"{prefix}_keys"), F.flatten("rows.v").alias(f"{prefix}_values")
    )


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance and rank of the k nearest rows by L2 distance; ties go to the smaller key; a row isn't its own neighbour."""
    met = _blocks(queries, key, vector, "q").crossJoin(_blocks(rows, key, vector, "r"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_keys, q_values, r_keys, r_values in batch.itertuples(index=False):
                a = np.asarray(q_values, np.float64).reshape(len(q_keys), -1)
                b = np.asarray(r_values, np.float64).reshape(len(r_keys), -1)
                square = (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]
                q_keys, r_keys = np.asarray(q_keys), np.asarray(r_keys)
                square = np.where(q_keys[:, None] == r_keys[None, :], np.inf, np.maximum(square, 0))
                m = min(k, square.shape[1])
                order = np.lexsort((np.broadcast_to(r_keys, square.shape), np.round(square, 12)), axis=1)[:, :m]
                found = np.take_along_axis(square, order, 1)
                frame = pd.DataFrame({"query_id": np.repeat(q_keys, m), key: r_keys[order].ravel(), "distance": np.sqrt(found).ravel()})
                yield frame[np.isfinite(frame["distance"])]

    near = met.mapInPandas(best, f"query_id bigint, {key} bigint, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 6), key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("distance", F.round("distance", 5))


def embeddable(text: Column) -> Column:
    """Whether a text is more than blanks."""
    return F.length(F.regexp_replace(text, r"[ \t\n\r]", "")) > 0


def backlog(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The chunks with something to embed that have no vector yet."""
    return chunks.where(embeddable(F.col("text"))).join(vectors.select(key), key, "left_anti")


def normalized_text(text: str) -> str:
    """Text as a word-piece vocabulary reads it: controls dropped, ideographs apart, accents off, lower case."""
    out = []
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or c in "\x00�" or kind.startswith("C") and c not in "\t\n\r":
            continue
        out.append(f" {c} " if 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF else " " if c.isspace() else c)
    return "".join(out)


def words(text: str) -> list[str]:
    """The words of normalized text; each mark is a word of its own."""
    out, word = [], ""
    for c in normalized_text(text):
        mark = unicodedata.category(c)[0] in "PS"
        if c.isspace() or mark:
            if word:
                out.append(word)
            word = ""
            if mark:
                out.append(c)
        else:
            word += c
    return out + [word] if word else out


def word_pieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[int]:
    """The ids of the longest pieces of each word, ## before those that go on; a word with a part that is unknown is unknown as a whole."""
    out: list[int] = []
    for word in words(text):
        pieces, at = [], 0
        while at < len(word) and len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), 0)
            if not end:
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += pieces if at == len(word) else [vocabulary[unknown]]
    return out


def embedder(vocabulary: dict[str, int], rows: np.ndarray, weights: np.ndarray):
    """A column function: the weighted mean of the rows of a text's pieces, at unit length; zeros for a text without any."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            ids = word_pieces(text or "", vocabulary)
            if not ids:
                return np.zeros(rows.shape[1], np.float32)
            mean = (rows[ids] * weights[ids, None]).sum(0)
            return (mean / (np.linalg.norm(mean) or 1.0)).astype(np.float32)

        return texts.map(one)

    return embed
