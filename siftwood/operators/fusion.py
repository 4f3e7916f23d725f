"""Fusion of ranked lists, and their re-ranking by an outside judge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion.
RANK_BASE = 60
#: Where answers found by documentation only come in, and how many.
RECALL_AT, RECALL_MOST = 11, 3


def reciprocal_rank(lists: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """key, score and first of lists (key, list_no, rank from 1): the sum of 1 / (60 + rank); ties go to what was seen first."""
    rows = lists.groupBy(key).agg(F.round(F.sum(1 / (F.lit(float(RANK_BASE)) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    return rows.orderBy(F.desc("score"), "first").limit(limit).select(key, "score", F.col("first.list_no").alias("list_no"), F.col("first.rank").alias("rank"))


def doc_recall(base: DataFrame, docs: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """key and position: the base order kept, up to three keys that only docs has put in at position 11, or at the end of a shorter base.

    base has key and position from 1, docs has key, tier and position.
    """
    placed = base.groupBy(key).agg(F.min("position").alias("p"))
    placed = placed.withColumn("position", F.row_number().over(Window.orderBy("p"))).select(key, "position")
    missed = docs.join(placed, key, "left_anti").groupBy(key).agg(F.min("tier").alias("tier"), F.min("position").alias("p"))
    missed = missed.withColumn("j", F.row_number().over(Window.orderBy("tier", "p"))).where(F.col("j") <= RECALL_MOST).select(key, "j")
    n, size = missed.count(), placed.count()
    at = min(RECALL_AT - 1, size)
    moved = placed.select(key, F.when(F.col("position") <= at, F.col("position")).otherwise(F.col("position") + n).alias("position"))
    return moved.unionByName(missed.select(key, (F.lit(at) + F.col("j")).alias("position"))).where(F.col("position") <= limit)


def parse_order(numbers: list[int], n: int) -> list[int]:
    """A permutation of 0..n-1 from numbers given by a judge: each in range once, the rest behind in order."""
    seen = list(dict.fromkeys(i for i in numbers if 0 <= i < n))
    return seen + [i for i in range(n) if i not in set(seen)]


def order_scores(order: list[int], n: int) -> list[float] | None:
    """(n - rank) / n for each place, or None if the order isn't a permutation of 0..n-1."""
    if sorted(order) != list(range(n)):
        return None
    out = [0.0] * n
    for rank, i in enumerate(order):
        out[i] = (n - rank) / n
    return out


def rerank(ranked: DataFrame, judge: Callable[[list[str]], list[int]] | None, text: str, most: int = 20) -> DataFrame:
    """The rows of ranked (with position) in the judge's order; unchanged without one. At most `most` rows are shown to it."""
    if judge is None:
        return ranked
    rows = ranked.orderBy("position").limit(most).collect()
    order = parse_order(judge([r[text] for r in rows]), len(rows))
    return ranked.sparkSession.createDataFrame([{**rows[i].asDict(), "position": k + 1} for k, i in enumerate(order)], ranked.schema)
