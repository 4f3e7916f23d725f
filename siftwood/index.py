"""The tables of an index, each row once: what the answers are computed from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.paths import DEPENDENCY_KINDS
from siftwood.tables import table


class Index:
    """The files, symbols, edges, chunks and resources of a folder.

    Exact copies fold. Of several rows of a file the one indexed last counts; ties
    go to the larger size, then the larger hash.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def files(self) -> DataFrame:
        rows = self.raw("files")
        rest = [c for c in rows.columns if c not in ("file_id", "indexed_at", "size", "hash")]
        newest = F.max(F.struct("indexed_at", "size", "hash", *rest)).alias("row")
        return rows.groupBy("file_id").agg(newest).select("file_id", *[F.col(f"row.{c}").alias(c) for c in rows.columns if c != "file_id"])

    @cached_property
    def symbols(self) -> DataFrame:
        return self.raw("symbols").dropDuplicates(["symbol_id"])

    @cached_property
    def edges(self) -> DataFrame:
        return self.raw("edges").dropDuplicates(["edge_id"])

    @cached_property
    def chunks(self) -> DataFrame:
        return self.raw("chunks").dropDuplicates(["chunk_id"])

    @cached_property
    def resources(self) -> DataFrame:
        return self.raw("resources").dropDuplicates(["resource_id"])

    @cached_property
    def paths(self) -> DataFrame:
        return self.files.select("file_id", "rel_path")

    def file_edges(self, kinds=DEPENDENCY_KINDS) -> DataFrame:
        """src and dst of the resolved edges between files, one row per edge, with edge_id and kind."""
        rows = self.edges.where((F.col("src_type") == "file") & (F.col("dst_type") == "file") & F.col("resolved") & F.col("dst_id").isNotNull())
        if kinds is not None:
            rows = rows.where(F.col("kind").isin(*kinds))
        return rows.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "edge_id", "kind")

    def links(self, kinds=DEPENDENCY_KINDS) -> DataFrame:
        """src_path and dst_path of the resolved edges between files that both have a row."""
        p, q = self.paths.alias("p"), self.paths.alias("q")
        rows = self.file_edges(kinds).alias("e").join(p, F.col("e.src") == F.col("p.file_id")).join(q, F.col("e.dst") == F.col("q.file_id"))
        return rows.select("e.edge_id", "e.kind", "e.src", "e.dst", F.col("p.rel_path").alias("src_path"), F.col("q.rel_path").alias("dst_path"))
