"""One object for a user: an index folder, and a method for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.index import Index
from siftwood.operators import graph, health, hierarchy, hybrid, knowledge, packets, reads, references, search, stats
from siftwood.sinks.store import Store
from siftwood.streaming import refresh as streaming


class Engine:
    """The answers over the tables of a folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.index = spark, Index(spark, folder)

    @classmethod
    def published(cls, spark: SparkSession, root: str) -> Engine:
        """Over the generation that a store has published."""
        return cls(spark, Store(spark, root).current())

    def find(self, name: str) -> DataFrame:
        found = search.find(self.index, name)
        return found if found.limit(1).count() else search.fuzzy(self.index, name)

    def definition(self, name: str, most: int = 200) -> DataFrame:
        """rel_path, start_line, end_line and text of the chunks that hold the definitions of a name."""
        rows = search.exact(self.index, name).join(self.index.paths, "rel_path").select("symbol_id", "rel_path", "file_id", F.col("start_line").alias("a"), F.least(F.col("end_line"), F.col("start_line") + most).alias("b"))
        met = rows.join(self.index.chunks, "file_id").where("start_line <= b and end_line >= a")
        low = F.greatest(F.col("start_line"), F.col("a"))
        return met.select("symbol_id", "rel_path", low.alias("start_line"), F.least("end_line", "b").alias("end_line"), knowledge.peek(F.col("text"), low - F.col("start_line") + 1, F.least("end_line", "b") - F.col("start_line") + 1).alias("text"))

    def span(self, name: str) -> DataFrame:
        """symbol_id, rel_path, lines and digest of the definitions of a name."""
        return self.definition(name).withColumn("digest", knowledge.span_digest(F.col("text"), F.lit(1), F.col("end_line") - F.col("start_line") + 1)).drop("text")

    def outline(self, path: str) -> DataFrame:
        return reads.symbols_in_file(self.index, path).join(reads.nesting(self.index), "symbol_id", "left").orderBy("start_line", "symbol_id")

    def peek(self, path: str, first: int, last: int) -> DataFrame:
        rows = self.index.chunks.join(self.index.files.where(F.col("rel_path") == path).select("file_id"), "file_id", "left_semi").where((F.col("start_line") <= last) & (F.col("end_line") >= first))
        base = F.col("start_line") - 1
        return rows.select("start_line", knowledge.peek(F.col("text"), F.lit(first) - base, F.lit(last) - base).alias("text")).orderBy("start_line")

    def search(self, question: str, limit: int = 20) -> DataFrame:
        return search.ranked(self.index, question, limit)

    def hybrid(self, question: str, embeddings: DataFrame | None = None, query: DataFrame | None = None, limit: int = 20) -> DataFrame:
        """The chunks that words, vectors (vec_id, embedding; query holds the question's) and documentation find together, with their places."""
        found = hybrid.hybrid_search(self.index, question, embeddings, query, limit)
        lines = self.index.raw("chunks").select("chunk_id", "file_id", "start_line", "end_line").distinct()
        return found.join(lines, "chunk_id").join(self.index.paths, "file_id").select("position", "rel_path", "start_line", "end_line", "chunk_id").orderBy("position")

    def references(self, name: str) -> DataFrame:
        return search.call_sites(self.index, name)

    def callers(self, path: str) -> DataFrame:
        return reads.incoming(self.index, path)

    def callees(self, path: str) -> DataFrame:
        return reads.outgoing(self.index, path)

    def relations(self, path: str) -> DataFrame:
        """what, and the names of it: symbols, what the file includes, and what includes it."""
        s = reads.symbols_in_file(self.index, path).select(F.lit("symbol").alias("what"), "name")
        links = self.index.links(("includes",))
        a = links.where(F.col("src_path") == path).select(F.lit("includes").alias("what"), F.col("dst_path").alias("name"))
        b = links.where(F.col("dst_path") == path).select(F.lit("included_by").alias("what"), F.col("src_path").alias("name"))
        return s.unionByName(a).unionByName(b).distinct()

    def impact(self, path: str) -> DataFrame:
        return graph.blast(graph.dependents(self.index, path))

    def dependents(self, path: str) -> DataFrame:
        return graph.dependents(self.index, path)

    def entrypoints(self, path: str | None = None) -> DataFrame:
        return graph.entrypoints_for(self.index, path) if path else graph.entrypoints(self.index)

    def tests(self, path: str) -> DataFrame:
        return graph.tests_for(self.index, path)

    def changed(self, paths: DataFrame) -> DataFrame:
        """rel_path, depth of what the changed files (rel_path) reach backwards, the files themselves at depth 0."""
        own = self.index.paths.join(paths, "rel_path", "left_semi")
        starts = own.select(F.col("file_id").alias("id"))
        found = graph.reach(self.index.file_edges().select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts)
        return own.select("rel_path", F.lit(0).alias("depth")).unionByName(found.join(self.index.paths, F.col("id") == F.col("file_id")).select("rel_path", "depth"))

    def clusters(self) -> DataFrame:
        return graph.clusters(self.index)

    def hotspots(self) -> DataFrame:
        return stats.hotspots(self.index)

    def violations(self) -> DataFrame:
        return health.violations(self.index)

    def doctor(self, commands: tuple[str, ...] = (), rules: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
        known = self.spark.createDataFrame([(c,) for c in commands], "name string")
        return health.findings(self.index, known, list(rules))

    def context(self, question: str, budget: int = packets.BUDGET) -> DataFrame:
        return packets.packet(self.index, question, budget)

    def status(self) -> DataFrame:
        return stats.counts(self.index)

    def brief(self, scope: str, limit: int = 10) -> DataFrame:
        """rel_path, score, in_degree and size of the files of a folder that most depends on."""
        ranked = graph.pagerank(self.index.files.select(F.col("file_id").alias("id")), self.index.links().select("src", "dst"))
        rows = ranked.join(self.index.files, F.col("id") == F.col("file_id"))
        from siftwood.functions.paths import is_vendored

        clean = scope.strip("/")
        if clean and clean != ".":
            rows = rows.where((F.col("rel_path") == clean) | F.col("rel_path").startswith(clean + "/"))
        rows = rows.where(~is_vendored(F.col("rel_path"))).select("rel_path", F.round("score", 9).alias("score"), "in_degree", "size")
        return rows.orderBy(F.desc("score"), F.desc("in_degree"), F.desc("size"), "rel_path").limit(limit)

    def overview(self) -> dict[str, DataFrame]:
        """The parts of a first look at a tree."""
        return {
            "counts": stats.counts(self.index), "languages": stats.languages(self.index), "roles": stats.roles(self.index), "guides": stats.guides(self.index), "entrypoints": graph.entrypoints(self.index),
            "clusters": graph.clusters(self.index).orderBy(F.desc("files"), "label").limit(20), "palette": stats.palette(self.index).orderBy("name").limit(64), "central": graph.central_files(self.index, 8),
        }

    def hierarchy(self) -> DataFrame:
        return hierarchy.descendants(self.index.raw("symbols"))

    def dangling(self) -> DataFrame:
        return references.dangling(*(self.index.raw(n) for n in ("edges", "files", "symbols", "resources", "tombstones")))


def index_tree(store: Store, texts: DataFrame, **options) -> bool:
    """Index texts (rel_path, text, mtime) into a store, or bring it up to date with them."""
    return streaming.refresh(store, texts, **options)
