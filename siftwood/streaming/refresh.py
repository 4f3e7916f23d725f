"""Keeping an index up to date from a folder of arriving files, as a stream.

Every micro-batch is compared by hash with the generation that is published: only
what changed is read again; rows of vanished or changed files are replaced; then
everything is resolved anew, and a new generation is published. A batch that comes
again after a failure finds its files unchanged and publishes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftwood.functions import paths as P
from siftwood.operators import extraction, resolution
from siftwood.session import materialize
from siftwood.sinks.store import Store
from siftwood.sources.tree import changed

ARRIVING = T.StructType([T.StructField("rel_path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("mtime", T.TimestampType())])


def tables_of(files: DataFrame) -> dict[str, DataFrame]:
    """files, symbols, raw_edges, resources and chunks of texts (rel_path, text, mtime); ids are digests of path and place."""
    path = F.col("rel_path")
    rows = files.select(
        F.xxhash64(path).alias("file_id"), path, P.language(path, F.col("text")).alias("lang"), F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("hash"), "mtime", "text"
    ).withColumn("role", P.role(path, F.col("lang")))
    made = materialize(extraction.extracted(rows, "file_id"), "extracted")
    number = lambda what: F.xxhash64(F.lit(what), "file_id", "ordinal")
    symbols = extraction.table_of(made, "symbols").withColumn("symbol_id", number("symbol")).drop("ordinal")
    edges = extraction.table_of(made, "edges").withColumn("edge_id", number("edge")).drop("ordinal").withColumn("src_type", F.lit("file")).withColumn("src_id", F.col("file_id"))
    resources = extraction.table_of(made, "resources").withColumn("resource_id", number("resource")).drop("ordinal")
    chunks = extraction.table_of(made, "chunks").withColumn("chunk_id", number("chunk")).drop("ordinal")
    return {"files": rows.drop("text"), "symbols": symbols, "raw_edges": edges, "resources": resources, "chunks": chunks}


def publish(store: Store, tables: dict[str, DataFrame], manifests: resolution.Manifests | None = None) -> str:
    """Resolve the raw edges of all files and publish the tables as a generation."""
    edges = tables["raw_edges"].select("edge_id", "src_type", "src_id", "kind", "file_id", "line", "raw")
    blank = edges.withColumn("dst_type", F.lit(None).cast("string")).withColumn("dst_id", F.lit(None).cast("bigint")).withColumn("resolved", F.lit(False))
    resolved, fan = resolution.resolve(blank, tables["files"], tables["symbols"], tables["resources"], manifests)
    further = fan.select(
        F.xxhash64(F.lit("pkg"), "file_id", "dst_id", "line").alias("edge_id"), F.lit("file").alias("src_type"), F.col("file_id").alias("src_id"), F.lit("pkg").alias("kind"), "file_id", "line", "raw",
        F.lit("file").alias("dst_type"), "dst_id", F.lit(True).alias("resolved"),
    )
    columns = further.columns
    return store.publish({**tables, "edges": resolved.select(columns).unionByName(further)})


def refresh(store: Store, arrived: DataFrame, manifests: resolution.Manifests | None = None, gone: DataFrame | None = None) -> bool:
    """Bring the published tables up to date with arrived texts and gone files (rel_path); False if nothing changed."""
    latest = arrived.groupBy("rel_path").agg(F.max_by(F.struct("text", "mtime"), F.coalesce("mtime", F.lit(0).cast("timestamp"))).alias("row")).select("rel_path", "row.*")
    latest = materialize(latest.withColumn("hash", F.sha2("text", 256)), "arrived")
    if not store.about():
        publish(store, tables_of(latest), manifests)
        return True
    old = {n: store.table(n) for n in ("files", "symbols", "raw_edges", "resources", "chunks")}
    todo = materialize(changed(latest, old["files"]), "changed")
    lost = gone.select("rel_path") if gone is not None else latest.limit(0).select("rel_path")
    lost = materialize(old["files"].join(lost, "rel_path", "left_semi").select("rel_path"), "gone")
    if not todo.limit(1).count() and not lost.limit(1).count():
        return False
    new = tables_of(todo)
    out = materialize(new["files"].select("file_id").unionByName(lost.select(F.xxhash64("rel_path").alias("file_id"))), "replaced")
    both = {n: df.join(out, "file_id", "left_anti").unionByName(new[n]) for n, df in old.items()}
    publish(store, both, manifests)
    return True


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of texts that arrive as parquet files in a folder."""
    return spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_fresh(store: Store, stream: DataFrame, checkpoint: str, *, once: bool = True, every: str = "30 seconds", manifests: resolution.Manifests | None = None) -> StreamingQuery:
    """Refresh the store with each micro-batch; once: what is there now, then end."""

    def step(batch: DataFrame, _: int) -> None:
        refresh(store, batch, manifests)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def drain_backlog(store: Store, embed: Callable, batch_rows: int = 512, write_rows: int = 1_000_000) -> int:
    """Embed the chunks that have no vector yet and append them; how many there were.

    They are appended in writes of about write_rows, and what is appended stays, so a
    run that fails goes on where it ended. The session's batch setting is put back.
    """
    from siftwood.operators import vectors

    chunks = store.table("chunks").select("chunk_id", "text")
    try:
        known = store.log("vectors").select("chunk_id")
    except Exception:  # none written yet
        known = chunks.limit(0).select("chunk_id")
    todo = materialize(vectors.backlog(chunks, known), "backlog")
    n = todo.count()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf, before = todo.sparkSession.conf, todo.sparkSession.conf.get(key)
    conf.set(key, str(batch_rows))
    try:
        parts = -(-n // write_rows)
        for part in range(parts):
            some = todo.where(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == part)
            store.append("vectors", some.select("chunk_id", embed(F.col("text")).alias("embedding")))
    finally:
        conf.set(key, before)
    return n


def same_tree(before: DataFrame, after: DataFrame) -> bool:
    """Whether two listings (rel_path, size, hash) of the sources are the same: what came during a refresh asks for another."""
    from siftwood.sources.tree import signature

    return signature(before).first() == signature(after).first()
