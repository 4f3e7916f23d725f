"""Reads of the index: files, symbols, resources, chunks and edges by key, kind, name and place.

All of them are filters, projections and joins of the tables; nothing is collected.
Where an answer is limited, the order ends in a key, so that it is defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.index import Index


def all_files(index: Index) -> DataFrame:
    return index.files.select("file_id", "rel_path", "lang", "role", "size", "redacted")


def file_by_path(index: Index, path: str) -> DataFrame:
    """The file that a path names once its . and .. parts are folded."""
    return all_files(index).where(F.col("rel_path") == P.cleaned(F.lit(path)))


def symbols_in_file(index: Index, path: str) -> DataFrame:
    one = index.files.where(F.col("rel_path") == path).select("file_id", "rel_path")
    return index.symbols.join(one, "file_id").select("symbol_id", "name", "kind", "signature", "start_line", "end_line", "rel_path")


def symbols_of_kind(index: Index, kind: str) -> DataFrame:
    return index.symbols.where(F.col("kind") == kind).join(index.paths, "file_id").select("symbol_id", "name", "rel_path", "start_line")


def symbol_docs(index: Index) -> DataFrame:
    """The doc of every symbol that has one."""
    return index.symbols.where(F.length("doc") > 0).select("symbol_id", "doc")


def resources_with_files(index: Index) -> DataFrame:
    """All resources with the path of their file, if any."""
    return index.resources.join(index.paths, "file_id", "left").select("resource_id", "kind", "name", "value", "rel_path", "line")


def named_resources(index: Index) -> DataFrame:
    """name and kind of the named resources with their first id."""
    return index.resources.where(F.length("name") > 0).groupBy("name", "kind").agg(F.min("resource_id").alias("resource_id"))


def files_of_roles(index: Index, roles: list[str]) -> DataFrame:
    return index.files.where(F.col("role").isin(roles)).select("file_id", "rel_path", "role")


def file_ids(index: Index, paths: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """file_id and rel_path of all files, or of those named by path (rel_path) or by id (file_id)."""
    rows = index.paths
    if paths is not None:
        rows = rows.join(paths.select("rel_path").distinct(), "rel_path", "left_semi")
    if ids is not None:
        rows = rows.join(ids.select("file_id").distinct(), "file_id", "left_semi")
    return rows.select("file_id", "rel_path")


def first_chunks(index: Index) -> DataFrame:
    """The first chunk of every file, by start_line, then chunk_id."""
    order = Window.partitionBy("file_id").orderBy("start_line", "chunk_id")
    first = index.raw("chunks").select("file_id", "chunk_id", "start_line", "end_line").dropDuplicates(["chunk_id"])
    return first.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def chunks_at(index: Index, path: str, line: int) -> DataFrame:
    one = index.files.where(F.col("rel_path") == path).select("file_id")
    at = (F.col("start_line") <= line) & (F.col("end_line") >= line)
    return index.chunks.where(at).join(one, "file_id", "left_semi").select("chunk_id", "start_line", "end_line")


def redacted_files(index: Index) -> DataFrame:
    return index.files.where("redacted > 0").select("rel_path", "redacted")


def sizes_and_lines(index: Index) -> DataFrame:
    """Size and last line of every file; 0 lines without chunks."""
    lines = index.raw("chunks").groupBy("file_id").agg(F.max("end_line").alias("lines"))
    return index.files.join(lines, "file_id", "left").select("rel_path", "lang", "size", F.coalesce("lines", F.lit(0)).alias("lines"))


def _edge_view(index: Index, rows: DataFrame) -> DataFrame:
    return rows.join(index.paths, "file_id").select("edge_id", "kind", "raw", "line", F.col("rel_path").alias("file"), "dst_type", "dst_id")


def incoming(index: Index, path: str, kinds=P.DEPENDENCY_KINDS) -> DataFrame:
    """The resolved edges that point at a file."""
    one = index.files.where(F.col("rel_path") == path).select(F.col("file_id").alias("dst_id"))
    rows = index.edges.where(F.col("resolved") & (F.col("dst_type") == "file") & F.col("kind").isin(*kinds)).join(one, "dst_id", "left_semi")
    return _edge_view(index, rows)


def outgoing(index: Index, path: str, kinds=P.DEPENDENCY_KINDS) -> DataFrame:
    """The edges that stand in a file."""
    one = index.files.where(F.col("rel_path") == path).select("file_id")
    return _edge_view(index, index.edges.where(F.col("kind").isin(*kinds)).join(one, "file_id", "left_semi"))


def unresolved(index: Index, kinds) -> DataFrame:
    rows = index.edges.where((~F.coalesce("resolved", F.lit(False))) & F.col("kind").isin(*kinds))
    return _edge_view(index, rows)


def shared_resource_links(index: Index) -> DataFrame:
    """src_path and dst_path of files that use a resource and files that declare it, a file's own left out."""
    uses = index.edges.where((F.col("kind") == "uses_resource") & F.col("resolved") & (F.col("dst_type") == "resource"))
    declared = index.resources.where("file_id is not null").select(F.col("resource_id").alias("dst_id"), F.col("file_id").alias("to"))
    pairs = uses.select("file_id", "dst_id").distinct().join(declared, "dst_id").where("file_id <> to").select("file_id", "to").distinct()
    p, q = index.paths.alias("p"), index.paths.alias("q")
    joined = pairs.join(p, pairs.file_id == F.col("p.file_id")).join(q, F.col("to") == F.col("q.file_id"))
    return joined.select(F.col("p.rel_path").alias("src_path"), F.col("q.rel_path").alias("dst_path"))


def entities(index: Index) -> DataFrame:
    """Files, symbols and resources as nodes of one graph: id, kind, name and place."""
    files = index.files.select(F.concat(F.lit("file:"), "file_id").alias("id"), F.lit("file").alias("kind"), F.col("rel_path").alias("name"), F.lit(None).cast("int").alias("line"))
    symbols = index.symbols.select(F.concat(F.lit("symbol:"), "symbol_id").alias("id"), F.col("kind"), F.col("name"), F.col("start_line").alias("line"))
    resources = index.resources.select(F.concat(F.lit("resource:"), "resource_id").alias("id"), F.col("kind"), F.col("name"), F.col("line"))
    return files.unionByName(symbols).unionByName(resources)


#: Lines of a bucket: spans meet places by bucket, so that a file with very many of either isn't paired all with all.
BUCKET_LINES = 32


def by_bucket(spans: DataFrame, first: str, last: str) -> DataFrame:
    """One row per span and bucket of lines that it touches."""
    low, high = F.floor(F.col(first) / BUCKET_LINES), F.floor(F.greatest(F.col(first), F.col(last)) / BUCKET_LINES)
    return spans.where(F.col(first).isNotNull() & F.col(last).isNotNull()).withColumn("bucket", F.explode(F.sequence(low, high)))


def with_bucket(places: DataFrame, line: str) -> DataFrame:
    return places.withColumn("bucket", F.floor(F.col(line) / BUCKET_LINES))


def chunks_of_symbols(index: Index) -> DataFrame:
    """symbol_id and the chunks of its file that hold its first line: equal on the file, a range on the line."""
    c = index.raw("chunks").select("chunk_id", "file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b")).dropDuplicates(["chunk_id"])
    s = index.symbols.select("symbol_id", "file_id", "start_line")
    met = with_bucket(s, "start_line").join(by_bucket(c, "a", "b"), ["file_id", "bucket"])
    return met.where("start_line between a and b").select("symbol_id", "chunk_id")


def innermost(index: Index, places: DataFrame) -> DataFrame:
    """The smallest definition around each place (file_id, line): symbol_id and name; ties go to the smallest id."""
    defs = index.symbols.where(~F.col("kind").isin(*P.AUXILIARY_KINDS)).select("symbol_id", "file_id", "name", "start_line", "end_line")
    met = with_bucket(places, "line").join(by_bucket(defs, "start_line", "end_line"), ["file_id", "bucket"])
    inside = met.where("line between start_line and end_line")
    best = F.min_by(F.struct("symbol_id", "name"), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "symbol_id")).alias("best")
    return inside.groupBy("file_id", "line").agg(best).select("file_id", "line", "best.symbol_id", "best.name")


def nesting(index: Index) -> DataFrame:
    """symbol_id and depth, how many definitions of the file begin before it and end no earlier."""
    spans = index.symbols.where(~F.col("kind").isin(*P.AUXILIARY_KINDS)).select("symbol_id", "file_id", "start_line", "end_line")
    outer = by_bucket(spans.select("file_id", F.col("start_line").alias("a"), F.col("end_line").alias("b")), "a", "b")
    met = with_bucket(spans, "start_line").join(outer, ["file_id", "bucket"], "left")
    return met.groupBy("symbol_id").agg(F.count_if((F.col("a") < F.col("start_line")) & (F.col("b") >= F.col("end_line"))).alias("depth"))


def without_incoming(index: Index, role: str | None = None) -> DataFrame:
    """Files at which no resolved edge of the five launching kinds points."""
    kinds = ("includes", "references", "execs", "binds", "autostarts")
    hit = index.edges.where(F.col("resolved") & (F.col("dst_type") == "file") & F.col("kind").isin(*kinds)).select(F.col("dst_id").alias("file_id"))
    rows = index.files if role is None else index.files.where(F.col("role") == role)
    return rows.join(hit, "file_id", "left_anti").select("file_id", "rel_path")


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)
