"""Queries over events, as streams that end and as tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwood.index import Index
from siftwood.session import shared_dir
from siftwood.sources import tree
from siftwood.streaming import events as E


def _events(s, d):
    return Index(s, d).raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(s, d):
    """The counts of all windows by a stream over what is there, in complete mode."""
    place = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    query = E.to_table(E.window_counts(E.stream(s, f"{d}/events.parquet")), f"{place}/out", f"{place}/checkpoint", "complete")
    query.awaitTermination()
    return s.read.parquet(f"{place}/out")


def _first_seen(s, d):
    """The files as they were when they were first indexed."""
    return Index(s, d).raw("files").groupBy("rel_path").agg(F.min(F.struct("indexed_at", "size", "hash")).alias("row")).select("rel_path", "row.hash")


def _not_deleted(s, d):
    """The files that no tombstone names."""
    index = Index(s, d)
    dead = index.raw("tombstones").where("entity_type = 'file'").select(F.col("entity_id").alias("file_id"))
    return index.files.join(dead, "file_id", "left_anti").select("rel_path")


QUERIES = {
    "l10_streamed_windows": _streamed,
    "l10_windows": lambda s, d: E.window_counts(_events(s, d)),
    "l11_sessions": lambda s, d: E.sessions(_events(s, d)),
    "s09_changed": lambda s, d: tree.changed(Index(s, d).files.select("rel_path", "hash"), _first_seen(s, d)).select("rel_path"),
    "s10_signature": lambda s, d: tree.signature(Index(s, d).files),
    "u05_vanished": lambda s, d: tree.vanished(Index(s, d).files.select("rel_path"), _not_deleted(s, d)),
}

_WINDOWS = "SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"

SQL = {
    "l11_sessions": "SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM "
    "(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k",
    "l10_windows": _WINDOWS,
    "l10_streamed_windows": _WINDOWS,
    "s09_changed": "WITH w AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY indexed_at, size, hash) AS a, row_number() OVER (PARTITION BY rel_path ORDER BY indexed_at DESC, size DESC, hash DESC) AS z FROM files) "
    "SELECT x.rel_path FROM w x JOIN w y USING (rel_path) WHERE x.z = 1 AND y.a = 1 AND x.hash <> y.hash",
    "u05_vanished": "SELECT DISTINCT rel_path FROM files WHERE file_id IN (SELECT entity_id FROM tombstones WHERE entity_type = 'file')",
}
