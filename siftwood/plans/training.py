"""Queries of the core operators for training data: hierarchies and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwood.operators import hierarchy, references
from siftwood.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """symbol_id, root_id, depth and state of every symbol with a parent."""
    return hierarchy.found(table(spark, folder, "symbols"))


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol with its root, depth, state and the number of symbols below it, around circles too; p3_below names them."""
    return hierarchy.descendants(table(spark, folder, "symbols")).select("symbol_id", "root_id", "depth", "state", "n_below")


def p3_tours(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol with its tree, its place on the tour and its circle, from which all symbols below it can be told."""
    return hierarchy.descendants(table(spark, folder, "symbols")).select("symbol_id", "top", "entry", "leave", "circle")


def p3_below(spark: SparkSession, folder: str) -> DataFrame:
    """symbol_id and below_id: every symbol with all symbols below it, those around a circle included."""
    return hierarchy.below(table(spark, folder, "symbols"))


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol with its path of names from the root down."""
    return hierarchy.paths(table(spark, folder, "symbols"))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    names = ("edges", "files", "symbols", "resources", "tombstones")
    return references.dangling(*(table(spark, folder, n) for n in names))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """edge_id, side and reason of every reference to something that isn't there."""
    return _cases(spark, folder).select("edge_id", "side", "reason")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of p6_found counted by referred table and month."""
    return references.report(_cases(spark, folder))


QUERIES = {f.__name__: f for f in (p3_found, p3_descendants, p3_tours, p3_below, p3_paths, p6_found, p6_report)}

_WALK = """
WITH RECURSIVE s AS (
  SELECT symbol_id, min(file_id) AS file_id, min(parent_id) AS parent_id FROM symbols WHERE symbol_id IS NOT NULL GROUP BY symbol_id
), walk AS (
  SELECT symbol_id, symbol_id AS cur, 0 AS depth, [symbol_id] AS seen, false AS looped FROM s {start}
  UNION ALL
  SELECT w.symbol_id, p.symbol_id, w.depth + 1, list_append(w.seen, p.symbol_id), list_contains(w.seen, p.symbol_id)
  FROM walk w JOIN s c ON c.symbol_id = w.cur JOIN s p ON p.symbol_id = c.parent_id AND p.file_id IS NOT DISTINCT FROM c.file_id
  WHERE NOT w.looped
), last AS (
  SELECT symbol_id, cur, depth, seen, looped FROM walk QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY depth DESC) = 1
), told AS (
  SELECT l.symbol_id, l.looped, l.cur, l.depth, l.seen, list_position(l.seen, l.cur) - 1 AS enters, t.parent_id AS beyond, b.symbol_id AS there
  FROM last l JOIN s t ON t.symbol_id = l.cur LEFT JOIN s b ON b.symbol_id = t.parent_id
)
"""

_P3 = (
    _WALK.format(start="WHERE parent_id IS NOT NULL")
    + """
SELECT symbol_id,
  CASE WHEN looped THEN list_min(list_slice(seen, enters + 1, len(seen))) ELSE cur END AS root_id,
  CAST(CASE WHEN looped THEN enters ELSE depth END AS INTEGER) AS depth,
  CASE WHEN looped THEN 'cycle' WHEN beyond IS NULL THEN 'ok' WHEN there IS NULL THEN 'broken' ELSE 'crossing' END AS state
FROM told
"""
)

_P3_DESCENDANTS = (
    _WALK.format(start="")
    + """
, named AS (
  SELECT a AS symbol_id, count(DISTINCT symbol_id) AS n_below FROM (SELECT symbol_id, unnest(seen) AS a FROM told) WHERE a <> symbol_id GROUP BY 1
)
SELECT t.symbol_id,
  CASE WHEN looped THEN list_min(list_slice(seen, enters + 1, len(seen))) ELSE cur END AS root_id,
  CAST(CASE WHEN looped THEN enters ELSE depth END AS INTEGER) AS depth,
  CASE WHEN looped THEN 'cycle' WHEN beyond IS NOT NULL AND there IS NULL THEN 'broken' WHEN beyond IS NOT NULL THEN 'crossing' WHEN depth = 0 THEN 'root' ELSE 'ok' END AS state,
  coalesce(n.n_below, 0) AS n_below
FROM told t LEFT JOIN named n ON n.symbol_id = t.symbol_id
"""
)

_P6 = """
WITH latest AS (
  SELECT entity_type AS type, entity_id AS id, max(deleted_at) AS deleted_at FROM tombstones GROUP BY 1, 2
), f AS (
  SELECT f.*, coalesce(l.deleted_at > f.last, false) AS gone FROM (
    SELECT file_id AS id, min(indexed_at) AS first, max(indexed_at) AS last, max(rel_path) AS rel_path FROM files GROUP BY 1) f
  LEFT JOIN latest l ON l.type = 'file' AND l.id = f.id
), things AS (
  SELECT 'file' AS type, id, first, gone FROM f
  UNION ALL
  SELECT 'symbol', s.symbol_id, f.first, coalesce(f.gone, false) OR coalesce(l.deleted_at > f.last, false)
  FROM (SELECT symbol_id, min(file_id) AS file_id FROM symbols GROUP BY 1) s LEFT JOIN f ON f.id = s.file_id
  LEFT JOIN latest l ON l.type = 'symbol' AND l.id = s.symbol_id
  UNION ALL
  SELECT DISTINCT 'resource', resource_id, NULL::TIMESTAMP, false FROM resources
), e AS (
  SELECT DISTINCT edge_id, src_type, src_id, dst_type, dst_id, kind, file_id, raw, seen_at FROM edges
), refs AS (
  SELECT edge_id, 'src' AS side, src_type AS type, src_id AS id, seen_at FROM e
  UNION ALL SELECT edge_id, 'dst', dst_type, dst_id, seen_at FROM e
), direct AS (
  SELECT r.edge_id, r.side, CASE WHEN t.id IS NULL THEN CASE WHEN l.id IS NULL THEN 'missing' ELSE 'deleted' END
    WHEN t.gone THEN 'deleted' WHEN t.first > r.seen_at THEN 'late' END AS reason, r.type, r.seen_at
  FROM refs r LEFT JOIN things t ON t.type = r.type AND t.id = r.id LEFT JOIN latest l ON l.type = r.type AND l.id = r.id
  WHERE r.id IS NOT NULL AND r.type IN ('file', 'symbol', 'resource')
), asks AS (
  SELECT e.edge_id, e.seen_at, regexp_replace(f.rel_path, '/?[^/]*$', '') AS folder,
    regexp_replace(regexp_replace(e.raw, '^[\\s"''`]+|[\\s"''`]+$', '', 'g'), '[?#].*$', '') AS name
  FROM e LEFT JOIN f ON f.id = e.file_id
  WHERE e.dst_id IS NULL AND e.kind IN ('includes', 'references', 'execs')
), placed AS (
  SELECT edge_id, seen_at, list_reduce(list_filter(string_split(concat(folder, '/', name), '/'), lambda x: x <> '' AND x <> '.'),
    lambda a, x: CASE WHEN a IS NULL OR (x = '..' AND a = '') THEN NULL WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '')
      WHEN a = '' THEN x ELSE concat(a, '/', x) END, '') AS path
  FROM asks WHERE name LIKE './%' OR name LIKE '../%'
), named AS (
  SELECT DISTINCT p.path, f.id, f.first, f.gone FROM f, LATERAL (SELECT unnest([f.rel_path, regexp_replace(f.rel_path, '\\.[^./]*$', '')]) AS path) p
), written AS (
  SELECT p.edge_id, 'raw' AS side, CASE WHEN count(n.id) = 0 THEN 'missing'
    WHEN bool_or(NOT n.gone AND NOT coalesce(n.first > p.seen_at, false)) THEN NULL
    WHEN bool_or(NOT n.gone) THEN 'late' ELSE 'deleted' END AS reason, 'path' AS type, p.seen_at
  FROM placed p LEFT JOIN named n ON n.path = p.path GROUP BY p.edge_id, p.seen_at
), cases AS (
  SELECT * FROM direct WHERE reason IS NOT NULL UNION ALL SELECT * FROM written WHERE reason IS NOT NULL
)
"""

SQL = {
    "p3_found": _P3,
    "p3_descendants": _P3_DESCENDANTS,
    "p3_below": _WALK.format(start="WHERE parent_id IS NOT NULL") + "SELECT DISTINCT a AS symbol_id, symbol_id AS below_id FROM (SELECT symbol_id, unnest(seen) AS a FROM told) WHERE a <> symbol_id",
    "p6_found": _P6 + "SELECT edge_id, side, reason FROM cases",
    "p6_report": _P6
    + "SELECT side, type AS referred, strftime(seen_at, '%Y-%m') AS month, reason, count(*) AS n FROM cases GROUP BY ALL",
}
