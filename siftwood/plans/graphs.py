"""Queries of the graph operators, with their SQL."""

from __future__ import annotations

from siftwood.functions import paths as P
from siftwood.index import Index
from siftwood.operators import graph as G
from siftwood.operators import reads as R
from siftwood.plans import sqltext as S
from siftwood.plans.basics import _HUB_SQL, _LINK, hub

QUERIES = {
    "g01_callers": lambda s, d: R.incoming(Index(s, d), hub(Index(s, d))),
    "g02_callees": lambda s, d: R.outgoing(Index(s, d), hub(Index(s, d)), tuple(k for k in P.DEPENDENCY_KINDS if k != "pkg")),
    "g05_dependents": lambda s, d: G.dependents(Index(s, d), hub(Index(s, d))),
    "g05_ancestors": lambda s, d: G.ancestors(Index(s, d), hub(Index(s, d))),
    "g06_neighbours": lambda s, d: G.neighbours(Index(s, d), hub(Index(s, d))),
    "g07_blast": lambda s, d: G.blast(G.dependents(Index(s, d), hub(Index(s, d)))),
    "g08_entrypoints_for": lambda s, d: G.entrypoints_for(Index(s, d), hub(Index(s, d))),
    "g09_tests_for": lambda s, d: G.tests_for(Index(s, d), hub(Index(s, d))),
    "g12_central_files": lambda s, d: G.central_files(Index(s, d)),
    "g13_components": lambda s, d: _components(Index(s, d)),
    "g15_clusters": lambda s, d: G.clusters(Index(s, d)),
    "g16_include_cycles": lambda s, d: G.include_cycles(Index(s, d)),
    "g17_entrypoints": lambda s, d: G.entrypoints(Index(s, d)),
    "k15_exported": lambda s, d: G.exported(Index(s, d)),
}


def _components(index: Index):
    from pyspark.sql import functions as F

    return G.components(index.files.select(F.col("file_id").alias("id")), index.links().select("src", "dst"))


_FILE_EDGES = f"fe AS (SELECT src_id AS src, dst_id AS dst FROM e WHERE src_type = 'file' AND dst_type = 'file' AND resolved AND dst_id IS NOT NULL AND kind IN {S.DEPS})"


def _walk(a: str, b: str) -> str:
    return (
        f"{_HUB_SQL}, {_FILE_EDGES}, walk AS (SELECT file_id AS id, 0 AS depth FROM hub UNION SELECT fe.{b}, depth + 1 FROM walk JOIN fe ON fe.{a} = walk.id WHERE depth < 40), "
        "found AS (SELECT rel_path, min(depth) AS depth FROM walk JOIN f ON f.file_id = walk.id WHERE id <> (SELECT file_id FROM hub) GROUP BY rel_path)"
    )


_LINKS = f"l AS ({_LINK}), li AS (SELECT p.file_id AS src, q.file_id AS dst FROM l JOIN f p ON p.rel_path = l.src_path JOIN f q ON q.rel_path = l.dst_path WHERE l.src_path <> l.dst_path)"
_RANK = f"""
{_LINKS}, n AS (SELECT count(*) AS n FROM f), o AS (SELECT src, count(*) AS outs FROM li GROUP BY src), w AS (SELECT src, dst, count(*) / max(outs) AS share FROM li JOIN o USING (src) GROUP BY ALL),
pr AS (
  SELECT file_id AS id, 1 / (SELECT n FROM n) AS score, 0 AS i FROM f
  UNION ALL
  SELECT b.id, (1 - 0.85) / (SELECT n FROM n) + 0.85 * b.lost / (SELECT n FROM n) + 0.85 * coalesce(g.got, 0), b.i + 1
  FROM (SELECT pr.id, pr.i, sum(CASE WHEN o.src IS NULL THEN pr.score ELSE 0 END) OVER () AS lost FROM pr LEFT JOIN o ON o.src = pr.id) b
  LEFT JOIN (SELECT w.dst, sum(w.share * pr.score) AS got FROM w JOIN pr ON pr.id = w.src GROUP BY w.dst) g ON g.dst = b.id WHERE b.i < 40
)"""
_ELIGIBLE = f"(NOT coalesce(lang IN {S._list(P.DATA_LANGS)}, false) AND NOT {S.test('src_path')})"
_STEM = "lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^([^.]*)', 1))"

SQL = {
    "g01_callers": S.sql(f"SELECT e.edge_id, e.kind, e.raw, e.line, f.rel_path AS file, e.dst_type, e.dst_id FROM e JOIN f USING (file_id) WHERE e.resolved AND e.dst_type = 'file' AND e.kind IN {S.DEPS} AND e.dst_id = (SELECT file_id FROM hub)", _HUB_SQL),
    "g02_callees": S.sql(f"SELECT e.edge_id, e.kind, e.raw, e.line, f.rel_path AS file, e.dst_type, e.dst_id FROM e JOIN f USING (file_id) WHERE e.kind IN {S.DEPS} AND e.kind <> 'pkg' AND e.file_id = (SELECT file_id FROM hub)", _HUB_SQL),
    "g05_dependents": S.sql("SELECT * FROM found", _walk("dst", "src"), True),
    "g05_ancestors": S.sql("SELECT * FROM found", _walk("src", "dst"), True),
    "g06_neighbours": S.sql("SELECT DISTINCT CASE WHEN src_path = (SELECT rel_path FROM hub) THEN dst_path ELSE src_path END AS rel_path FROM l WHERE src_path <> dst_path AND (SELECT rel_path FROM hub) IN (src_path, dst_path) ORDER BY 1 LIMIT 20", f"{_HUB_SQL}, l AS ({_LINK})"),
    "g07_blast": S.sql(f"SELECT {S.subsystem('rel_path')} AS subsystem, count(*) AS files, (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found WHERE depth = 1) AS direct FROM found GROUP BY 1 ORDER BY files DESC, subsystem LIMIT 15", _walk("dst", "src"), True),
    "g08_entrypoints_for": S.sql(
        f"SELECT rel_path FROM (SELECT rel_path FROM found UNION ALL SELECT rel_path FROM hub WHERE NOT EXISTS (SELECT 1 FROM found)) JOIN f USING (rel_path) WHERE NOT EXISTS (SELECT 1 FROM found) "
        f"OR file_id NOT IN (SELECT dst_id FROM e WHERE resolved AND dst_type = 'file' AND dst_id IS NOT NULL AND kind IN {S.DEPS}) ORDER BY {S.depth('rel_path')}, rel_path LIMIT 20",
        _walk("dst", "src"), True,
    ),
    "g09_tests_for": S.sql(
        f"SELECT rel_path, (st = own OR regexp_replace(st, '(_test|_spec|test)$', '') = own OR regexp_replace(st, '^(test_|spec_)', '') = own) AS covers FROM (SELECT rel_path, {_STEM.format(p='rel_path')} AS st, (SELECT {_STEM.format(p='rel_path')} FROM hub) AS own FROM near "
        "UNION ALL SELECT rel_path, " + _STEM.format(p="rel_path") + ", (SELECT " + _STEM.format(p="rel_path") + " FROM hub) FROM usng WHERE NOT EXISTS (SELECT 1 FROM near)) ORDER BY covers DESC, rel_path LIMIT 25",
        f"{_HUB_SQL}, tf AS (SELECT rel_path, file_id FROM f WHERE rel_path <> (SELECT rel_path FROM hub) AND {S.test('rel_path')}), near AS (SELECT rel_path FROM tf WHERE {S.folder('rel_path')} = (SELECT {S.folder('rel_path')} FROM hub)), "
        f"usng AS (SELECT DISTINCT rel_path FROM tf JOIN e USING (file_id) WHERE e.resolved AND e.dst_type = 'file' AND e.kind IN {S.DEPS} AND e.dst_id = (SELECT file_id FROM hub))",
    ),
    "g12_central_files": S.sql(
        f"SELECT rel_path, round(score, 9) AS score, coalesce(k, 0) AS in_degree FROM pr JOIN f ON f.file_id = pr.id LEFT JOIN (SELECT dst, count(*) AS k FROM li GROUP BY dst) d ON d.dst = pr.id "
        f"WHERE i = 40 AND NOT {S.vendored('rel_path')} ORDER BY round(score, 9) DESC, in_degree DESC, rel_path LIMIT 10", _RANK, True,
    ),
    "g13_components": S.sql(
        "SELECT file_id AS id, least(file_id, coalesce(min(b), file_id)) AS component FROM f LEFT JOIN walk ON walk.a = f.file_id GROUP BY file_id",
        f"{_LINKS}, u AS (SELECT src AS a, dst AS b FROM li UNION SELECT dst, src FROM li), walk AS (SELECT a, b FROM u UNION SELECT walk.a, u.b FROM walk JOIN u ON u.a = walk.b)", True,
    ),
    "g16_include_cycles": S.sql(
        "SELECT f.rel_path, h.rel_path AS circle FROM (SELECT x.a AS id, min(x.b) AS circle FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1) z JOIN f ON f.file_id = z.id JOIN f h ON h.file_id = z.circle",
        "ie AS (SELECT DISTINCT src_id AS a, dst_id AS b FROM e WHERE src_type = 'file' AND dst_type = 'file' AND resolved AND dst_id IS NOT NULL AND kind = 'includes' AND src_id <> dst_id), walk AS (SELECT a, b FROM ie UNION SELECT walk.a, ie.b FROM walk JOIN ie ON ie.a = walk.b)", True,
    ),
    "g17_entrypoints": S.sql(
        f"SELECT src_path AS rel_path, count(*) AS out_degree FROM ll WHERE {_ELIGIBLE} AND src_path NOT IN (SELECT dst_path FROM ll WHERE {_ELIGIBLE}) GROUP BY src_path ORDER BY out_degree DESC, {S.depth('src_path')}, src_path LIMIT 20",
        f"l AS ({_LINK}), ll AS (SELECT l.*, f.lang FROM l JOIN f ON f.rel_path = l.src_path)",
    ),
    "k15_exported": S.sql(
        "SELECT src_path, dst_path FROM dl WHERE src_path IN (SELECT p FROM kept) AND dst_path IN (SELECT p FROM kept)",
        f"l AS ({_LINK}), dl AS (SELECT DISTINCT src_path, dst_path FROM l), kept AS (SELECT p FROM (SELECT src_path AS p FROM dl UNION SELECT dst_path FROM dl) LEFT JOIN (SELECT dst_path AS p, count(*) AS n FROM dl GROUP BY 1) USING (p) ORDER BY coalesce(n, 0) DESC, p LIMIT 200)",
    ),
}
