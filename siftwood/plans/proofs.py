"""Further queries with SQL: reads by id, resolution pass by pass, and SQL for queries of other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.index import Index
from siftwood.operators import health as H
from siftwood.operators import reads as B
from siftwood.operators import redaction as R
from siftwood.operators import resolution as J
from siftwood.operators import stats as A
from siftwood.plans import sqltext as S
from siftwood.plans.checks import SQL as CHECKS
from siftwood.plans.searching import TYPO
from siftwood.plans.texts import CONFIGS

# A small tree in which every pass of the resolution has something to find: file_id, rel_path, lang.
TREE = (
    (1, "src/a.ts", "typescript"), (2, "src/b.ts", "typescript"), (3, "src/lib/index.ts", "typescript"), (4, "pkg/x/y.go", "go"), (5, "pkg/x/z.go", "go"), (6, "pkg/x/y_test.go", "go"), (7, "main.go", "go"),
    (8, "app/m.py", "python"), (9, "app/n.py", "python"), (10, "crates/c/src/lib.rs", "rust"), (11, "crates/c/src/m/n.rs", "rust"), (12, "crates/d/src/main.rs", "rust"), (13, "j/src/main/java/com/a/B.java", "java"),
    (14, "j/src/main/java/com/a/C.java", "java"), (15, "bin/run-it", "bash"), (16, "hypr/h.conf", "hyprlang"), (17, "N/A.cs", "csharp"), (18, "N/B.cs", "csharp"), (19, "p/K.php", "php"), (20, "p/L.php", "php"),
    (21, "d/app/lib/u.dart", "dart"), (22, "d/w/v.dart", "dart"), (23, "q/Bar.qml", "qml"), (24, "q/Main.qml", "qml"), (25, "s/T.swift", "swift"), (26, "s/U.swift", "swift"), (27, "web/k/src/index.ts", "typescript"),
    (28, "web/k/src/deep/one.ts", "typescript"), (29, "lua/z/t.lua", "lua"), (30, "lua/z/u.lua", "lua"), (31, "e/x.ex", "elixir"), (32, "e/y.ex", "elixir"), (33, "lib/r.rb", "ruby"), (34, "bin/s.rb", "ruby"),
)
#: edge_id is pass * 10 + number: source, kind, raw, and what must come out (type and id, or none).
LINKS = (
    (11, 1, "includes", "./b", "file", 2), (12, 1, "includes", "./lib", "file", 3), (13, 8, "includes", ".n", "file", 9), (14, 30, "includes", "z.t", "file", 29), (15, 34, "includes", "r", "file", 33), (16, 1, "includes", "./a", None, None),
    (21, 16, "execs", "run-it --x", "file", 15), (22, 16, "execs", "sh bin/s.rb", "file", 34), (31, 16, "uses_resource", "$red", "resource", 4), (32, 16, "uses_resource", "$blue", None, None), (41, 24, "instantiates", "Bar", "file", 23), (51, 26, "uses", "T", "file", 25),
    (61, 7, "includes", "ex.org/m/pkg/x", "package", 0), (62, 18, "includes", "Acme.Core", "package", 0), (63, 32, "includes", "Acme.Main", "package", 0), (64, 7, "includes", "fmt", None, None), (71, 14, "includes", "com.a.B.Inner", "file", 13),
    (81, 12, "includes", "c::m::n::T", "file", 11), (82, 12, "includes", "c::Thing", "file", 10), (91, 1, "includes", "@k/kit", "file", 27), (92, 1, "includes", "@k/kit/deep/one", "file", 28), (101, 20, "includes", "App\\K", "file", 19),
    (111, 22, "includes", "package:app/u.dart", "file", 21), (121, 2, "includes", "#/lib", "file", 3), (122, 2, "includes", "##/x", None, None),
)
PACKAGES = J.Manifests("ex.org/m", {"c": "crates/c/src"}, {"@k/kit": "web/k"}, {"app": "d/app"}, [(".", {"#/": ["src/"], "##/": ["none/"]})])
NAMED = ((5, "color", "$red", None), (4, "color", "$red", None), (6, "namespace", "Acme.Core", 17), (7, "namespace", "App", 19), (8, "namespace", "Acme.Main", 31))


def _passes(spark):
    """The resolved edges of the small tree and the fan-out of its packages."""
    files = spark.createDataFrame(TREE, "file_id long, rel_path string, lang string")
    edges = spark.createDataFrame([(e, f, k, r, 1) for e, f, k, r, _, _ in LINKS], "edge_id long, file_id long, kind string, raw string, line int")
    symbols = spark.createDataFrame([(1, 25, "T", "struct")], "symbol_id long, file_id long, name string, kind string")
    resources = spark.createDataFrame(NAMED, "resource_id long, kind string, name string, file_id long")
    return J.resolve(edges, files, symbols, resources, PACKAGES)


#: Guides and launched commands that the generated tables lack.
GUIDES = ((1, "r-1/README.md", "markdown"), (2, "r-1/CONTRIBUTING.md", "markdown"), (3, "r-1/docs/design-notes.md", "markdown"), (4, "r-1/src/README.md", "markdown"), (5, "r-1/README.rst", "text"), (6, "r-2/docs/api.md", "markdown"), (7, "r-2/readme.md", "markdown"), (8, "r-2/run.sh", "bash"))
LAUNCHED = ((1, 8, "execs", "make all", False), (2, 8, "execs", "'nosuch' --x", False), (3, 8, "binds", "nosuch -y", False), (4, 8, "autostarts", "./a/b", False), (5, 8, "execs", "$HOME/c", False), (6, 8, "execs", "other", True), (7, 8, "execs", "gone", None), (8, 8, "execs", None, False))


def _small(s, d):
    """The index with a few files and edges in the place of its own."""
    index = Index(s, d)
    files = s.createDataFrame(GUIDES, "file_id long, rel_path string, lang string")
    edges = s.createDataFrame(LAUNCHED, "edge_id long, file_id long, kind string, raw string, resolved boolean")
    more = {"src_type": F.lit("file"), "src_id": F.col("file_id"), "line": F.col("edge_id").cast("int"), "dst_type": F.lit("file"), "dst_id": F.when(F.col("resolved"), 1).cast("bigint")}
    index.__dict__ |= {"files": files, "edges": edges.withColumns(more)}
    return index


def _keys(s, d):
    index = Index(s, d)
    rows = index.raw("chunks").where(R.may_hold(F.col("text"))).select("chunk_id", R.prefixed(F.col("text")).alias("n")).where("n > 0")
    return rows.groupBy("chunk_id").agg(F.max("n").alias("n"))


QUERIES = {
    "t03_file_ids": lambda s, d: B.file_ids(Index(s, d)),
    "j01_j13_passes": lambda s, d: _passes(s)[0].select("edge_id", "dst_type", "dst_id", "resolved"),
    "j06_j08_fanned_out": lambda s, d: _passes(s)[1].select("file_id", "dst_id"),
    "r01_service_keys": _keys,
    "a11_guides_planted": lambda s, d: A.guides(_small(s, d)),
    "h08_broken_planted": lambda s, d: H.broken_commands(_small(s, d), s.createDataFrame([("make",)], "name string")),
}

_WHAT = (
    "CASE WHEN regexp_matches(l, '^(include|source)[ =]') OR starts_with(l, '@import') THEN 'includes' WHEN regexp_matches(l, '^exec([_-](always|once))? ') THEN 'execs' "
    "WHEN regexp_matches(l, '^(bindsym |bindcode |bind |bind=)') THEN 'binds' WHEN regexp_matches(l, '^set\\s+\\$\\S+ +\\S') OR regexp_matches(l, '^\\$[^=]*=') THEN 'variable' "
    "WHEN regexp_matches(l, '^[^=\\s{}]+\\s*=') AND NOT regexp_matches(l, '^[^=]*[\\s{}][^=\\s]*\\s*=') THEN 'setting' WHEN NOT contains(l, '=') AND regexp_matches(l, '^[^:\\s{}]+\\s*:') THEN 'setting' END"
)
_FOUND = [CHECKS[n] for n in ("h01_cyclic_includes", "h02_fan_risks", "h04_dangling_includes", "h06_redacted", "h08_broken_commands", "h09_orphan_scripts", "h10_hardcoded_colors", "h11_forbidden")]
_FOUND.append(CHECKS["h03_oversized"].replace("lines >= 200", "lines >= 800"))
_CALLED = "next_token"

SQL = {
    "t03_file_ids": S.sql("SELECT file_id, rel_path FROM f"),
    "j01_j13_passes": "SELECT * FROM (VALUES " + ", ".join(f"({e}, {repr(t) if t else 'NULL'}, {i if i is not None else 'NULL'}, {bool(t)})" for e, _, k, _, t, i in LINKS if t or k not in ("uses", "instantiates")) + ") t(edge_id, dst_type, dst_id, resolved)",
    "j06_j08_fanned_out": "SELECT * FROM (VALUES (7, 4), (7, 5), (18, 17), (32, 31)) t(file_id, dst_id)",
    "a11_guides_planted": "SELECT * FROM (VALUES ('r-1/README.md', 0), ('r-2/readme.md', 0), ('r-1/CONTRIBUTING.md', 1), ('r-1/docs/design-notes.md', 2)) t(rel_path, rank)",
    "h08_broken_planted": "SELECT 'broken_command' AS check, 'warn' AS severity, 'r-2/run.sh' AS rel_path, line, detail FROM (VALUES (2, 'nosuch'), (7, 'gone')) t(line, detail)",
    "r01_service_keys": "SELECT chunk_id, n FROM (SELECT DISTINCT chunk_id, " + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in R.PREFIXED)
    + " + len(list_filter(regexp_extract_all(text, '\\bsk-[A-Za-z0-9_-]+'), lambda x: regexp_matches(x, '^sk-([A-Za-z0-9_-]{40,}|[A-Za-z0-9_]{24,})$'))) AS n FROM chunks) WHERE n > 0",
    "x27_generic": S.sql(
        f"SELECT chunk_id, line, what FROM (SELECT chunk_id, line, {_WHAT} AS what FROM (SELECT chunk_id, coalesce(start_line, 1) + i - 1 AS line, regexp_replace(x[i], '^\\s+|\\s+$', '', 'g') AS l FROM ("
        f"SELECT chunk_id, c.start_line, string_split_regex(text, '\\r?\\n') AS x, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS i FROM c JOIN f USING (file_id) WHERE f.lang IN {S._list(CONFIGS)})) WHERE l <> '' AND NOT regexp_matches(l, '^(#|//|;)')) WHERE what IS NOT NULL"
    ),
    "f07_fuzzy": S.sql(
        f"SELECT name, CAST(damerau_levenshtein(lower(name), '{TYPO}') AS INTEGER) AS distance FROM (SELECT DISTINCT name FROM s WHERE length(name) BETWEEN {len(TYPO) - 2} AND {len(TYPO) + 2}) WHERE damerau_levenshtein(lower(name), '{TYPO}') BETWEEN 1 AND 2 ORDER BY distance, name LIMIT 10"
    ),
    "f23_call_sites": S.sql(
        "SELECT f.rel_path, line, trim(text, ' ') AS text, inner_name AS enclosing FROM (SELECT h.*, (SELECT arg_min(s.name, {'span': s.end_line - s.start_line, 'id': s.symbol_id}) FROM s WHERE s.file_id = h.file_id AND h.line BETWEEN s.start_line AND s.end_line "
        f"AND s.kind NOT IN {S._list(P.AUXILIARY_KINDS)}) AS inner_name FROM (SELECT DISTINCT file_id, start_line + i - 1 AS line, x[i] AS text FROM (SELECT file_id, start_line, string_split_regex(text, '\\r?\\n') AS x, unnest(range(1, len(string_split_regex(text, '\\r?\\n')) + 1)) AS i "
        f"FROM c WHERE contains(text, '{_CALLED}')) WHERE regexp_matches(x[i], '(^|[^A-Za-z0-9_]){_CALLED}[ \\t]*\\(')) h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.name = '{_CALLED}' AND s.file_id = h.file_id AND s.start_line = h.line)) q JOIN f USING (file_id) "
        f"WHERE coalesce(inner_name, '') <> '{_CALLED}' ORDER BY rel_path, line LIMIT 40"
    ),
    "a15_health_score": "SELECT errors, warnings, infos, CAST(greatest(0, 100 - 5 * errors - 2 * warnings) AS BIGINT) AS score FROM (SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM ("
    + " UNION ALL ".join(f"SELECT severity FROM ({q}) t{i}" for i, q in enumerate(_FOUND)) + ") x) y",
}
