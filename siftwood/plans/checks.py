"""Queries of the health checks and the index's own masks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.index import Index
from siftwood.operators import health as H
from siftwood.operators import redaction as R
from siftwood.operators import stats as A
from siftwood.plans import sqltext as S
from siftwood.plans.basics import _LINK
from siftwood.plans.graphs import SQL as _GRAPHS

#: Rules of the query on forbidden links: name, from, to.
RULES = [("tests stay out", "src/core", "tests/"), ("no scripts", "*.go", "*.sh")]
COMMANDS = ("bash", "sh", "python", "make")
#: Key bindings that the generated tables lack: file, name, line.
KEYS = [(0, "SUPER, Q", 3), (0, "q + super", 9), (1, "SUPER, W", 4)]


def _known(spark):
    return spark.createDataFrame([(c,) for c in COMMANDS], "name string")


def _keys(s, d):
    index = Index(s, d)
    first = [r.file_id for r in index.files.where("role = 'wm-config'").select("file_id").orderBy("file_id").limit(2).collect()]
    rows = [(10**9 + i, first[f], name, "keybind", line) for i, (f, name, line) in enumerate(KEYS)]
    planted = s.createDataFrame(rows, "symbol_id long, file_id long, name string, kind string, start_line int")
    return H.duplicate_keys(index.symbols.select(planted.columns).unionByName(planted), index.files)


QUERIES = {
    "h01_cyclic_includes": lambda s, d: H.cyclic_includes(Index(s, d)),
    "h02_fan_risks": lambda s, d: H.fan_risks(Index(s, d)),
    "h03_oversized": lambda s, d: H.oversized(Index(s, d), 200),
    "h04_dangling_includes": lambda s, d: H.dangling_includes(Index(s, d)),
    "h06_redacted": lambda s, d: H.redacted(Index(s, d)),
    "h07_duplicate_keys": _keys,
    "h08_broken_commands": lambda s, d: H.broken_commands(Index(s, d), _known(s)),
    "h09_orphan_scripts": lambda s, d: H.orphan_scripts(Index(s, d)),
    "h10_hardcoded_colors": lambda s, d: H.hardcoded_colors(Index(s, d)),
    "h11_forbidden": lambda s, d: H.forbidden(Index(s, d), RULES),
    "h13_violations": lambda s, d: H.violations(Index(s, d)),
    "a15_health_score": lambda s, d: A.health_score(H.findings(Index(s, d), _known(s), RULES)),
    "r05_redacted_chunks": lambda s, d: R.redact_chunks(Index(s, d).raw("chunks")),
    "r06_masks_of_files": lambda s, d: R.redact_chunks(Index(s, d).raw("chunks")).groupBy("file_id").agg(F.sum("n").alias("masks")).where("masks > 0"),
}


def _find(check: str, severity: str, rest: str, line: str = "NULL::INTEGER", detail: str = "''", path: str = "rel_path") -> str:
    return f"SELECT '{check}' AS check, '{severity}' AS severity, {path} AS rel_path, {line} AS line, CAST({detail} AS VARCHAR) AS detail {rest}"


_VALUE = "trim(regexp_replace(raw, '^[\"'']+|[\"'']+$', '', 'g'))"
_KIND = "lower(regexp_extract(regexp_extract(" + _VALUE + ", '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"
_REL = f"(NOT (left({_VALUE}, 1) IN ('~', '/', '$', '@') OR contains({_VALUE}, '://') OR {_VALUE} = '') AND (contains({_VALUE}, '/') OR {_KIND} IN {S._list(H.INCLUDE_ENDINGS)}))"
_ORPHANS = "FROM f WHERE role = 'script' AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst_id = f.file_id AND e.dst_type = 'file' AND e.resolved AND e.kind IN ('includes', 'references', 'execs', 'binds', 'autostarts'))"
_COLORS = _find("hardcoded_color", "info", "FROM r JOIN nm USING (value) LEFT JOIN f USING (file_id) WHERE value <> '' AND NOT coalesce(name <> '', false)", "r.line", "value || ' duplicates ' || variable")
CYCLES = _GRAPHS["g16_include_cycles"]
_NAMED = "nm AS (SELECT value, arg_max(name, resource_id) AS variable FROM r WHERE value <> '' AND name <> '' GROUP BY value)"
_CMD = "regexp_replace(string_split_regex(trim(raw), '\\s+')[1], '^[\"'']+|[\"'']+$', '', 'g')"

SQL = {
    "h01_cyclic_includes": CYCLES.replace("SELECT f.rel_path, h.rel_path AS circle FROM", "SELECT 'cyclic_include' AS check, 'error' AS severity, f.rel_path, NULL::INTEGER AS line, h.rel_path AS detail FROM"),
    "h02_fan_risks": S.sql(
        "SELECT * FROM (" + _find("fan_in_risk", "warn", "FROM (SELECT rel_path, count(*) AS n FROM e JOIN f ON f.file_id = e.dst_id WHERE dst_type = 'file' AND resolved AND kind <> 'pkg' GROUP BY ALL ORDER BY n DESC, rel_path LIMIT 100) WHERE n >= 8", detail="n")
        + ") UNION ALL SELECT * FROM (" + _find("fan_out_risk", "warn", "FROM (SELECT rel_path, count(*) AS n FROM e JOIN f USING (file_id) WHERE dst_type = 'file' AND resolved AND kind <> 'pkg' GROUP BY ALL ORDER BY n DESC, rel_path LIMIT 100) WHERE n >= 15", detail="n") + ")"
    ),
    "h03_oversized": S.sql(_find("oversized_file", "warn", "FROM f JOIN (SELECT file_id, max(end_line) AS lines FROM c GROUP BY 1) USING (file_id) WHERE lines >= 200 AND NOT regexp_matches(lower(rel_path), '\\.(json|jsonc|yaml|yml)$')", detail="lines")),
    "h04_dangling_includes": S.sql(_find("dangling_reference", "error", f"FROM e JOIN f USING (file_id) WHERE NOT coalesce(resolved, false) AND kind = 'includes' AND NOT coalesce(lang IN {S._list(P.MODULE_LANGS)}, false) AND {_REL}", "e.line", "raw")),
    "h06_redacted": S.sql(_find("hardcoded_secret", "warn", "FROM f WHERE redacted > 0", detail="redacted")),
    "h07_duplicate_keys": S.sql(
        "SELECT 'duplicate_keybind' AS check, 'warn' AS severity, (SELECT rel_path FROM w WHERE i = 1) AS rel_path, 3 AS line, 'q+super' AS detail",
        "w AS (SELECT rel_path, row_number() OVER (ORDER BY file_id) AS i FROM f WHERE role = 'wm-config')",
    ),
    "h08_broken_commands": S.sql(
        _find("broken_command", "warn", f"FROM (SELECT {_CMD} AS cmd, rel_path, e.line AS spot, edge_id FROM e JOIN f USING (file_id) WHERE NOT coalesce(resolved, false) AND kind IN ('execs', 'binds', 'autostarts') QUALIFY row_number() OVER (PARTITION BY cmd ORDER BY edge_id) = 1) "
        f"WHERE cmd <> '' AND NOT regexp_matches(cmd, '[/$]') AND cmd NOT IN {S._list(COMMANDS)}", "spot", "cmd")
    ),
    "h09_orphan_scripts": S.sql(_find("orphan_script", "warn", _ORPHANS + " AND NOT starts_with(rel_path, 'bin/')")),
    "h10_hardcoded_colors": S.sql(_COLORS, _NAMED),
    "h11_forbidden": S.sql(
        "SELECT * FROM (" + _find("forbidden_crossing", "error", "FROM l WHERE contains(src_path, 'src/core') AND contains(dst_path, 'tests/')", detail="'tests stay out: ' || src_path || ' -> ' || dst_path", path="src_path")
        + ") UNION ALL SELECT * FROM (" + _find("forbidden_crossing", "error", "FROM l WHERE regexp_matches(src_path, '\\.go$') AND regexp_matches(dst_path, '\\.sh$')", detail="'no scripts: ' || src_path || ' -> ' || dst_path", path="src_path") + ")",
        f"l AS ({_LINK})",
    ),
    "h13_violations": S.sql(
        f"SELECT 'dangling_' || kind AS check, 'error' AS severity, rel_path, e.line, raw AS detail FROM e JOIN f USING (file_id) WHERE NOT coalesce(resolved, false) AND kind IN ('includes', 'references', 'uses_resource') "
        f"AND NOT (kind = 'includes' AND coalesce(lang IN {S._list(P.MODULE_LANGS)}, false)) AND (kind = 'uses_resource' OR contains(raw, '/') OR starts_with(raw, '$') OR starts_with(raw, '@')) "
        f"UNION ALL {_find('orphan_script', 'warn', _ORPHANS)} UNION ALL {_COLORS}", _NAMED,
    ),
}
