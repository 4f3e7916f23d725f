"""Health checks over the index: each gives findings check, severity, rel_path, line and detail."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.index import Index
from siftwood.operators import graph, reads, stats

FAN_IN, FAN_OUT, OVERSIZED = 8, 15, 800
# ---- fixed values: endings of files that an include may name ----
INCLUDE_ENDINGS = ("css", "scss", "conf", "sh", "bash", "fish", "py", "lua", "qml", "toml", "yaml", "yml", "json", "jsonc", "ini", "rasi", "rasi2")
# ---- end of fixed values ----


def finding(df: DataFrame, check: str, severity: str, path: str = "rel_path", line: Column | None = None, detail: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(path).alias("rel_path"),
        (F.lit(None) if line is None else line).cast("int").alias("line"), (F.lit("") if detail is None else detail).cast("string").alias("detail"),
    )


def cyclic_includes(index: Index) -> DataFrame:
    """One finding per file on a ring; a ring is named by the file with its smallest id."""
    return finding(graph.include_cycles(index), "cyclic_include", "error", detail=F.col("circle"))


def fan_risks(index: Index, fan_in: int = FAN_IN, fan_out: int = FAN_OUT, pool: int = 100) -> DataFrame:
    many = stats.fan_in(index, ("pkg",)).orderBy(F.desc("n"), "rel_path").limit(pool).where(F.col("n") >= fan_in)
    wide = stats.fan_out(index, ("pkg",)).orderBy(F.desc("n"), "rel_path").limit(pool).where(F.col("n") >= fan_out)
    return finding(many, "fan_in_risk", "warn", detail=F.col("n")).unionByName(finding(wide, "fan_out_risk", "warn", detail=F.col("n")))


def oversized(index: Index, lines: int = OVERSIZED) -> DataFrame:
    rows = reads.sizes_and_lines(index).where((F.col("lines") >= lines) & ~P.extension(F.col("rel_path")).isin("json", "jsonc", "yaml", "yml"))
    return finding(rows, "oversized_file", "warn", detail=F.col("lines"))


def repo_relative(raw: Column) -> Column:
    """Whether a written target names a place in the repository: no home, root, variable or address, and a folder or a known ending."""
    value = F.trim(F.regexp_replace(F.regexp_replace(raw, "^[\"']+|[\"']+$", ""), r"^\s+|\s+$", ""))
    name = F.element_at(F.split(value, "/"), -1)
    known = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).isin(*INCLUDE_ENDINGS)
    out = F.substring(value, 1, 1).isin("~", "/", "$", "@") | value.contains("://") | (value == "")
    return ~out & (value.contains("/") | known)


def dangling_includes(index: Index) -> DataFrame:
    rows = index.edges.where((~F.coalesce("resolved", F.lit(False))) & (F.col("kind") == "includes") & repo_relative(F.col("raw")))
    known = index.files.where(~F.coalesce(F.col("lang").isin(*P.MODULE_LANGS), F.lit(False))).select("file_id", "rel_path")
    return finding(rows.join(known, "file_id"), "dangling_reference", "error", line=F.col("line"), detail=F.col("raw"))


def redacted(index: Index) -> DataFrame:
    return finding(reads.redacted_files(index), "hardcoded_secret", "warn", detail=F.col("redacted"))


def canonical_key(name: Column) -> Column:
    """A key combination with its parts in order, case and separators apart."""
    parts = F.filter(F.split(F.lower(F.translate(name, ",+", "  ")), r"\s+"), lambda x: x != "")
    return F.array_join(F.array_sort(parts), "+")


def duplicate_keys(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Keys bound more than once in window manager configurations, placed at the first."""
    wm = files.where(F.col("role") == "wm-config").select("file_id", "rel_path")
    bound = symbols.where(F.col("kind") == "keybind").join(wm, "file_id").withColumn("key", canonical_key(F.col("name")))
    told = bound.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rel_path", "start_line")).alias("first")).where("n > 1")
    return finding(told.select("key", F.col("first.rel_path").alias("rel_path"), F.col("first.start_line").alias("at")), "duplicate_keybind", "warn", line=F.col("at"), detail=F.col("key"))


def broken_commands(index: Index, known: DataFrame) -> DataFrame:
    """Bare commands that are run and that neither the repository nor known (name) has, each once."""
    rows = reads.unresolved(index, ["execs", "binds", "autostarts"])
    command = F.regexp_replace(F.split(F.trim("raw"), r"\s+")[0], "^[\"']+|[\"']+$", "")
    bare = rows.withColumn("command", command).where((F.col("command") != "") & ~F.col("command").rlike("[/$]"))
    bare = bare.join(known.select(F.col("name").alias("command")), "command", "left_anti")
    first = bare.groupBy("command").agg(F.min(F.struct("edge_id", "file", "line")).alias("m")).select("command", F.col("m.file").alias("rel_path"), F.col("m.line").alias("at"))
    return finding(first, "broken_command", "warn", line=F.col("at"), detail=F.col("command"))


def orphan_scripts(index: Index) -> DataFrame:
    return finding(reads.without_incoming(index, "script").where(~F.col("rel_path").startswith("bin/")), "orphan_script", "warn")


def hardcoded_colors(index: Index) -> DataFrame:
    """Literal values that a named resource has too; of several names the one with the last id."""
    value = F.length("value") > 0
    named = index.resources.where(value & (F.length("name") > 0)).groupBy("value").agg(F.max_by("name", "resource_id").alias("variable"))
    literal = index.resources.where(value & ~F.coalesce(F.length("name") > 0, F.lit(False)))
    rows = literal.join(named, "value").join(index.paths, "file_id", "left")
    return finding(rows, "hardcoded_color", "info", line=F.col("line"), detail=F.concat_ws(" duplicates ", "value", "variable"))


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether a path, or its name, fits a glob; a pattern without marks fits where it stands in the path."""
    if not any(c in pattern for c in "*?["):
        return path.contains(pattern)
    whole = fnmatch.translate(pattern).replace("(?s:", "").replace(r")\Z", "").replace(".*", "[^/]*").replace("(?>", "(?:")
    name = P.basename(path)
    return path.rlike(f"^{whole}$") | name.rlike(f"^{whole}$")


def forbidden(index: Index, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Links that a rule (name, from, to) forbids; a rule is a filter over the links, not a join."""
    links = index.links().select("src_path", "dst_path")
    parts = [
        finding(links.where(matches_glob(F.col("src_path"), a) & matches_glob(F.col("dst_path"), b)), "forbidden_crossing", "error", path="src_path", detail=F.concat(F.lit(f"{name}: "), "src_path", F.lit(" -> "), "dst_path"))
        for name, a, b in rules
    ]
    return reduce(DataFrame.unionByName, parts) if parts else finding(links.limit(0), "forbidden_crossing", "error", path="src_path")


def violations(index: Index) -> DataFrame:
    """Dangling references, scripts nobody runs and literal colours, with the wider test of what is a path."""
    rows = reads.unresolved(index, ["includes", "references", "uses_resource"]).join(index.files.select(F.col("rel_path").alias("file"), "lang"), "file")
    outside = (F.col("kind") == "includes") & F.coalesce(F.col("lang").isin(*P.MODULE_LANGS), F.lit(False))
    pathy = F.col("raw").contains("/") | F.col("raw").startswith("$") | F.col("raw").startswith("@")
    rows = rows.where(~outside & ((F.col("kind") == "uses_resource") | pathy))
    bad = rows.select(F.concat(F.lit("dangling_"), "kind").alias("check"), F.lit("error").alias("severity"), F.col("file").alias("rel_path"), F.col("line"), F.col("raw").alias("detail"))
    return bad.unionByName(finding(reads.without_incoming(index, "script"), "orphan_script", "warn")).unionByName(hardcoded_colors(index))


def findings(index: Index, known_commands: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """All findings of the index."""
    parts = [
        cyclic_includes(index), fan_risks(index), oversized(index), dangling_includes(index), redacted(index), duplicate_keys(index.symbols, index.files),
        broken_commands(index, known_commands), orphan_scripts(index), hardcoded_colors(index), forbidden(index, rules),
    ]
    return reduce(DataFrame.unionByName, parts)


def new_findings(now: DataFrame, before: DataFrame) -> DataFrame:
    """The findings that a baseline doesn't hold."""
    keys = ["check", "rel_path", "line", "detail"]
    on = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return now.alias("n").join(before.alias("b"), on, "left_anti")
