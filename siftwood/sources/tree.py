"""A source tree as a table: which files there are, which are left out, what changed.

Ignore files are rows (folder, ordinal, pattern). A path meets the patterns of all
folders above it in an equal join on the folder, and the deepest, last one that
fits decides; nothing is looked up on the driver.
"""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import paths as P


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, mtime and content of the files below a folder that every executor can read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace("path", "^[a-z]+:/+", "/")
    base = root.split("://", 1)[-1].rstrip("/").removeprefix("file:")
    return rows.select(bare.substr(F.lit(len(base) + 2), F.length(bare)).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def texts(files: DataFrame) -> DataFrame:
    """rel_path, size, mtime and text; files with a zero byte are no text."""
    text = F.decode("content", "UTF-8")
    return files.where(F.instr(text, "\x00") == 0).select("rel_path", "size", "mtime", text.alias("text"))


def walked(files: DataFrame) -> DataFrame:
    """The files outside folders that are never looked into, and no generated artifacts."""
    return files.where(~P.has_segment(P.dirname(F.col("rel_path")), P.SKIPPED_DIRS) & ~P.is_artifact(F.col("rel_path")))


def glob_regex(pattern: str) -> tuple[str, bool, bool]:
    """(expression, whether it takes back, whether for folders only) of one line of an ignore file.

    A pattern with a slash is bound to its folder, one without fits a name at any
    depth; * and ? don't cross folders.
    """
    negate = pattern.startswith("!")
    body = pattern[negate:].strip()
    folders = body.endswith("/")
    body = body.rstrip("/")
    bound = "/" in body
    body = body.lstrip("/")
    made = re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\", "").replace("!", "^", 1) + "]", re.escape(body).replace(r"\*", "[^/]*").replace(r"\?", "[^/]"))
    head = "^" if bound else "^(?:.*/)?"
    return f"{head}{made}{'/' if folders else '(?:/|$)'}", negate, folders


def patterns(spark: SparkSession, ignore_files: list[tuple[str, str]], extra: tuple[str, ...] = ()) -> DataFrame:
    """folder, ordinal, expression and negate of ignore files given as (folder, text), and of further globs for the root, which come last."""
    rows = []
    for folder, text in ignore_files:
        lines = [x.strip() for x in text.splitlines()]
        rows += [(folder, i, *glob_regex(x)[:2]) for i, x in enumerate(lines) if x and not x.startswith("#")]
    rows += [("", 1_000_000 + i, *glob_regex(x)[:2]) for i, x in enumerate(extra)]
    return spark.createDataFrame(rows, "folder string, ordinal int, expression string, negate boolean")


def kept(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """The files that the deepest, last pattern that fits doesn't leave out."""
    parts = F.split(P.dirname(F.col("rel_path")), "/")
    above = F.transform(F.sequence(F.lit(0), F.when(P.dirname(F.col("rel_path")) == "", 0).otherwise(F.size(parts))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = files.select("rel_path", F.explode(above).alias("folder")).join(ignored, "folder")
    inside = F.when(F.col("folder") == "", F.col("rel_path")).otherwise(F.expr("substr(rel_path, length(folder) + 2)"))
    fits = met.where(F.regexp_like(inside, F.col("expression")))
    told = fits.groupBy("rel_path").agg(F.max_by("negate", F.struct((F.col("ordinal") >= 1_000_000).alias("extra"), F.length("folder").alias("d"), "ordinal")).alias("negate"))
    return files.join(told.where("not negate").select("rel_path"), "rel_path", "left_anti")


def of_languages(files: DataFrame, policy: str | list[str], automatic: tuple[str, ...] = ()) -> DataFrame:
    """The files of a language policy: '*' for all with a language, 'auto' for the automatic ones, or a list."""
    if policy == "*":
        return files.where(F.col("lang") != "")
    return files.where(F.col("lang").isin(*(automatic if policy == "auto" else policy)))


def without_blocks(text: Column, begin: str, end: str) -> Column:
    """A text without the blocks that a tool wrote between two marks."""
    return F.regexp_replace(text, rf"(?s){re.escape(begin)}.*?{re.escape(end)}[^\n]*\n?", "")


def changed(now: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of now (rel_path, hash) that are new or whose hash differs from what is known."""
    before = known.select("rel_path", F.col("hash").alias("known_hash"))
    rows = now.join(before, "rel_path", "left")
    return rows.where(F.col("known_hash").isNull() | (F.col("known_hash") != F.col("hash"))).drop("known_hash")


def vanished(known: DataFrame, now: DataFrame) -> DataFrame:
    return known.join(now.select("rel_path"), "rel_path", "left_anti")


def signature(files: DataFrame) -> DataFrame:
    """files and signature of a tree: it doesn't depend on order or partitions."""
    one = F.xxhash64("rel_path", "size", "hash")
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("signature"))


def working_state(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """rel_path with staged, unstaged and untracked, each path once."""
    names = ("staged", "unstaged", "untracked")
    parts = [df.select("rel_path", *[F.lit(n == m).alias(m) for m in names]) for n, df in zip(names, (staged, unstaged, untracked), strict=True)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("rel_path").agg(*[F.bool_or(n).alias(n) for n in names])


def git_changed(spark: SparkSession, root: str, ref: str = "HEAD") -> DataFrame:
    """rel_path of what differs from a commit, and of what isn't tracked; read on the driver from the tree it has."""
    names: set[str] = set()
    for args in (["diff", "--name-only", ref], ["ls-files", "--others", "--exclude-standard"]):
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=False)
        names |= set(done.stdout.splitlines())
    return spark.createDataFrame([(n,) for n in sorted(names)], "rel_path string")


def line_history(spark: SparkSession, root: str, path: str, first: int, last: int, most: int = 10, seconds: int = 15) -> DataFrame:
    """commit, author, date and subject of the commits that touched a range of lines, newest first."""
    form = "%x01%H%x02%an%x02%aI%x02%s"
    done = subprocess.run(["git", "-C", root, "log", f"-L{first},{last}:{path}", f"-n{most}", "--no-patch", f"--format={form}"], capture_output=True, text=True, timeout=seconds, check=False)
    rows = [tuple(x.split("\x02")) for x in done.stdout.replace("\n", "").split("\x01") if x.count("\x02") == 3]
    return spark.createDataFrame(rows, "commit string, author string, date string, subject string")
