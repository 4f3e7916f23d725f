"""Curated documents and their anchors in source text: digests, freshness, lint, proposals."""

from __future__ import annotations

import hashlib
import posixpath
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG")


def lines(text: Column) -> Column:
    """The lines of a text: CRLF as LF, one final newline dropped."""
    plain = F.regexp_replace(text, "\r\n", "\n")
    return F.split(F.regexp_replace(plain, r"\n\z", ""), "\n", -1)


def region_hash(text: Column, first: Column, last: Column) -> Column:
    """The digest of a range of lines (from 1, last included), or null where the text has no such range."""
    all_ = lines(text)
    inside = (first >= 1) & (last >= first) & (last <= F.size(all_))
    return F.when(inside, F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.slice(all_, F.when(inside, first).otherwise(1), F.when(inside, last - first + 1).otherwise(1)), "\n"), 256)))


def span_digest(text: Column, first: Column, last: Column) -> Column:
    """Twelve digits of the digest of a definition's lines, carriage returns dropped."""
    all_ = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.substring(F.sha2(F.array_join(F.slice(all_, first, last - first + 1), "\n"), 256), 1, 12)


def peek(text: Column, first: Column, last: Column) -> Column:
    """The lines of a range, cut to what there is."""
    all_ = F.split(text, "\r?\n", -1)
    low = F.greatest(F.lit(1), first)
    return F.array_join(F.slice(all_, low, F.greatest(F.lit(0), F.least(last, F.size(all_)) - low + 1)), "\n")


def relocate(text: str, want: str, span: int, origin: int) -> int | None:
    """The first line of the region with a digest that lies nearest to origin; at equal distance the later one."""
    rows = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
    found = [i + 1 for i in range(len(rows) - span + 1) if "sha256:" + hashlib.sha256("\n".join(rows[i : i + span]).encode()).hexdigest() == want]
    return min(found, key=lambda s: (abs(s - origin), -s), default=None) if span > 0 else None


@F.pandas_udf(T.IntegerType())
def relocated(text: pd.Series, want: pd.Series, span: pd.Series, origin: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or w is None else relocate(t, w, int(n), int(o)) for t, w, n, o in zip(text, want, span, origin, strict=True)], dtype="Int32")


def checked(anchors: DataFrame, sources: DataFrame) -> DataFrame:
    """Each anchor (anchor_id, path, first, last, hash) with status and moved_to against sources (path, text).

    current: the lines are as they were; moved: they stand elsewhere; stale: they
    changed; missing: the file is gone; invalid: the path or range can't be.
    """
    safe = (F.length("path") > 0) & ~F.col("path").startswith("/") & ~F.col("path").startswith("../") & (F.col("path") != "..")
    rows = anchors.join(sources.select("path", "text", F.lit(True).alias("there")), "path", "left")
    actual = region_hash(F.col("text"), F.col("first"), F.col("last"))
    rows = rows.withColumn("actual", actual)
    shifted = F.coalesce(F.col("actual") != F.col("hash"), F.lit(False))
    rows = rows.withColumn("moved_to", F.when(shifted, relocated("text", "hash", F.col("last") - F.col("first") + 1, F.col("first"))))
    status = (
        F.when(~F.coalesce(safe, F.lit(False)), "invalid").when(F.col("there").isNull(), "missing").when(F.col("actual").isNull(), "invalid").when(F.col("actual") == F.col("hash"), "current")
        .when(F.col("moved_to").isNotNull(), "moved").otherwise("stale")
    )
    return rows.select("anchor_id", "path", "first", "last", status.alias("status"), "moved_to")


def repaired(anchors: DataFrame, checks: DataFrame) -> DataFrame:
    """The anchors with the ranges of moved ones brought up to date."""
    moved = checks.where("status = 'moved'").select("anchor_id", "moved_to")
    rows = anchors.join(moved, "anchor_id", "left")
    shift = F.coalesce(F.col("moved_to") - F.col("first"), F.lit(0))
    return rows.select("anchor_id", "path", (F.col("first") + shift).alias("first"), (F.col("last") + shift).alias("last"), "hash")


def stable_id(namespace: str, *parts: Column) -> Column:
    """namespace and 24 digits of the digest of the parts, each after a zero byte."""
    body = F.concat(*[x for p in parts for x in (F.char(F.lit(0)), p)])
    return F.concat(F.lit(namespace + ":"), F.substring(F.sha2(body, 256), 1, 24))


def local_links(body: Column) -> Column:
    """The Markdown files that a body links to in its bundle."""
    raw = F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)
    bare = F.transform(raw, lambda x: F.regexp_replace(x, "[?#].*$", ""))
    return F.filter(bare, lambda x: (~x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")) & (~x.startswith("//")) & F.lower(x).endswith(".md"))


def valid_dates(first: Column, last: Column) -> Column:
    """Whether both dates, where given, can be read and are in order."""
    a, b = F.try_to_timestamp(first), F.try_to_timestamp(last)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return ~(given(first) & a.isNull()) & ~(given(last) & b.isNull()) & F.coalesce(a <= b, F.lit(True))


@F.pandas_udf(T.StringType())
def _linked(path: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([_target(p, x) for p, x in zip(path, link, strict=True)])


def _target(path: str, link: str) -> str:
    made = posixpath.normpath(link.lstrip("/") if link.startswith("/") else posixpath.join(posixpath.dirname(path or ""), link))
    return made


def lint(documents: DataFrame, checks: DataFrame) -> DataFrame:
    """code, severity and path of what is wrong with documents (path, id, status, valid_from, valid_to, resource, related, body) and their anchors (path, status)."""

    def told(df: DataFrame, code: str, severity: str) -> DataFrame:
        return df.select(F.lit(f"knowledge.{code}").alias("code"), F.lit(severity).alias("severity"), "path")

    order = Window.partitionBy("id").orderBy("path")
    same = documents.where(F.length("id") > 0).withColumn("n", F.row_number().over(order)).withColumn("first_body", F.first("body").over(order)).withColumn("first_status", F.first("status").over(order))
    again = same.where("n > 1")
    links = documents.select("path", F.explode(local_links(F.col("body"))).alias("link")).withColumn("target", _linked("path", "link"))
    known = documents.select(F.col("path").alias("target"))
    broken = links.where(F.col("target").startswith("..")).unionByName(links.where(~F.col("target").startswith("..")).join(known, "target", "left_anti").select(links.columns))
    linked = links.join(known, "target", "left_semi").select(F.col("target").alias("path"))
    alone = documents.where((F.size(local_links(F.col("body"))) == 0) & (F.coalesce(F.size("related"), F.lit(0)) <= 0)).join(linked, "path", "left_anti")
    several = documents.limit(2).count() > 1
    per_anchor = {"stale": ("stale_anchor", "warning"), "moved": ("moved_anchor", "info"), "missing": ("missing_anchor", "warning"), "invalid": ("invalid_anchor", "error")}
    bare = documents.where((F.lower("status") == "accepted") & (F.coalesce("resource", F.lit("")) == "")).join(checks.select("path"), "path", "left_anti")
    parts = [
        told(again, "duplicate_id", "error"), told(again.where(~F.col("body").eqNullSafe(F.col("first_body")) | ~F.col("status").eqNullSafe(F.col("first_status"))), "contradiction", "warning"),
        told(documents.where(~valid_dates(F.col("valid_from"), F.col("valid_to"))), "invalid_temporal_range", "error"),
        told(documents.where((F.length("resource") > 0) & ~F.col("resource").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")), "invalid_resource", "warning"),
        told(broken, "broken_link", "warning"), *[told(checks.where(F.col("status") == s), code, severity) for s, (code, severity) in per_anchor.items()],
        told(bare, "missing_evidence", "warning"), told(alone if several else alone.limit(0), "orphan", "info"),
    ]
    return reduce(DataFrame.unionByName, parts)


def work_markers(texts: DataFrame, key: str, start_line: str = "start_line", most: int = 50, width: int = 200) -> DataFrame:
    """key, line, kind and text of the lines with a work marker, the first of each line; at most 50 of a text are listed."""
    pattern = rf"\b({'|'.join(MARKERS)})\b"
    rows = texts.where(F.col("text").rlike(pattern) & ~F.col("text").contains("\x00")).select(key, F.col(start_line).alias("base"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    found = rows.where(F.col("raw").rlike(pattern)).select(key, (F.coalesce("base", F.lit(1)) + F.col("at")).alias("line"), F.regexp_extract("raw", pattern, 1).alias("kind"), F.substring(F.regexp_replace("raw", r"^\s+|\s+$", ""), 1, width).alias("text"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("n") <= most).drop("n")


# ---------------------------------------------------------------- front matter and decisions

_FRONT = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z", re.S)


def front_matter(text: str) -> tuple[dict[str, str], str, str]:
    """The plain fields of the front matter, the front matter as it stands, and the body; nested fields stay in the raw part."""
    m = _FRONT.match(text)
    if not m:
        return {}, "", text
    fields = dict(re.findall(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*\r?$", m[1]))
    return {k: v.strip("\"'") for k, v in fields.items()}, m[1], m[2]


def with_front_matter(raw: str, body: str) -> str:
    return f"---\n{raw}\n---\n{body}" if raw else body


def decide(version: int, expected: int, decision: str, key: str, done: dict[str, dict]) -> dict:
    """One decision on a proposal: the same key gives the same answer again; an outdated version is refused."""
    if key in done:
        return done[key]
    if version != expected:
        raise ValueError(f"version {expected} was expected, {version} is there")
    if decision not in ("accepted", "rejected"):
        raise ValueError(decision)
    done[key] = {"decision": decision, "version": version + 1}
    return done[key]


# ---------------------------------------------------------------- bundles


def bundle(spark, root: str, most_bytes: int = 4 << 20) -> DataFrame:
    """path, fields, front, body and hash of the Markdown documents below a folder; its index and log are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = len(root.split("://", 1)[-1].removeprefix("file:").rstrip("/"))
    bare = F.regexp_replace("path", "^[a-z]+:/+", "/")
    named = rows.where(F.col("length") <= most_bytes).select(bare.substr(F.lit(base + 2), F.length(bare)).alias("path"), F.decode("content", "UTF-8").alias("text"))
    kept = named.where(~F.lower(F.element_at(F.split("path", "/"), -1)).isin("index.md", "log.md"))
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    fields = F.map_from_entries(F.transform(F.regexp_extract_all(front, F.lit(r"(?m)^([A-Za-z_][\w-]*:[ \t]*.*)$"), 1), lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^['\"]|['\"]$", "").alias("value"))))
    return kept.select("path", fields.alias("fields"), front.alias("front"), body.alias("body"), F.sha2("text", 256).alias("hash"))


def index_page(documents: list[tuple[str, str]], before: str = "", begin: str = "<!-- index -->", end: str = "<!-- /index -->") -> str:
    """A page that lists documents (path, title) between two marks; what stands around the marks stays."""
    block = "\n".join([begin, *(f"- [{title or path}]({path})" for path, title in sorted(documents)), end])
    if begin in before and end in before:
        head, _, rest = before.partition(begin)
        return head + block + rest.partition(end)[2]
    return (before.rstrip("\n") + "\n\n" if before else "") + block + "\n"
