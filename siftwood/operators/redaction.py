"""The masks that an index sets before it stores a text: keys of services, passwords in addresses, private keys.

Rows without any of the strings that a pattern needs don't reach Python. The
patterns are those of the index format, so that both count alike; finding
credentials by how they are written and where they stand is another operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[redacted]"
# ---- fixed values: shapes that are masked, and passwords that only stand for one ----
PREFIXED = (
    r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"xox[abposr]-[A-Za-z0-9-]{10,}", r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
)
SK = r"\bsk-(?:[A-Za-z0-9_-]{40,}|[A-Za-z0-9_]{24,}(?![A-Za-z0-9_-]))"
URL = r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]*:)([^\s@/]{4,})(@)"
STAND_INS = ("pass", "password", "passwd", "secret", "token", "user", "username", "changeme", "example", "test", "xxx", "redacted", "yourpassword", "hunter2")
TRIGGERS = ("://", "-----", "sk_", "sk-", "pk_", "rk_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AKIA", "AIza", "eyJ")
KEY_MARK = r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----"
KEY_LINE = r"[A-Za-z0-9+/]{4,}={0,2}"
# ---- end of fixed values ----

_KEYS = re.compile("|".join((PREFIXED[0], SK, *PREFIXED[1:])))
_URL = re.compile(URL)
_MARK = re.compile(KEY_MARK)
_BREAK = re.compile(r"\r?\n|(?:\\r)?\\n")
_LINE = re.compile(KEY_LINE)


def may_hold(text: Column) -> Column:
    """Whether a text has a string that some pattern needs."""
    out = F.lit(False)
    for t in TRIGGERS:
        out = out | text.contains(t)
    return out


def prefixed(text: Column) -> Column:
    """How many keys of services a text holds."""
    return F.regexp_count(text, F.lit("|".join((PREFIXED[0], SK, *PREFIXED[1:]))))


def stands_in(password: str) -> bool:
    """Whether a password in an address is none."""
    return password.lower() in STAND_INS or not password.strip("*") or password[0] + password[-1] == "<>" or password.startswith("${") and password.endswith("}")


def is_material(body: str) -> bool:
    """Whether a line of a body is nothing but the letters of an encoded key."""
    return any(_LINE.fullmatch(x.strip(" \t\r")) for x in _BREAK.split(body)) and MASK not in body


def _private_keys(text: str) -> tuple[str, int]:
    """Bodies between marks masked; a body that a chunk cuts off is masked up to the cut."""
    marks = list(_MARK.finditer(text))
    if not marks:
        return text, 0
    out, n, place = [], 0, 0
    for i, m in enumerate(marks):
        if m[1] == "BEGIN":
            brk = _BREAK.match(text, m.end())
            closed = i + 1 < len(marks) and marks[i + 1][1] == "END"
            last = i + 1 == len(marks)
            stop = marks[i + 1].start() if closed else len(text)
            if brk and (closed or last) and is_material(text[brk.end() : stop]):
                out += [text[place : m.end()], "\n", MASK, "\n" if closed else ""]
                place, n = stop, n + 1
        elif i == 0 and m.start() and is_material(text[: m.start()]):
            out += [MASK, "\n"]
            place, n = m.start(), n + 1
    return "".join(out) + text[place:], n


def redact_text(text: str) -> tuple[str, int]:
    """text masked, and how many values were; a second run masks nothing."""
    if not any(t in text for t in TRIGGERS):
        return text, 0
    text, n = _private_keys(text)
    text, k = _KEYS.subn(MASK, text)

    def password(m: re.Match[str]) -> str:
        nonlocal n
        if stands_in(m[2]) or MASK in m[2]:
            return m[0]
        n += 1
        return m[1] + MASK + m[3]

    n += k
    return _URL.sub(password, text), n


def ends_open(text: str) -> bool:
    """Whether the last mark of a text opens a key."""
    marks = _MARK.findall(text)
    return bool(marks) and marks[-1] == "BEGIN"


def redact_chunks(chunks: DataFrame) -> DataFrame:
    """chunk_id, file_id, start_line, text and n: each chunk masked, and whole chunks between the marks of a key that spans them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [redact_text(t) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            columns = list(batch.columns)
            columns[at] = pa.array([d[0] for d in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d[1] for d in done], pa.int32())], names=[*batch.schema.names, "n"])

    rows = chunks.select("chunk_id", "file_id", "start_line", "text").dropDuplicates(["chunk_id"])
    hit = F.coalesce(may_hold(F.col("text")), F.lit(False))
    masked = rows.where(hit).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n", T.IntegerType())]))
    told = masked.unionByName(rows.where(~hit).withColumn("n", F.lit(0)))
    # the marks of files that have any, in order: is a key open where a chunk without marks begins?
    last = F.regexp_extract_all("text", F.lit(KEY_MARK), 1)
    mark = F.when(F.size(last) > 0, F.element_at(last, -1))
    marked = told.select("chunk_id", "file_id", "start_line", mark.alias("mark"))
    open_files = marked.where("mark is not null").select("file_id").distinct()
    before = Window.partitionBy("file_id").orderBy("start_line", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.join(open_files, "file_id", "left_semi").withColumn("open", F.last("mark", ignorenulls=True).over(before)).where("open = 'BEGIN' and mark is null").select("chunk_id", F.lit(True).alias("inside"))
    full = told.join(inside, "chunk_id", "left")
    body = F.col("inside") & (F.length(F.trim("text")) > 0) & ~F.col("text").contains(MASK)
    hidden = F.coalesce(body, F.lit(False))
    return full.select("chunk_id", "file_id", "start_line", F.when(hidden, MASK).otherwise(F.col("text")).alias("text"), (F.col("n") + hidden.cast("int")).alias("n"))
