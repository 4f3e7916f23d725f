"""Source files that nobody in the repository wrote by hand, with the reason.

Each chunk is lexed into comments, literals and the skeleton that is left, and the
skeleton is emitted again in canonical layout: a statement to a line, blocks indented
by their depth, long statements wrapped. The families of languages differ in what ends
a statement and bounds a block: marks (`;`, `{`, `}`), words (`then`, `do`, `end`, `fi`
and the like) or the line itself. What was emitted is compared with what stands there:

- extreme expansion marks minified code: many canonical lines for each line there is;
- literal dominance marks data: hardly anything but literals and the marks between them;
- perfect uniformity, every line indented as in the canonical layout with none at its end,
  supports a generator. In code formatted on save it is common by hand too, so it is
  reported (`profiles`) and never decides alone.

These figures add up over the chunks of a file, so no text is shuffled or gathered.
Place, name and the comment at the head of a file tell vendored and generated files. The
head is all that stands before the first line of code, over as many chunks as it takes.

The reasons are tried in this order: vendored, minified, generated, data.

Defined results: a file without chunks, or with null or empty texts only, is judged
by its path; null or empty lang falls back on the extension; of several rows of a
file the one indexed last counts; repeated chunks count once; chunks of a file
without a row are left out; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical lines for each line of code from which the layout counts as taken out.
EXPANSION = 12.0
#: Characters of a line in the canonical layout.
WIDTH = 100
#: Share of literals in what isn't comment from which a file is data, and the lower
#: share that will do where hardly any words are left beside them.
LITERALS, FEW_WORDS_LITERALS, FEW_WORDS = 0.98, 0.9, 70
#: Characters that a data file has at least.
DATA_CHARS = 400

# ---- fixed values: places, names and words that tell where a file comes from ----
VENDOR_DIRS = (
    "node_modules bower_components jspm_packages vendor third_party third-party thirdparty 3rdparty site-packages "
    "dist-packages Pods Carthage external externals extern deps subprojects Godeps _vendor vendored"
).split()
GENERATED_DIRS = "gen generated __generated__ autogen autogenerated generated-sources generated_sources".split()
GENERATED_NAMES = (
    r"(?:^|[_.-])generated\.[a-z0-9]+$|^zz_generated[._]|_gen\.[a-z]+$|\.gen\.[a-z]+$|\.pb\.[a-z.]+$|_pb2(?:_grpc)?\.pyi?$"
    r"|\.g\.(?:dart|cs)$|\.designer\.cs$|\.freezed\.dart$|^moc_.*\.cpp$|^ui_.*\.h$|_string\.go$|\.tab\.[ch]$|\.yy\.c$"
)
LOCK_FILES = (
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml composer.lock Pipfile.lock poetry.lock uv.lock Cargo.lock "
    "Gemfile.lock go.sum flake.lock packages.lock.json mix.lock pubspec.lock Podfile.lock bun.lockb deno.lock pdm.lock "
    "gradle.lockfile Package.resolved Cartfile.resolved conan.lock"
).split()
MINIFIED_NAMES = r"[.-](?:min|pack)\.(?:js|css|mjs|cjs)$"
CODE_LANGS = (
    "go python typescript javascript rust java cpp c tsx jsx css scss less bash sh fish lua ruby php kotlin swift csharp dart elixir qml scala"
).split()
CODE_EXTENSIONS = "go py pyi ts mts cts tsx js mjs cjs jsx rs java cpp cc cxx c h hpp css scss less sh bash fish lua rb php kt swift cs dart ex exs qml scala".split()
NOTICES = (
    r"\bcode generated by\b|@generated\b|<auto-?generated|\bauto-?generated (?:file|code|by|from)\b|\bautomatically (?:generated|created|produced) (?:by|from)\b"
    r"|\bgenerated by (?:the )?[\w .-]{1,40}(?:compiler|tool|generator|codegen|script)?\W+(?:do not|don't|please do not) (?:edit|modify|change|touch)"
    r"|\bthis (?:file|code) (?:is|was|has been) (?:auto-?|automatically |machine[- ])?generated\b|\bthis is (?:an? )?(?:auto-?|machine[- ])?generated (?:code|file)\b"
    r"|\bdo not (?:edit|modify)\b.{0,40}\b(?:produced|generated|created|built|written) (?:by|from|with)\b|\boutput of [\w .-]+\. (?:hand|manual) (?:edits|changes)\b"
    r"|\b(?:hand|manual) (?:edits|changes) (?:get|are|will be|would be) (?:overwritten|lost)\b|\bchanges will be (?:lost|overwritten)\b"
    r"|\bmachine[- ](?:written|made|generated|produced)\b|\bedit \S+ instead\b|^\W*(?:this file |file )?(?:was |is )?(?:auto-?|automatically )?(?:generated|produced|emitted) (?:by|from|with|using|via|on|at)\b"
    r"|\bne pas (?:modifier|[ée]diter)\b|\bnicht (?:bearbeiten|[äa]ndern|editieren)\b|\bno (?:editar|modificar)\b|\bg[ée]n[ée]r[ée]e? automatiquement\b|\b(?:automatisch|maschinell) (?:generiert|erzeugt|erstellt)\b|\bgenerado autom[áa]ticamente\b|\b(?:generiert|erzeugt) von [\w .-]+[,;] nicht\b"
    r"|\bgenerado por [\w .-]+[,;] no (?:editar|modificar)\b|\bg[ée]n[ée]r[ée] par [\w .-]+[,;] ne pas\b|自動生成|自动生成|сгенерирован"
)
# ---- end of fixed values ----

_RELEASE = r"\d+\.\d+(?:\.\d+)*"
_RELEASED = [
    re.compile(r"@license\s+(?P<p>[\w.@/-]+?)[\s@-]+v?" + _RELEASE, re.I),
    re.compile(r"\bpart of\s+(?:the\s+)?(?P<p>[\w.@/-]+),?\s+(?:version\s+|release\s+)?v?" + _RELEASE, re.I),
    re.compile(r"\b(?:imported|vendored|copied|taken|downloaded|forked|extracted) from\s+\S*?(?P<p>[\w.@-]+?)(?:\.git)?/?[\s,]+(?:at\s+)?(?:tag|release|version|rev|v)?\s*v?" + _RELEASE, re.I),
    re.compile(r"^\W*(?P<p>[A-Za-z@][\w.@/-]*?)(?:\.(?:min\.)?(?:js|css|py|lua|go|rs))?\s+(?:-\s*|–\s*)?(?:version\s+|release\s+)?v?" + _RELEASE + r"\b(?=[^\n]*(?:\||\(c\)|©|licen[sc]e|copyright|https?://)|\s*(?:\*/)?\s*\n\W*(?:https?://|copyright|\(c\)|©|licen[sc]))", re.I | re.M),
]
_LICENCE = re.compile(r"(?i)\(c\)|©|copyright|licen[sc]e|redistribution|https?://|unmodified|contributors")
_NOTICE = re.compile("(?i)" + NOTICES)
_STUB = re.compile(r"(?i)\b(?:method|function|class|constructor)?\s*stub\b")
_LEX = re.compile(
    r"(?P<c>/\*.*?(?:\*/|\Z)|(?<![:\w])//[^\n]*|^[ \t]*(?:#(?!\[|!\[|include\b|import\b|define\b|ifdef\b|ifndef\b|endif\b|pragma\b)|--(?!\w+:))[^\n]*|^[ \t]*(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)))"
    r"|(?P<s>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.|\\\Z)*+(?:\"|(?=\n)|\Z)|'[^'\\\n]*'|'[^'\\\n]*\\(?:.|\Z)(?:[^'\\\n]|\\.|\\\Z)*+(?:'|(?=\n)|\Z)|`(?:\\.|[^`\\])*+(?:`|\Z)|url\([^)\n]*\)|[A-Za-z0-9+/]{60,}={0,2})",
    re.S | re.M,
)
_NUMBER = re.compile(r"\b0[xX][0-9a-fA-F]+[uUlL]*\b|(?<![\w.])-?\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?(?:px|em|rem|%|f|[uUiIlL]\d*)?(?!\w)")
_SPACE = re.compile(r"\s+")
_TABLE = re.compile(r"[,:](?:\s*+(?:(?:\"\"|[-+])\s*+)*+[,:]){2,}+")
#: What ends a statement or bounds a block, by family: marks, words, or the line alone.
_BRACES = re.compile(r"[;{}()\[\]\n]")
_WORDS = re.compile(r"[;()\[\]\n]|\b(?:then|do|end|fi|done|esac|else|elsif|elseif|elif)\b")
_LINES = re.compile(r"[;()\[\]\n]")
_ENDS = re.compile(r"(?:^|[;\s])(?:end|fi|done|esac)(?=[\s;)]|\Z)")
_OPENERS = ("{", "then", "do")
_TURNS = ("else", "elsif", "elseif", "elif")
_WORD = re.compile(r"[A-Za-z_]\w*")
_SHEBANG = re.compile(r"\A(?:﻿)?(?:#![^\n]*\n)?")
_HEAD_LINE = re.compile(r"[ \t]*(?://|#(?!\[|!\[|include|define|pragma)|--|/\*|\*|;|<!--|\"\"\"|'''|%|\{?-)")


def head(text: str) -> tuple[str, bool]:
    """The comment before the first line of code, and whether no code follows; a text may begin within a block comment."""
    lines, at = [], _SHEBANG.match(text).end()
    close = text.find("*/", at)
    inside = "*/" if close >= 0 and text.find("/*", at, close) < 0 else ""
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        bare = text[at:stop].strip()
        at = stop + 1
        if inside:
            lines.append(bare)
            if inside in bare:
                inside = ""
            continue
        if not bare:
            lines.append("")
            continue
        if not _HEAD_LINE.match(bare):
            return "\n".join(lines).strip(), False
        lines.append(bare)
        for mark, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")):
            if bare.startswith(mark) and end not in bare[len(mark) :]:
                inside = end
    return "\n".join(lines).strip(), True


def notice(comment: str) -> bool:
    """Whether the head says of the file itself that a tool made it."""
    return any(_NOTICE.search(line) and not _STUB.search(line) for line in comment.split("\n"))


def released(comment: str) -> str | None:
    """The project whose release the head says the file is, or None."""
    if not _LICENCE.search(comment):
        return None
    bare = "\n".join(re.sub(r"^\W*?(?=[\w@])", "", x) for x in comment.split("\n"))
    for pattern in _RELEASED:
        m = pattern.search(bare)
        if m:
            return m["p"].rstrip("./").rpartition("/")[2].lower() or None
    return None


def emitted(skeleton: str) -> list[tuple[int, str]]:
    """The canonical layout of a skeleton: depth and text of its statements.

    The family is told by the marks and words that bound blocks; a line break ends a
    statement outside of brackets in all of them.
    """
    marks = _BRACES if "{" in skeleton or ";" in skeleton else _WORDS if _ENDS.search(skeleton) else _LINES
    out: list[tuple[int, str]] = []
    depth = brackets = begin = 0
    for m in marks.finditer(skeleton):
        mark, at = m[0], m.start()
        if mark in "([":
            brackets += 1
            continue
        if mark in ")]":
            brackets = max(0, brackets - 1)
            continue
        if mark in "\n;":
            if brackets:
                continue
            stop = m.end()
        elif mark in _OPENERS:
            stop = m.end()
        else:  # the end of a block stands on a line of its own
            statement = skeleton[begin:at].strip()
            if statement:
                out.append((depth, statement))
            begin, depth, brackets = at, max(0, depth - 1), 0
            if mark in _TURNS:
                stop = m.end()
                out.append((depth, mark))
                begin, depth = stop, depth + 1
            continue
        statement = skeleton[begin:stop].strip()
        if statement and statement != ";":
            out.append((depth, statement))
        begin = stop
        if mark in _OPENERS:
            depth, brackets = depth + 1, 0
    statement = skeleton[begin:].strip()
    if statement:
        out.append((depth, statement))
    return out


def profile(text: str) -> tuple[int, int, int, int, int]:
    """Lines of code, canonical lines, characters of code, of literals, and lines that are indented as in the canonical layout."""
    literal = 0
    kept: list[str] = []
    place = 0
    for m in _LEX.finditer(text):
        kept.append(text[place : m.start()])
        place = m.end()
        if m["c"] is None:
            body = m["s"]
            literal += len(body) - body.count(" ") - body.count("\n") if len(body) < 2000 else len(_SPACE.sub("", body))
            kept.append('""')
        elif "\n" in m["c"]:
            kept.append("\n")
    kept.append(text[place:])
    skeleton = "".join(kept)
    bare = _NUMBER.sub("", skeleton)
    numbers = len(skeleton) - len(bare)
    lines = [x for x in skeleton.split("\n") if x and not x.isspace()]
    # a table of literals is one literal
    canonical = emitted(_TABLE.sub('""', bare))
    size = sum(map(len, _WORD.findall(bare))) + literal + numbers
    depths = Counter(min(d, 12) for d, _ in canonical)
    widths = Counter(len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip(" ")) for x in lines if not x.rstrip("\r").endswith((" ", "\t")))
    # how many lines stand where the canonical layout has one, with the step of indentation that fits best
    regular = max(sum(min(n, widths[d * unit]) for d, n in depths.items()) for unit in (2, 4, 8)) if lines else 0
    return len(lines), sum(1 + (len(x) - 1 + 4 * d) // WIDTH for d, x in canonical), size, literal + numbers, regular


_SCHEMA = "chunk_id bigint, file_id bigint, start_line int, lines bigint, canonical bigint, size bigint, literal bigint, regular bigint, code boolean, notice boolean, project string"
_SUMS = ("lines", "canonical", "size", "literal", "regular")


def measured(chunks: DataFrame) -> DataFrame:
    """The figures of every chunk, whether it holds code, and what the comment before that says of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, rows = batch.column(2).to_pylist(), []
            for text in batch.column(3).to_pylist():
                if not text:
                    rows.append((0, 0, 0, 0, 0, False, False, None))
                    continue
                comment, whole = head(text)
                rows.append((*profile(text), not whole, notice(comment), released(comment)))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([1 if s is None else s for s in start], pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=[c.split()[0] for c in _SCHEMA.split(", ")],
            )

    picked = chunks.where("file_id is not null").select(
        F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col("file_id").cast("bigint").alias("file_id"), F.col("start_line").cast("int").alias("start_line"), "text"
    )
    return picked.mapInArrow(run, _SCHEMA)


def profiles(chunks: DataFrame) -> DataFrame:
    """One row per file: the sums of its chunks' figures, expansion, literal share, uniformity, and the notice and project of its head."""
    # copies of a chunk have the same figures, which fold by hash
    figures = [c.split()[0] for c in _SCHEMA.split(", ")[3:]]
    once = measured(chunks).groupBy("file_id", "chunk_id", "start_line").agg(F.min(F.struct(*figures)).alias("m")).select("file_id", "start_line", "m.*")
    # the head goes on over the chunks without code, up to the one with the first line of it
    told = once.groupBy("file_id").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min(F.when(F.col("code"), F.col("start_line"))).alias("first_code"),
        F.min(F.when(F.col("notice"), F.col("start_line"))).alias("first_notice"),
        F.min(F.when(F.col("project").isNotNull(), F.struct("start_line", "project"))).alias("first_project"),
    )
    lines = F.greatest(F.col("lines"), F.lit(1))
    reach = F.coalesce("first_code", F.lit((1 << 31) - 1))
    return told.select(
        "file_id", "lines", F.col("size").alias("code_chars"), (F.col("size") - F.col("literal")).alias("bare_chars"),
        F.coalesce(F.col("first_notice") <= reach, F.lit(False)).alias("notice"),
        F.when(F.col("first_project.start_line") <= reach, F.col("first_project.project")).alias("project"),
        (F.col("canonical") / lines).alias("expansion"),
        (F.col("literal") / F.greatest(F.col("size"), F.lit(1))).alias("literal_share"),
        F.least(F.col("regular") / lines, F.lit(1.0)).alias("uniformity"),
    )


def _in_dirs(path: Column, dirs: list[str]) -> Column:
    """Whether a folder of path below the repository is one of dirs."""
    names = "|".join(re.escape(d) for d in dirs)
    return path.rlike(rf"/(?:{names})/")


def classified(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, rel_path, role, size, reason and the figures of every file; reason is null for one written by hand."""
    newest = F.max(F.struct("indexed_at", "rel_path", "lang", "role", "size")).alias("row")
    latest = files.where("file_id is not null").groupBy(F.col("file_id").cast("bigint").alias("file_id")).agg(newest).select("file_id", "row.rel_path", "row.lang", "row.role", F.col("row.size").alias("bytes"))
    full = latest.join(profiles(chunks), "file_id", "left")
    path, name = F.coalesce("rel_path", F.lit("")), F.regexp_extract(F.coalesce("rel_path", F.lit("")), r"([^/]*)$", 1)
    lang = F.lower(F.trim(F.coalesce("lang", F.lit(""))))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    code = F.when(lang != "", lang.isin(CODE_LANGS)).otherwise(extension.isin(CODE_EXTENSIONS))
    own = F.lower(F.regexp_extract(path, r"^([^/]*)", 1))
    # under a folder for other people's code there is a folder for each project
    foreign = F.coalesce(F.col("project").isNotNull() & (F.col("project") != own) & (F.col("project") != F.regexp_replace(own, r"-\d+$", "")), F.lit(False))
    vendored = path.rlike(rf"/(?:{'|'.join(re.escape(d) for d in VENDOR_DIRS)})/[^/]+/") | foreign
    minified = code & (
        (F.col("expansion") >= EXPANSION) | name.rlike(MINIFIED_NAMES)
    )
    generated = (
        _in_dirs(path, GENERATED_DIRS) | F.lower(name).rlike(GENERATED_NAMES) | name.isin(LOCK_FILES) | F.col("notice")
    )
    words = F.col("bare_chars")
    literal = (F.col("literal_share") >= LITERALS) | (F.col("literal_share") >= FEW_WORDS_LITERALS) & (words <= FEW_WORDS)
    data = code & literal & (F.col("code_chars") >= DATA_CHARS)
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = F.when(yes(vendored), "vendored").when(yes(minified), "minified").when(yes(generated), "generated").when(yes(data), "data")
    return full.select("file_id", "rel_path", "role", F.col("bytes").alias("size"), reason.alias("reason"), "expansion", "literal_share", "uniformity", "project", "notice")


def found(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id and reason of every file not written by hand."""
    return classified(files, chunks).where("reason is not null").select("file_id", "reason")
