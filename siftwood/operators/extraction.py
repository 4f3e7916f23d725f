"""Symbols, edges and resources of source text, and its chunks, language by language.

One pass in Arrow batches reads a text and gives a nested row; four explodes make
the tables of it. A language is a small table of line patterns; its bodies end by
braces, by indentation or by a closing word. Lines of simple configuration files
need no pass in Python: `generic_lines` is a plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WINDOW = 40
MOST_DOC_LINES = 15
COMMENT_MARKS = ("//", "#", "/*", "*", "--", "<!--")


@dataclass(frozen=True)
class Language:
    """What the lines of a language look like: (kind, pattern with a group name), and what an import names."""

    symbols: tuple[tuple[str, str], ...] = ()
    includes: tuple[str, ...] = ()
    execs: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()
    resources: tuple[tuple[str, str], ...] = ()
    body: str = "braces"
    decisions: str = r"\b(?:if|for|while|case|catch|match|when|elif|elsif|guard)\b|&&|\|\||\?\s"
    compiled: dict = field(default_factory=dict, compare=False, hash=False)


_ID = r"(?P<name>[A-Za-z_]\w*)"
_JS_IMPORT = (r"^\s*import\b.*?from\s+['\"](?P<raw>[^'\"]+)['\"]", r"^\s*import\s+['\"](?P<raw>[^'\"]+)['\"]", r"^\s*export\b.*?from\s+['\"](?P<raw>[^'\"]+)['\"]", r"require\(\s*['\"](?P<raw>[^'\"]+)['\"]\s*\)")
_JS = (
    ("function", rf"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*{_ID}"), ("class", rf"^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+{_ID}"),
    ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+{_ID}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"),
    ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>(?!(?:if|for|while|switch|catch|return|function|new)\b)[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^;{}=]+)?\{"),
)
_TS = (*_JS, ("interface", rf"^\s*(?:export\s+)?interface\s+{_ID}"), ("type", rf"^\s*(?:export\s+)?type\s+{_ID}\s*[=<]"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_ID}"))
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|open|override|virtual|async|synchronized|native|default|data|inner|suspend|inline|readonly|unsafe|extern|new)\s+)*"
_JVM_METHOD = ("method", rf"^\s*{_MOD}(?:<[^>]+>\s*)?(?!(?:return|new|else|throw|package|import|class|interface|enum|record|namespace|using)\b)[\w.<>\[\],?]+\s+(?P<name>(?!(?:if|for|while|switch|catch)\b)\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\s*(?:\{{|=>|$)")

LANGUAGES: dict[str, Language] = {
    "go": Language((("method", rf"^func\s+\([^)]*\)\s*{_ID}\s*\("), ("function", rf"^func\s+{_ID}\s*(?:\[[^\]]*\])?\("), ("type", rf"^type\s+{_ID}\b")), (r"^\s*import\s+(?:\w+\s+)?\"(?P<raw>[^\"]+)\"", r"^\s+(?:[\w.]+\s+)?\"(?P<raw>[\w./-]+)\"\s*$")),
    "python": Language((("function", rf"^\s*(?:async\s+)?def\s+{_ID}"), ("class", rf"^\s*class\s+{_ID}")), (r"^\s*from\s+(?P<raw>[.\w]+)\s+import\b", r"^\s*import\s+(?P<raw>[\w.]+)"), body="indent", decisions=r"\b(?:if|elif|for|while|except|and|or|case)\b"),
    "typescript": Language(_TS, _JS_IMPORT),
    "tsx": Language(_TS, _JS_IMPORT),
    "javascript": Language(_JS, _JS_IMPORT),
    "rust": Language(
        (("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+{_ID}"), *((k, rf"^\s*(?:pub(?:\([^)]*\))?\s+)?{w}\s+{_ID}") for k, w in (("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type"), ("module", "mod"))), ("macro", rf"^\s*macro_rules!\s+{_ID}")),
        (r"^\s*(?:pub\s+)?use\s+(?P<raw>[^;]+);",),
    ),
    "java": Language((*((k, rf"^\s*{_MOD}{k}\s+{_ID}") for k in ("class", "interface", "enum")), _JVM_METHOD), (r"^\s*import\s+(?:static\s+)?(?P<raw>[\w.*]+)\s*;",)),
    "kotlin": Language((("enum", rf"^\s*{_MOD}enum\s+class\s+{_ID}"), ("class", rf"^\s*{_MOD}(?:class|interface)\s+{_ID}"), ("object", rf"^\s*{_MOD}(?:companion\s+)?object\s+{_ID}"), ("function", rf"^\s*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_ID}")), (r"^\s*import\s+(?P<raw>[\w.*]+)",)),
    "ruby": Language((("method", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)"), ("class", rf"^\s*class\s+{_ID}"), ("module", rf"^\s*module\s+{_ID}")), (r"^\s*require(?:_relative)?\s+['\"](?P<raw>[^'\"]+)['\"]",), body="end"),
    "csharp": Language((*((k, rf"^\s*{_MOD}{k}\s+{_ID}") for k in ("class", "interface", "struct", "record", "enum")), _JVM_METHOD), (r"^\s*using\s+(?:static\s+)?(?P<raw>[\w.]+)\s*;",), resources=(("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"),)),
    "php": Language((*((k, rf"^\s*(?:abstract\s+|final\s+)*{k}\s+{_ID}") for k in ("class", "interface", "trait", "enum")), ("method", rf"^\s+{_MOD}function\s+&?{_ID}"), ("function", rf"^function\s+&?{_ID}")), (r"^\s*use\s+(?:function\s+|const\s+)?(?P<raw>[\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<raw>[^'\"]+)['\"]"), resources=(("namespace", r"^\s*namespace\s+(?P<name>[\w\\]+)"),)),
    "dart": Language((*((k, rf"^\s*(?:abstract\s+|sealed\s+)?{k}\s+{_ID}") for k in ("class", "mixin", "enum", "extension")), ("function", r"^(?:[\w<>?,]+\s+)(?P<name>\w+)\s*\([^;]*\)\s*(?:async\s*)?[{=]")), (r"^\s*(?:import|part|export)\s+(?!of\b)['\"](?P<raw>[^'\"]+)['\"]",)),
    "elixir": Language((("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("function", r"^\s*defp?\s+(?P<name>\w+[?!]?)")), (r"^\s*(?:alias|import|use|require)\s+(?P<raw>[A-Z][\w.]*)",), resources=(("namespace", r"^\s*defmodule\s+(?P<name>[\w.]+)"),), body="end"),
    "swift": Language((*((k, rf"^\s*{_MOD}{k}\s+{_ID}") for k in ("struct", "class", "enum", "extension", "protocol")), ("function", rf"^\s*{_MOD}func\s+{_ID}"), ("case", rf"^\s*case\s+{_ID}"), ("property", rf"^\s*{_MOD}(?:let|var)\s+{_ID}")), (r"^\s*import\s+(?P<raw>\w+)",), uses=(r"(?<![\w.])(?P<raw>[A-Z]\w+)",)),
    "cpp": Language((("class", rf"^\s*(?:class|struct)\s+{_ID}\s*(?::|\{{|$)"), ("function", r"^(?!\s*(?:return|else|throw|new|using|typedef|namespace)\b)[\w:<>,&*~ ]+?[\s&*]+(?P<name>(?!(?:if|for|while|switch|catch)\b)[\w:~]+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|\s)*\{")), (r"^\s*#\s*include\s+\"(?P<raw>[^\"]+)\"",)),
    "lua": Language((("function", r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)"), ("function", r"^\s*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\b")), (r"\brequire\s*\(?\s*['\"](?P<raw>[^'\"]+)['\"]",), body="end"),
    "bash": Language((("function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?"),), (r"^\s*(?:source|\.)\s+(?P<raw>\S+)",), (r"^\s*(?P<raw>(?:\./|/|~/)\S+|\S+\.sh)(?:\s|$)",)),
    "fish": Language((("function", r"^\s*function\s+(?P<name>[\w-]+)"),), (r"^\s*source\s+(?P<raw>\S+)",), body="end"),
    "qml": Language((("qml_id", rf"^\s*id\s*:\s*{_ID}"), ("property", rf"^\s*(?:readonly\s+|default\s+)*property\s+[\w<>.]+\s+{_ID}"), ("function", rf"^\s*function\s+{_ID}"), ("signal", rf"^\s*signal\s+{_ID}")), (r"^\s*import\s+[\"'](?P<raw>[^\"']+)[\"']",), uses=(r"(?<![\w.])(?P<raw>[A-Z]\w+)\.\w",)),
    "css": Language((), (r"@import\s+(?:url\()?['\"](?P<raw>[^'\"]+)['\"]",), resources=(("color", r"^\s*(?P<name>--[\w-]+)\s*:\s*(?P<value>[^;]+);"),)),
    "scss": Language((), (r"@(?:import|use|forward)\s+['\"](?P<raw>[^'\"]+)['\"]",), resources=(("color", r"^\s*(?P<name>\$[\w-]+|--[\w-]+)\s*:\s*(?P<value>[^;]+);"),)),
    "markdown": Language((("heading", r"^(?P<level>#{1,6})\s+(?P<name>.+?)\s*#*\s*$"),), body="line"),
    "json": Language((("setting", r"^\s*\"(?P<name>[^\"]+)\"\s*:\s*(?P<value>.*)$"),), body="line"),
    "yaml": Language((("setting", r"^\s*-?\s*(?P<name>[\w./-]+)\s*:\s*(?P<value>.*)$"),), body="line"),
    "toml": Language((("config_section", r"^\s*\[+(?P<name>[^\]]+)\]+"), ("setting", r"^\s*(?P<name>[\w.\"-]+)\s*=\s*(?P<value>.*)$")), body="line"),
    "ini": Language((("config_section", r"^\s*\[(?P<name>[^\]]+)\]"), ("setting", r"^\s*(?P<name>[\w./ -]+?)\s*[=:]\s*(?P<value>.*)$")), body="line"),
    "hyprlang": Language((("config_section", r"^\s*(?P<name>[\w:-]+)\s*\{\s*$"), ("keybind", r"^\s*bind\w*\s*=\s*(?P<name>[^,]*,[^,]*)"), ("setting", r"^\s*(?P<name>[\w.-]+)\s*=\s*(?P<value>.*)$")), (r"^\s*source\s*=\s*(?P<raw>\S+)",), (r"^\s*exec(?:-once)?\s*=\s*(?P<raw>.+)$", r"^\s*bind\w*\s*=.*?,\s*exec\s*,\s*(?P<raw>.+)$"), resources=(("var", r"^\s*(?P<name>\$\w+)\s*=\s*(?P<value>.+)$"),), body="line"),
    "plist": Language((("setting", r"<key>(?P<name>[^<]+)</key>"),), body="line"),
    "pbxproj": Language((("target", r"/\*\s*(?P<name>[^*]+?)\s*\*/\s*=\s*\{\s*$"), ("setting", r"^\s*(?P<name>[A-Z][A-Z0-9_]+)\s*=\s*(?P<value>[^;]+);")), body="line"),
    "xcconfig": Language((("setting", r"^\s*(?P<name>[A-Za-z_]\w*(?:\[[^\]]*\])?)\s*=\s*(?P<value>.*)$"),), (r"^\s*#include\??\s+\"(?P<raw>[^\"]+)\"",), body="line"),
}
LANGUAGES["rust"] = Language(LANGUAGES["rust"].symbols, (*LANGUAGES["rust"].includes, r"^\s*(?:pub\s+)?mod\s+(?P<raw>\w+)\s*;"))


def _patterns(lang: str) -> dict[str, list]:
    made = LANGUAGES[lang].compiled
    if not made:
        g = LANGUAGES[lang]
        made.update(
            symbols=[(k, re.compile(p)) for k, p in g.symbols], includes=[re.compile(p) for p in g.includes], execs=[re.compile(p) for p in g.execs],
            uses=[re.compile(p) for p in g.uses], resources=[(k, re.compile(p)) for k, p in g.resources], decisions=re.compile(g.decisions),
        )
    return made


_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`\n]*`|//.*")


def body_end(lines: list[str], at: int, body: str) -> int:
    """The line (from 0) on which the body that begins on line `at` ends."""
    indent = len(lines[at]) - len(lines[at].lstrip())
    if body == "line":
        return at
    if body == "indent":
        last = at
        for i in range(at + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                    break
                last = i
        return last
    if body == "end":
        for i in range(at, len(lines)):
            if re.match(r"\s*end\b", lines[i]) and len(lines[i]) - len(lines[i].lstrip()) <= indent:
                return i
        return at
    depth, open_ = 0, False
    for i in range(at, len(lines)):
        bare = _LITERAL.sub("", lines[i])
        depth += bare.count("{") - bare.count("}")
        open_ = open_ or "{" in bare
        if open_ and depth <= 0:
            return i
        if not open_ and (bare.rstrip().endswith(";") or i - at > 8):
            return at if i - at > 8 else i
    return len(lines) - 1 if open_ else at


def signature_of(line: str) -> str:
    """A declaration up to its body, comments off, blanks folded, 200 characters at most."""
    text = re.sub(r"/\*.*?\*/|//.*$", "", line).strip()
    text = re.sub(r"\s+", " ", re.sub(r"\s*(?:\{.*|=>.*|:)$", "", text)).strip()
    return text if len(text) <= 200 else text[:200] + " ..."


def doc_above(lines: list[str], at: int) -> str:
    """The comment lines directly above line `at` (from 0), 15 at most."""
    first = at
    while first > 0 and at - first < MOST_DOC_LINES and lines[first - 1].strip().startswith(COMMENT_MARKS):
        first -= 1
    return "\n".join(lines[first:at])


def doc_sentence(doc: str) -> str:
    """The first sentence of a comment without its marks."""
    words = []
    for line in doc.split("\n"):
        bare = re.sub(r"^(?:///|//|/\*+|\*+/|#|\"\"\"|'''|\*)+\s?", "", line.strip())
        bare = re.sub(r"(?:\"\"\"|'''|\*/)$", "", bare).strip()
        if not bare:
            if words:
                break
            continue
        words.append(bare)
        if bare.endswith("."):
            break
    text = " ".join(words)
    return text[: text.index(". ") + 1] if ". " in text else text


def color_like(value: str) -> bool:
    return value.strip().lower().startswith(("#", "rgb", "0x"))


def resource_kind(value: str) -> str:
    """color, path or var, by what a value looks like."""
    bare = value.strip()
    return "color" if color_like(bare) else "path" if bare.startswith(("~", "./", "../")) or "/" in bare else "var"


def extract(text: str, lang: str) -> dict[str, list[dict]]:
    """The symbols, edges and resources of a text, lines from 1."""
    out: dict[str, list[dict]] = {"symbols": [], "edges": [], "resources": []}
    if lang not in LANGUAGES or not text:
        return out
    g, made = LANGUAGES[lang], _patterns(lang)
    lines = text.replace("\r\n", "\n").split("\n")
    used: set[str] = set()
    for i, line in enumerate(lines):
        for kind in ("includes", "execs"):
            for p in made[kind]:
                m = p.search(line)
                if m:
                    raw = m["raw"].strip()
                    raw = f"mod::{raw}" if lang == "rust" and line.lstrip().removeprefix("pub ").startswith("mod ") else raw
                    out["edges"].append({"kind": kind, "raw": raw, "line": i + 1})
                    break
        for kind, p in made["resources"]:
            m = p.search(line)
            if m:
                value = m.groupdict().get("value")
                kind = kind if value is None else resource_kind(value)
                if lang in ("css", "scss") and kind != "color":
                    continue
                out["resources"].append({"kind": kind, "name": m["name"], "value": value and value.strip(), "line": i + 1})
                if value is not None:
                    out["edges"].append({"kind": "declares_resource", "raw": m["name"], "line": i + 1})
        for kind, p in made["symbols"]:
            m = p.search(line)
            if m:
                last = body_end(lines, i, g.body)
                groups = m.groupdict()
                signature = f"h{len(groups['level'])}" if groups.get("level") else signature_of(line) if g.body != "line" else (groups.get("value") or "").strip()
                code = kind in ("function", "method")
                inner = "\n".join(lines[i : last + 1]) if code else ""
                out["symbols"].append({
                    "name": m["name"].strip(), "kind": kind, "signature": signature, "start_line": i + 1, "end_line": last + 1,
                    "complexity": 1 + len(made["decisions"].findall(inner)) if code else 0, "doc": doc_above(lines, i) if g.body != "line" else "",
                })
                break
        for p in made["uses"]:
            for m in p.finditer(line):
                if m["raw"] not in used:
                    used.add(m["raw"])
                    out["edges"].append({"kind": "uses", "raw": m["raw"], "line": i + 1})
        if lang in ("css", "scss"):
            for m in re.finditer(r"var\(\s*(--[\w-]+)", line):
                out["edges"].append({"kind": "uses_resource", "raw": m[1], "line": i + 1})
    return out


def spans_to_chunks(n_lines: int, spans: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """First and last lines (from 1) of the chunks of a text: definitions up to twice the window stay whole, small parts are packed.

    Overlapping definitions count as one; larger ones and what lies between are cut
    into windows; neighbours are packed while they fit a window.
    """
    merged: list[list[int]] = []
    for a, b in sorted((max(1, a), min(n_lines, max(a, b))) for a, b in spans if a <= n_lines):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    parts: list[tuple[int, int]] = []

    def cut(a: int, b: int) -> None:
        parts.extend((s, min(s + window - 1, b)) for s in range(a, b + 1, window))

    at = 1
    for a, b in merged:
        cut(at, a - 1)
        if b - a + 1 <= 2 * window:
            parts.append((a, b))
        else:
            cut(a, b)
        at = b + 1
    cut(at, n_lines)
    out: list[tuple[int, int]] = []
    for a, b in parts:
        if out and b - out[-1][0] + 1 <= window:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def chunk_text(text: str, spans: list[tuple[int, int]], window: int = WINDOW) -> list[dict]:
    """The chunks of a text that aren't blank."""
    lines = text.split("\n")
    made = [(a, b, "\n".join(lines[a - 1 : b])) for a, b in spans_to_chunks(len(lines), spans, window)]
    return [{"start_line": a, "end_line": b, "text": t} for a, b, t in made if t.strip()]


_NESTED = (
    "symbols array<struct<name:string,kind:string,signature:string,start_line:int,end_line:int,complexity:int,doc:string>>, "
    "edges array<struct<kind:string,raw:string,line:int>>, resources array<struct<kind:string,name:string,value:string,line:int>>, chunks array<struct<start_line:int,end_line:int,text:string>>"
)
_ARROW = [
    pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("signature", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("complexity", pa.int32()), ("doc", pa.string())])),
    pa.list_(pa.struct([("kind", pa.string()), ("raw", pa.string()), ("line", pa.int32())])),
    pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("line", pa.int32())])),
    pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())])),
]


@dataclass
class Stretch:
    """Lines of a file that follow on each other, with the number and the chunk of each."""

    lang: str | None
    lines: list[str] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)


def in_file_order(chunks: DataFrame, langs: DataFrame) -> DataFrame:
    """chunk_id, file_id, start_line, text and lang of the chunks, those of a file in one partition and in order."""
    picked = chunks.select("chunk_id", "file_id", F.col("start_line").cast("int").alias("start_line"), F.col("text").cast("string").alias("text"))
    rows = picked.join(langs.select("file_id", F.col("lang").cast("string").alias("lang")), "file_id").select("chunk_id", "file_id", "start_line", "text", "lang")
    # not by file_id itself: the shuffle would fold into that of the join, whose partitions may be split where they are skewed
    return rows.repartition(F.hash("file_id")).sortWithinPartitions("file_id", "start_line", "chunk_id")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """The stretches of the files in the batches of in_file_order, one at a time.

    Chunks leave out blank stretches, so one blank line stands for a gap. A repeated
    chunk counts once; one without start_line, or that begins within the chunk
    before it, stands alone.
    """
    at, last, expected, made = None, None, None, Stretch(None)
    for batch in batches:
        for chunk, file, start, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text is None or (file, chunk) == (at, last):
                continue
            lines = text.replace("\r\n", "\n").split("\n")
            if len(lines) > 1 and not lines[-1]:
                lines.pop()
            if file != at or start is None or expected is None or start < expected:
                if made.lines:
                    yield made
                made = Stretch(lang)
            elif start > expected:
                made.lines.append("")
                made.numbers.append(expected)
                made.chunks.append(last)
            begin = 1 if start is None else start
            made.lines += lines
            made.numbers += range(begin, begin + len(lines))
            made.chunks += [chunk] * len(lines)
            at, last, expected = file, chunk, None if start is None else begin + len(lines)
    if made.lines:
        yield made


def extracted(texts: DataFrame, key: str = "file_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """key, symbols, edges, resources and chunks of every text; an unknown language gives chunks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for language, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = extract(body or "", language or "")
                spans = [(s["start_line"], s["end_line"]) for s in found["symbols"]]
                for column, value in zip(columns, (found["symbols"], found["edges"], found["resources"], chunk_text(body or "", spans)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True))], names=[key, "symbols", "edges", "resources", "chunks"])

    picked = texts.select(key, F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, {_NESTED}")


def symbols_of_files(chunks: DataFrame, langs: DataFrame) -> DataFrame:
    """chunk_id, name, kind, start_line, end_line and complexity of the symbols of files read whole, with the chunk and the lines of the file they stand in."""
    rows = in_file_order(chunks, langs.where(F.col("lang").isin(*LANGUAGES)))
    names = ["chunk_id", "name", "kind", "start_line", "end_line", "complexity"]
    kinds = [to_arrow_type(rows.schema["chunk_id"].dataType), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*told, strict=True) if told else [[] for _ in kinds]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            told.clear()
            return made

        for part in stretches(batches):
            for x in extract("\n".join(part.lines), part.lang)["symbols"]:
                first, last = x["start_line"] - 1, x["end_line"] - 1
                told.append((part.chunks[first], x["name"], x["kind"], part.numbers[first], part.numbers[last], x["complexity"]))
            if len(told) >= 4096:
                yield batch()
        yield batch()

    return rows.mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, name string, kind string, start_line int, end_line int, complexity int")


def table_of(rows: DataFrame, what: str, key: str = "file_id") -> DataFrame:
    """One of the nested tables as rows."""
    return rows.select(key, F.posexplode(what).alias("ordinal", "row")).select(key, "ordinal", "row.*")


def windows(texts: DataFrame, key: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The chunks of texts without definitions: windows of lines, blank ones left out. A plan, without Python."""
    lines = F.split(F.col(text), "\n", -1)
    cut = texts.where(F.col(text).isNotNull()).select(key, lines.alias("lines")).select(key, "lines", F.explode(F.sequence(F.lit(1), F.size("lines"), F.lit(window))).alias("start_line"))
    body = F.array_join(F.slice("lines", F.col("start_line"), F.lit(window)), "\n")
    rows = cut.select(key, "start_line", F.least(F.col("start_line") + window - 1, F.size("lines")).alias("end_line"), body.alias("text"))
    return rows.where(~F.col("text").rlike(r"\A\s*\z"))


def generic_lines(texts: DataFrame, key: str, start_line: str = "start_line", text: str = "text") -> DataFrame:
    """key, line, what and name of the lines of simple configuration files: include, exec, bind, variable, setting, in this order."""
    rows = texts.select(key, F.col(start_line).alias("base"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "raw"))
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    rows = rows.select(key, (F.coalesce("base", F.lit(1)) + F.col("at")).alias("line"), line.alias("l")).where((F.col("l") != "") & ~F.col("l").rlike("^(#|//|;)"))
    at = F.col("l")
    what = (
        F.when(at.rlike("^(include|source)[ =]") | at.startswith("@import"), "includes")
        .when(at.rlike("^exec([_-](always|once))? "), "execs")
        .when(at.rlike("^(bindsym |bindcode |bind |bind=)"), "binds")
        .when(at.rlike(r"^set\s+\$\S+ +\S") | at.rlike(r"^\$[^=]*="), "variable")
        .when(at.rlike(r"^[^=\s{}]+\s*=") & ~at.rlike(r"^[^=]*[\s{}][^=\s]*\s*="), "setting")
        .when(~at.contains("=") & at.rlike(r"^[^:\s{}]+\s*:"), "setting")
    )
    name = (
        F.when(F.col("what") == "includes", F.regexp_replace(at, r"^(include|source|@import)[ =]?\s*", ""))
        .when(F.col("what") == "execs", F.regexp_replace(at, r"^exec([_-](always|once))? \s*(--no-startup-id )?", ""))
        .when(F.col("what") == "binds", F.regexp_replace(at, "^(bindsym |bindcode |bind |bind=)", ""))
        .when(F.col("what") == "variable", F.regexp_extract(at, r"(\$[^\s=]+)", 1))
        .otherwise(F.regexp_extract(at, r"^([^=:\s]+)", 1))
    )
    return rows.withColumn("what", what).where("what is not null").select(key, "line", "what", F.trim(name).alias("name"))


def sentences(rows: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """key and sentence, the first of the first paragraph, of every row with a doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array([doc_sentence(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), told], names=[key, "sentence"])

    picked = rows.where(F.col(doc).isNotNull()).select(key, F.col(doc).cast("string").alias("doc"))
    return picked.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, sentence string")
