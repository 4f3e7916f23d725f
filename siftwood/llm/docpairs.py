"""Functions paired with their documentation, by island grammars.

Two grammars are at work, both of which know only the islands and skip the rest.

`islands` reads source text. Per language it knows what documentation, an
annotation, a signature and a balanced body look like; every other line is water.
It gives each function with the documentation next to it.

A function of a table and its island in the source meet by file and line; by that the
pairs of the table are checked against the source (README), while their rows come from
the documentation grammar alone, which needs no second reading of the texts.

`statements` reads documentation. Its islands are comment marks, rules and section
marks, placeholders, directives to tools, licence lines, commented-out code,
pointers to other documentation, tags and sentences. Only sentences and the
descriptions of tags can say something, and they do if a word is left that repeats
neither the name of the function nor that of the parameter.

Defined results: a null signature, a null doc and a doc that says nothing give no
pair; a null kind is no function; a null name repeats nothing; repeated rows of a
symbol give one pair; any script counts as words; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siftwood.functions.paths import language
from siftwood.operators.extraction import in_file_order, stretches

KINDS = ("function", "method")

# ---- fixed values: words and forms that say nothing ----
FILLER = frozenset(
    "the a an this that these it its of for to in on at by with and or as is are be was been from into "
    "function functions method methods func fn routine procedure helper constructor getter setter "
    "gets sets does do returns return param parameter parameters argument arguments arg args value "
    "le la les un une des du de el los las una der die das ein eine den".split()
)
PLACEHOLDER = frozenset(
    "todo fixme xxx tbd tba hack wip na n none nothing undocumented placeholder placeholders doc docs docstring documentation document "
    "documented description descriptions describe comment comments summary add write insert put fill missing no not yet provided "
    "available here goes go follow follows later needed pending auto generated autogenerated stub me explain please coming soon empty "
    "unknown done lorem ipsum deprecated internal text some your".split()
)
DIRECTIVES = (
    r"nolint(?::[\w,\- ]+)?|noqa(?::\s*[\w, ]+)?|pylint\s*:.*|flake8\s*:.*|mypy\s*:.*|ruff\s*:.*|isort\s*:.*|yapf\s*:.*|fmt\s*:\s*\w+|type\s*:\s*ignore.*"
    r"|pragma\s*:?\s*no\s+\w+|eslint(?:-\w+)*(?:\s+[\w@/,\- ]+)?|tslint\s*:.*|jshint\s.*|jslint\s.*|prettier-ignore(?:-\w+)?|stylelint-\w+.*|@ts-\w+.*|@flow.*|istanbul ignore.*|c8 ignore.*|v8 ignore.*"
    r"|clippy::\w+|rustfmt::\w+|#?\[?allow\(.*\)\]?|go:\w+.*|\+build .*|lint:\w+.*|nosec.*|nosonar|nolint.*only|shellcheck\s+\w+=.*|clang-(?:format|tidy)\s+\w+|cppcheck-suppress.*"
    r"|noinspection .*|suppress .*|@suppress\w*.*|swiftlint:.*|rubocop:.*|phpcs:.*|phpstan-.*|psalm-.*|checkstyle\s*:.*|@formatter:\w+|ktlint-.*|coverage\s*:.*|codecov.*|spotbugs.*|sourcery .*|cspell:.*|spell-?checker:.*|vim?:.*|-\*-.*-\*-|language=\w+"
    r"|@?override|@?inherit-?doc|\{@inheritdoc\}|@(?:internal|private|protected|public|static|final|abstract|readonly|async|hidden|ignore|nodoc|api|export|constructor|virtual|generated|test)"
)
LICENCES = (
    r"spdx-.*|(?:copyright\b|\(c\)|©).{0,8}\d{4}.*|all rights reserved\W*|licensed under .*|released under .{0,40}licen[sc]e.*|@licen[sc]e.*|@copyright.*"
    r"|(?:see|cf) (?:the )?licen[sc]e\b.*|\S+: see licen[sc]e\W*|licen[sc]e\s*:.*|(?:mit|bsd|apache|gpl|mpl)\S* licen[sc]e\W*|copyright \(c\).*"
)
POINTERS = r"(?:see|cf\.?|refer to|same as|as|voir|siehe|v[ée]ase|ver|ditto|idem|like)\b(?:\s+(?:also\s+)?[^\s:,;]+){0,5}\W*|\{?@(?:link|see)\b.*|https?://\S+"
SECTIONS = r"#?\s*(?:end\s*)?region\b.*|#?pragma mark\b.*|mark\s*:.*|\{\{\{.*|\}\}\}.*|<editor-fold.*|</editor-fold.*|section\s*:.*"
TAG_WITH_NAME = "param params arg argument parameter tparam property prop typeparam field attr attribute key keyword kwarg var raises raise throws exception except typedef".split()
HEADERS = r"(?:args|arguments|parameters?|params|returns?|yields?|raises|throws|exceptions?|attributes|notes?|examples?|usage|see also|keyword args|other parameters|warnings?)\s*:?"
# ---- end of fixed values ----

_CONTROL = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f­​-‏ -‮⁠﻿]")
_OPEN = re.compile(r"\A\s*(?:/\*+!?|\"\"\"|'''|<!--|\{-\|?|--\[=*\[|=begin|/\+)")
_CLOSE = re.compile(r"(?:\*+/|\"\"\"|'''|-->|-\}|--\]=*\]|\]=*\]|\+/)\s*\Z")
_LINE_MARK = re.compile(r"\s*(?://[/!]*|#+!?(?=\s|$|[^#\w\[])|#(?=[A-Za-z@])(?!region|endregion|pragma)|--(?!-)\[*|;+|%+|\*+(?=\s|$|[^*\s/])|'(?=\s))\s?")
_RULE = re.compile(r"[\W_]*")
_TITLED = re.compile(r"(?:[-=*#~_+<>|/]{3,}\s*(?P<a>\S.{0,60}?)\s*[-=*#~_+<>|/]*|(?P<b>\S.{0,60}?)\s*[-=*#~_+<>|]{3,})")
_DIRECTIVE = re.compile("(?:" + DIRECTIVES + r")\W*", re.I)
_LICENCE = re.compile("(?:" + LICENCES + ")", re.I)
_POINTER = re.compile(r"\(?\s*(?:" + POINTERS + r")\s*\)?\W*", re.I)
_SECTION = re.compile("(?:" + SECTIONS + ")", re.I)
_HEADER = re.compile("(?:" + HEADERS + r")", re.I)
_UNDERLINE = re.compile(r"[-=~^]{3,}")
_MARKED = re.compile(r"\b(?:todo|fixme|xxx|hack|tbd)\b(?:\s*\([^)]*\))?\s*[:\-]?\s*", re.I)
_TAG = re.compile(r"[@\\](?P<tag>[A-Za-z][\w-]*)\b\s*(?P<rest>.*)", re.S)
_FIELD = re.compile(r":(?P<tag>[A-Za-z]+)(?:\s+(?P<name>[^:\n]*))?:\s*(?P<rest>.*)", re.S)
_XML = re.compile(r"<(?P<tag>/?[A-Za-z][\w.]*)(?P<attrs>[^<>]*)>")
_ENTRY = re.compile(r"(?P<name>\*{0,2}[A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*(?:[:–]|\s-\s)\s*(?P<rest>.*)", re.S)
_WORDS = re.compile(r"[^\W\d_]+|\d+", re.S)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+|\d+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n\s*\n")
_CODE = re.compile(
    r"(?:(?:return|if|for|while|else|elif|switch|case|throw|raise|await|yield|del|assert|import|from|var|let|const|auto|int|func|fn|def|class|public|private|static|echo|local|end|fi|done|then|do|print|try|catch|defer|go|match|foreach|unless|until|use|require)\b"
    r"(?=.*(?:[;{}]\s*$|\w\(.*\)|==|!=|:=|=>|->|\[\w+\]|\s[-+*/]?=\s|:\s*$|^(?:return|raise|import|end|fi|done)\s+[\w.]+$)).*"
    r"|[\w.\[\]\"'$>:*&-]+\s*(?:[-+*/|&%^]|<<|>>|\?\?)?(?::)?=(?!=)\s*\S.{0,80}|[\w.:>$-]+(?:::<\w+>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{}]?(?:\s*\{.*)?|[^.!?]*;\s*|[{}()\[\];,\s]+|(?:fi|end|done|else|endif|esac|pass|break|continue)\W*|[\w.]+(?:\+\+|--);?|<\w+[^>]*/?>.*</?\w+>)\s*",
    re.S,
)


def words_of(name: str | None) -> set[str]:
    """The words of a name, in camel case or with separators, lower case."""
    return {w.lower() for part in _WORDS.findall(name or "") for w in (_CAMEL.findall(part) or [part])} | {p.lower() for p in _WORDS.findall(name or "")}


def stem(word: str) -> str:
    """A word without the endings of an English verb or plural."""
    for ending, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if word.endswith(ending) and len(word) - len(ending) >= 2:
            word = word[: len(word) - len(ending)] + put
            break
    if len(word) > 3 and word[-1] == word[-2] and word[-1] in "bdgmnprt":
        word = word[:-1]
    return word.rstrip("e") if len(word) > 3 else word


def _forms(words: set[str]) -> set[str]:
    """Words as they stand and as stems."""
    return words | {stem(w) for w in words}


def says(sentence: str, known: set[str]) -> bool:
    """Whether a word of the sentence is left that is no filler and repeats no known one."""
    sentence = re.sub(r"`([^`]*)`", r" \1 ", sentence)
    for word in _WORDS.findall(sentence):
        if ord(max(word)) > 0x2E80:
            return True
        if word.isdigit():
            continue
        for part in _CAMEL.findall(word) or [word]:
            low = part.lower()
            if len(low) > 1 and low not in FILLER and not known & {low, stem(low), low.removesuffix("s"), low.removesuffix("es")}:
                return True
    return False


def empty_phrase(sentence: str) -> bool:
    """Whether the sentence only holds the place of documentation."""
    words = [w.lower() for w in _WORDS.findall(sentence)]
    return all(w in PLACEHOLDER or w in FILLER or len(w) < 2 for w in words) and not any(ord(max(w)) > 0x2E80 for w in words)


def lines_of(doc: str) -> list[str]:
    """The lines of a comment without its marks; indentation stays."""
    text = _CONTROL.sub("", doc.replace("\r\n", "\n").replace("\r", "\n"))
    text, block = _OPEN.subn("", text, count=1)
    if block or _CLOSE.search(text):
        text = _CLOSE.sub("", text)
    out = []
    for line in text.split("\n"):
        m = _LINE_MARK.match(line)
        if m and m.end() > m.start() and line.strip():
            rest = line[m.end() :]
            again = re.match(r"(?://[/!]*|#+|--)\s*$", rest)
            line = "" if again else rest
        line = line.rstrip()
        if line.endswith("*/"):
            line = line.rstrip("*/").rstrip() if line.strip("*/ \t") else ""
        out.append(line)
    return out


def statements(doc: str | None, name: str | None = None) -> list[str]:
    """What a doc says: its sentences and descriptions, after everything that says nothing."""
    if not doc or not doc.strip():
        return []
    known = _forms(words_of(name))
    out: list[str] = []
    prose: list[str] = []
    item: tuple[set[str], list[str]] | None = None  # words that a description may repeat, its lines
    depth, section = 0, None

    def close() -> None:
        nonlocal item, prose
        if item:
            _keep(out, " ".join(item[1]), known | item[0])
        if prose:
            _keep(out, "\n".join(prose), known)
        item, prose = None, []

    for raw in lines_of(doc):
        line, indent = raw.strip(), len(raw) - len(raw.lstrip())
        if not line or _UNDERLINE.fullmatch(line) or _RULE.fullmatch(line):
            close()
            continue
        if _DIRECTIVE.fullmatch(line) or _LICENCE.fullmatch(line) or _SECTION.fullmatch(line):
            close()
            section = None
            continue
        titled = _TITLED.fullmatch(line)
        if titled and len((titled["a"] or titled["b"] or "").split()) <= 6:
            close()
            continue
        if _XML.search(line):
            attrs = " ".join(m["attrs"] for m in _XML.finditer(line))
            plain = _XML.sub(" ", line).strip()
            if plain and "</" in line or plain and re.match(r"<\w+", line):
                close()
                _keep(out, plain, known | _forms(words_of(attrs)))
                continue
            if not plain:
                close()
                continue
        if _HEADER.fullmatch(line) and (line.endswith(":") or item is None and not prose):
            close()
            section, depth = line.rstrip(":").lower(), indent
            continue
        tag, field = _TAG.match(line), _FIELD.match(line)
        if field:
            close()
            item = (_forms(words_of(field["name"])) | {stem(field["tag"].lower())}, [field["rest"]])
            continue
        if tag:
            close()
            rest, words = tag["rest"], {stem(tag["tag"].lower())}
            rest = re.sub(r"\A\s*\{[^}]*\}", "", rest).strip()
            if tag["tag"].lower() in TAG_WITH_NAME:
                first = re.match(r"\[?([\w.$*&=]+)\]?\s*[-:–]*\s*", rest)
                if first:
                    words |= _forms(words_of(first[1]))
                    rest = rest[first.end() :]
            elif tag["tag"].lower() in ("see", "link", "author", "since", "version", "date", "file", "type", "deprecated") and len(rest.split()) <= 3:
                rest = ""
            item = (words, [rest])
            continue
        if section and indent > depth:
            entry = _ENTRY.fullmatch(line)
            if entry and not section.startswith(("return", "yield", "note", "example")):
                close()
                item = (_forms(words_of(entry["name"])), [entry["rest"]])
                continue
            if item:
                item[1].append(line)
                continue
            item = (set(), [line])
            continue
        section = None if section and indent <= depth else section
        if item and indent > 0 and not re.match(r"[A-Z].*\.$", line):
            item[1].append(line)
            continue
        if item:
            close()
        if len(line) < 200 and _CODE.fullmatch(line):
            if prose:
                close()
            continue
        prose.append(line)
    close()
    return out


def _keep(out: list[str], text: str, known: set[str]) -> None:
    """Append the sentences of text that say something."""
    for sentence in _SENTENCE.split(text):
        sentence = sentence.strip()
        if not sentence or _RULE.fullmatch(sentence) or _POINTER.fullmatch(sentence):
            continue
        bare = _MARKED.sub("", sentence).strip()
        if bare != sentence and (not bare or empty_phrase(bare)):
            continue
        if _LICENCE.fullmatch(sentence) or _DIRECTIVE.fullmatch(sentence) or empty_phrase(sentence):
            continue
        if says(bare, known):
            out.append(sentence)


def pairs(symbols: DataFrame, name: str = "name") -> DataFrame:
    """symbol_id, signature and description of every function and method whose doc says something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, keep, told = batch.to_pydict(), [], []
            for i, doc in enumerate(got["doc"]):
                found = statements(doc, got["name"][i])
                if found:
                    keep.append(i)
                    told.append("\n".join(found))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("symbol_id").take(at), batch.column("signature").take(at), pa.array(told, pa.string())],
                names=["symbol_id", "signature", "description"],
            )

    kind = F.lower(F.regexp_replace("kind", r"^\s+|\s+$", ""))
    picked = symbols.where(kind.isin(*KINDS) & F.col("signature").isNotNull() & F.col("doc").isNotNull()).select(
        "symbol_id", F.col("signature").cast("string").alias("signature"), F.col(f"`{name}`").cast("string").alias("name"), F.col("doc").cast("string").alias("doc")
    )
    schema = T.StructType([picked.schema["symbol_id"], T.StructField("signature", T.StringType()), T.StructField("description", T.StringType())])
    rows = picked.mapInArrow(run, schema)
    return rows.groupBy("symbol_id").agg(F.min(F.struct("signature", "description")).alias("row")).select("symbol_id", "row.signature", "row.description")


# ---------------------------------------------------------------- source text


@dataclass(frozen=True)
class Grammar:
    """What the islands of a language look like."""

    signature: re.Pattern[str]
    comment: str  # mark of a line comment
    block: tuple[str, str] | None = ("/*", "*/")
    annotation: re.Pattern[str] | None = None
    body: str = "braces"  # braces, indent or end


_B = r"(?P<indent>[ \t]*+)"
GRAMMARS: dict[str, Grammar] = {
    "python": Grammar(re.compile(_B + r"(?:async\s+)?def\s+(?P<name>\w+)\s*\("), "#", None, re.compile(r"[ \t]*@\w"), "indent"),
    "go": Grammar(re.compile(_B + r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), "//"),
    "rust": Grammar(re.compile(_B + r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)"), "//", ("/*", "*/"), re.compile(r"[ \t]*#\[")),
    "javascript": Grammar(re.compile(_B + r"(?:export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s*\*?\s*(?P<name>\w+)|(?:async\s+|static\s+|get\s+|set\s+)*(?P<m>(?!(?:if|for|while|switch|catch|return|function)\b)\w+)(?=\s*\([^;{}]*\)\s*\{))"), "//", ("/*", "*/"), re.compile(r"[ \t]*@\w")),
    "typescript": Grammar(re.compile(_B + r"(?:export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s*\*?\s*(?P<name>\w+)|(?:async\s+|static\s+|public\s+|private\s+|protected\s+|readonly\s+|get\s+|set\s+)*(?P<m>(?!(?:if|for|while|switch|catch|return|function)\b)\w+)(?=\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^;{}=]+)?\{))"), "//", ("/*", "*/"), re.compile(r"[ \t]*@\w")),
    "java": Grammar(re.compile(_B + r"(?!(?:return|new|else|throw)\b)(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?[\w.<>\[\],? ]+?\s+(?P<name>(?!(?:if|for|while|switch|catch)\b)\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?(?=\{)"), "//", ("/*", "*/"), re.compile(r"[ \t]*@\w")),
    "cpp": Grammar(re.compile(_B + r"(?!(?:return|new|else|throw|using|typedef)\b)(?:[\w:<>,&*~\[\] ]+?[\s&*]+)(?P<name>(?!(?:if|for|while|switch|catch)\b)[\w:~]+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?=\{)"), "//"),
    "lua": Grammar(re.compile(_B + r"(?:local\s+)?function\s+(?P<name>[\w.:]+)\s*\("), "--", None, None, "end"),
    "bash": Grammar(re.compile(_B + r"(?:function\s+)?(?P<name>[\w-]+)\s*\([^(){}]*\)\s*(?=\{)"), "#", None),
    "ruby": Grammar(re.compile(_B + r"def\s+(?P<name>[\w.?!=]+)"), "#", None, None, "end"),
}
GRAMMARS |= {"tsx": GRAMMARS["typescript"], "c": GRAMMARS["cpp"], "csharp": GRAMMARS["java"], "kotlin": Grammar(re.compile(_B + r"(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?P<name>[\w.]+)\s*\("), "//")}
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|//[^\n]*|/\*.*?\*/", re.S)


def _body_end(lines: list[str], at: int, grammar: Grammar, indent: str) -> int:
    """The last line of the balanced body of the function whose signature is on line `at`; the last line there is if it isn't closed."""
    if grammar.body == "indent":
        last = at
        for i in range(at + 1, len(lines)):
            if not lines[i].strip():
                continue
            if len(lines[i]) - len(lines[i].lstrip()) <= len(indent):
                break
            last = i
        return last
    if grammar.body == "end":
        for i in range(at + 1, len(lines)):
            if lines[i].startswith(indent) and re.match(r"end\b", lines[i][len(indent) :]):
                return i
        return len(lines) - 1
    depth, seen = 0, False
    for i in range(at, len(lines)):
        bare = _STRINGS.sub('""', lines[i])
        depth += bare.count("{") - bare.count("}")
        seen = seen or "{" in bare
        if seen and depth <= 0:
            return i
    return len(lines) - 1


def islands(text: str, lang: str) -> list[tuple[str, str, str | None, int, int]]:
    """name, signature, doc, first and last line (from 0) of every function in the text."""
    grammar = GRAMMARS.get(lang)
    if grammar is None or not text:
        return []
    lines, out = text.replace("\r\n", "\n").split("\n"), []
    for i, line in enumerate(lines):
        indent = line[: len(line) - len(line.lstrip())]
        line = indent + re.sub(r"\s+", " ", line[len(indent) :])
        m = grammar.signature.match(line)
        if not m:
            continue
        names = m.groupdict()
        name = names.get("name") or names.get("m")
        if not name:
            continue
        signature = re.sub(r"\s+", " ", re.split(r"\{\s*(?:.*)$|:\s*$" if grammar.body != "end" else r"$", line.strip())[0]).strip()
        above = i - 1
        while above >= 0 and grammar.annotation and grammar.annotation.match(lines[above]):
            above -= 1
        doc = _doc_above(lines, above, grammar)
        last = _body_end(lines, i, grammar, m["indent"])
        if lang == "python":
            inner = re.match(r"\s*(?:[rRuU]?)(\"\"\"|''')", "\n".join(lines[i + 1 : i + 2]))
            if inner:
                body = "\n".join(lines[i + 1 : last + 1])
                start = body.index(inner[1])
                stop = body.find(inner[1], start + 3)
                doc = body[start : stop + 3] if stop >= 0 else body[start:]
        out.append((name, signature, doc, i, last))
    return out


def _doc_above(lines: list[str], at: int, grammar: Grammar) -> str | None:
    """The comment that ends on line `at`, without a gap to what follows."""
    if at < 0:
        return None
    if grammar.block and lines[at].rstrip().endswith(grammar.block[1]):
        first = at
        while first >= 0 and grammar.block[0] not in lines[first]:
            first -= 1
        return "\n".join(x.strip() for x in lines[max(first, 0) : at + 1])
    first = at
    while first >= 0 and lines[first].strip().startswith(grammar.comment):
        first -= 1
    return "\n".join(x.strip() for x in lines[first + 1 : at + 1]) if first < at else None


def source_pairs(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_id, name, signature, description, start_line and end_line of the documented functions in files of known languages.

    A file is read whole, so a doc or a body may go on over its chunks; chunk_id is
    the chunk that holds the signature. A null or blank lang falls back on the path.
    """
    path = F.col("rel_path") if "rel_path" in files.columns else F.lit(None).cast("string")
    newest = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("indexed_at", path.alias("path"), "lang")).alias("row"))
    told = F.lower(F.trim(F.coalesce("row.lang", F.lit(""))))
    langs = newest.select("file_id", F.when(told != "", told).otherwise(language(F.col("row.path"))).alias("lang"))
    rows = in_file_order(chunks, langs.where(F.col("lang").isin(*GRAMMARS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["chunk_id", "name", "signature", "description", "start_line", "end_line"])
            for column in out:
                column.clear()
            return made

        for part in stretches(batches):
            for name, signature, doc, first, last in islands("\n".join(part.lines), part.lang):
                said = statements(doc, name)
                if said:
                    for column, value in zip(out, (part.chunks[first], name, signature, "\n".join(said), part.numbers[first], part.numbers[last]), strict=True):
                        column.append(value)
            if len(out[0]) >= 4096:
                yield batch()
        yield batch()

    kinds = [to_arrow_type(rows.schema["chunk_id"].dataType), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    schema = T.StructType([rows.schema["chunk_id"], *[T.StructField(c, T.StringType()) for c in ("name", "signature", "description")], T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
    return rows.mapInArrow(run, schema).dropDuplicates(["chunk_id", "name", "start_line"])
