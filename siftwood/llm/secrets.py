"""Credentials in source text: finding them, and masking them in place.

A value is a credential by two kinds of evidence together. One is how it is
written: under the vocabulary of a public tokenizer, words and identifiers take
few tokens for their characters, while random strings fall into many short ones,
so the characters per subword tell unnatural strings from natural ones. The
other is where it stands: assigned to a name that ends in a word for a secret, in
a call that logs in, in an address between user and host, in an authorization
header, after the word password, behind the prefix of a known service, or between
the marks of a private key.

Both are always asked for. How unnatural a value must be depends on where it stands:
`NATURAL` gives the characters per subword below which it counts, the lower the less
the place says by itself. Which of the two is looked at first changes no result, and
words are cheaper to find than subwords, so places are looked for first.

Placeholders, references to where a secret is kept, digests, ids, public keys,
certificates and masked values are none.

A literal may go on over several lines, and a key over several chunks of a file.
What is left open at the end of a chunk is passed on to the chunk that begins on
the next line: a few flags per chunk are put in order, never texts.

Masks keep the offsets of all that stands around a value, and its line breaks: a value
becomes `[redacted]` filled up with `*` to its own length, or stars alone where it is
shorter than that. `spans` gives the places, the same in the text before and after.

Defined results: null, empty and blank texts hold nothing; repeated rows of a
chunk give their result once; a null start_line counts as 1; a chunk without
file_id takes nothing over from another; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.llm import tokenization

MASK = "[redacted]"
#: Characters per subword below which a string counts as unnatural: by itself, where prose or a
#: scheme announces it, and where it is the literal of a name for a secret.
NATURAL, NATURAL_SAID, NATURAL_NAMED = 2.6, 3.3, 4.25
#: Shortest value that can be a credential.
SHORTEST = 6

# ---- fixed values: prefixes of services, words for secrets and for placeholders ----
PROVIDERS = (
    r"sk-[A-Za-z0-9_-]{24,}",
    r"AKIA[A-Z0-9]{16}",
    r"ASIA[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{30,}",
    r"glpat-[A-Za-z0-9_-]{18,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"xox[abeprs]-[A-Za-z0-9-]{20,}",
    r"AIza[A-Za-z0-9_-]{30,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_-]{40,}",
    r"dop_v1_[a-f0-9]{60,}",
    r"[rs]k_(?:live|test)_[A-Za-z0-9]{20,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"whsec_[A-Za-z0-9]{24,}",
    r"shp(?:at|ss|ca)_[a-fA-F0-9]{32}",
)
LAST_WORDS = frozenset(
    "pass passwd password passphrase passcode pwd secret token apikey accesskey authtoken secretkey credential credentials authkey signingkey".split()
)
KEY_BEFORE = frozenset("api access secret signing private auth encryption account master service deploy license".split())
PLACEHOLDERS = frozenset(
    "password passwd pass secret token changeme change-me change_me example sample test testing dummy none null nil true false "
    "undefined todo tbd fixme placeholder default empty string redacted masked hidden removed user username admin root guest "
    "your-password your-token your-key yourpassword mypassword hunter2 foo bar foobar qwerty letmein".split()
)
# ---- end of fixed values ----

_PROVIDER = re.compile(r"(?<![A-Za-z0-9_/+-])(?:" + "|".join(PROVIDERS) + r")(?![A-Za-z0-9_])")
_PREFIX = r"sk-[A-Za-z0-9_-]{4}|AKIA[A-Z0-9]|ASIA[A-Z0-9]|gh[pousr]_|github_pat_|glpat-|npm_|xox[abeprs]-|AIza|eyJ|hf_|pypi-|dop_v1_|[rs]k_(?:live|test)_|SG\.|whsec_|shp(?:at|ss|ca)_"
_TRIGGER = re.compile(
    r"(?i:pass(?!\s*$|ed\b|es\b|ing\b)|pwd|secret|token|key[_\-\d]*[\"'`]?\]?\s*[:=]|set_?api_?key\s*\(|api key\b|setauth|auth[a-z]*\s*[\"(:=]|bearer\s|\blogin\b|credential|basic\s|\bcurl\b)"
    r"|://[^\s/:@\"'`]*:[^\s/@]+@|PRIVATE KEY-----|(?<![A-Za-z0-9])(?:" + _PREFIX + r")",
    re.M,
)
_ASSIGN = re.compile(
    r"(?<![\w.])(?P<name>[A-Za-z_][\w.\-]{0,120})[\"'`]?\]?(?:\s*:\s*[&*]?(?:'static\s+)?[A-Za-z][\w<>\[\]:]*\??\s*=\s*(?=[rbuf]{0,2}[\"'`])|\s*(?::=|=>|=(?!=)|:(?![:=]))|\s+:=?)\s*(?P<open>[rbuf]{0,2}(?=[\"'`]))?"
)
_PIECE = "(?:\"(?:\\\\.|[^\"\\\\\\n])*\"|'(?:\\\\.|[^'\\\\\\n])*'|`(?:\\\\.|[^`\\\\\\n])*`)"
_CHAIN = re.compile(_PIECE + r"(?P<more>(?:[ \t]*(?:\+|\.\.|\.|\\|_)?[ \t]*\\?(?:\r?\n[ \t]*)?(?:\+|\.\.|\.)?[ \t]*" + _PIECE + r")*)")
_INNER = re.compile(r"[\"'`]((?:\\.|[^\\\n\"'`])*)[\"'`]")
_GOES_ON = re.compile(r"[\"'`][ \t]*(?:(?:\+|\.\.|\.|\\)[ \t]*)\\?\s*\Z")
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]|&]+")
_CALL = re.compile(r"(?i)(?:set_?(?:auth|basic_?auth|password|pass|passwd|pwd|token|secret|credentials?|api_?key)|\blogin|authenticate|basic_?auth|with_?(?:token|password|credentials?))\s*\((?P<args>[^()\n]*)\)")
_HEADER = re.compile(r"(?i)\b(?:bearer|basic)\s+(?P<v>[A-Za-z0-9_\-+/.~]{8,}=*)")
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]*://(?P<u>[^\s:/@\"'`<>]*):(?P<v>[^\s/@\"'`]+)@(?=[\w.\-\[])")
_CURL = re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[^\s:\"']*:(?P<v>[^\s\"']+)")
_PROSE = re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd|api key|token|secret)(?:\s{1,8}(?:is|was|of|to|now))?\s{0,8}[:=]?\s{1,8}[`\"']?(?P<v>[^\s`\"'(),]{6,})")
_LOGIN = re.compile(r"(?i)\b(?:login|user|account|credentials?)\s+(?:for\s+)?\S+\s*[/:|]\s*(?P<v>\S{6,})")
_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"(?:\\n|\\r|[\s\"'`+,.;:#*/\\>|-])*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*(?:\\n|\s)+)*[\"'`+#*/\s]*(?P<b>[A-Za-z0-9+/=]{16,})")
_KEY_LINE = re.compile(r"[\s\"'`#*/;>+-]*[A-Za-z0-9+/]{8,}={0,2}(?:\\n)?[\s\"'`+,.;\\)\]]*\Z")
_LAST_LINE = re.compile(r"[\s\"'`#*/;>+-]*[A-Za-z0-9+/]+={0,2}(?:\\n)?[\s\"'`+,.;\\)\]]*\Z")
_CHECKSUM = re.compile(r"[\s\"'`#*/;>+-]*=[A-Za-z0-9+/]{4}(?:\\n)?[\s\"'`+,.;\\)\]]*\Z")
_LITERAL_LINE = re.compile(r"[ \t]*(?:(?:\+|\.\.|\.)[ \t]*)?(?P<q>[\"'`])(?P<v>[^\s\"'`]{2,})(?P=q)")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DIGEST_BEFORE = re.compile(r"(?i)(?:sha\d*|md5|digest|fingerprint|checksum|integrity|hash)\W{0,4}\Z")


@lru_cache(maxsize=200_000)
def chars_per_subword(value: str) -> float:
    """Characters of value per token of the public vocabulary."""
    ids = tokenization.tokenizer(tokenization.vocabulary_path()).encode(value, add_special_tokens=False).ids
    return len(value) / max(1, len(ids))


def placeholder(value: str) -> bool:
    """Whether value only stands for a credential, or says where one is kept."""
    low = value.strip().lower()
    if not low or low in PLACEHOLDERS or MASK in low:
        return True
    if len(set(low)) <= 2 or re.fullmatch(r"[x*.•#_\-\s]+", low):
        return True
    if re.match(r"[<\[{%$(]|\\\$|env[:.]|vault[:/]|secrets?[./:]|ssm:|arn:|file:|os\.|process\.", low):
        return True
    if re.search(r"\$\{|\{\{|<[a-z _-]+>|\bexample\b|example$|your[-_ ]|[-_]here\b|changeme|placeholder|x{6,}|\.\.\.|getenv|environ", low):
        return True
    return False


def classes(value: str) -> int:
    """How many of lower case, upper case, digits and other marks value holds."""
    return sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def secret_value(value: str, strict: bool = False) -> bool:
    """Whether value is written like a credential; strict where only the value itself can tell."""
    if len(value) < SHORTEST or re.search(r"\s", value) or placeholder(value):
        return False
    if re.fullmatch(r"[\w.\-]*\([^)]*\)?;?", value) or re.match(r"(?:https?|file)://", value) or re.match(r"\.{0,2}/[\w.\-/]*\Z", value):
        return False
    per = chars_per_subword(value)
    if per >= (NATURAL_SAID if strict else NATURAL_NAMED):
        return False
    mixed = bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"[0-9]", value))
    if strict:
        return (mixed or per < NATURAL) and (per < NATURAL and classes(value) >= 2 or classes(value) >= 3)
    return mixed or per < NATURAL and classes(value) >= 2 or classes(value) >= 3


def secret_name(name: str) -> bool:
    """Whether name is one under which a secret is kept, judged by its last words."""
    words = [w.lower() for w in _CAMEL.findall(name.rpartition(".")[2])]
    if not words:
        return False
    last = words[-1] if not words[-1].isdigit() or len(words) == 1 else words[-2]
    if last in LAST_WORDS or last.endswith(("password", "passwd", "apikey")):
        return not (len(words) > 1 and words[-2] in ("public", "next", "no", "old_public"))
    return last == "key" and len(words) > 1 and words[-2] in KEY_BEFORE


@dataclass
class Found:
    """What one chunk holds: spans of values, and what it leaves open or may take over."""

    spans: list[tuple[int, int]] = field(default_factory=list)  # each from the first to behind the last character
    starts: list[int] = field(default_factory=list)  # where credentials begin
    opens: str = ""  # 'key' or 'text': the last credential goes on in the next chunk
    opens_if: bool = False  # 'key' counts only if the next chunk begins with a line of a key
    begin_at: int = -1
    takes: str = ""  # 'key', 'through', 'text': what this chunk can take over; 'through' passes it on
    taken: list[tuple[int, int]] = field(default_factory=list)


def _literal_spans(text: str, at: int) -> tuple[str, list[tuple[int, int]], int] | None:
    """The value of the literal at `at`, with the spans of its pieces and its end."""
    m = _CHAIN.match(text, at)
    if not m:
        return None
    stop = m.start("more")
    value, spans = text[at + 1 : stop - 1], [(at + 1, stop - 1)]
    for p in re.finditer(_PIECE, m["more"]):
        a, b = stop + p.start() + 1, stop + p.end() - 1
        value += text[a:b]
        spans.append((a, b))
    return value, spans, m.end()


def _key_blocks(text: str, found: Found) -> None:
    """Private keys that begin in the text, and what is left open or taken over."""
    ends = [m for m in _END.finditer(text)]
    used = 0
    for m in _BEGIN.finditer(text):
        if m.start() < used:
            continue
        end = next((e for e in ends if e.start() >= m.end()), None)
        nxt = _BEGIN.search(text, m.end())
        if end and nxt and nxt.start() < end.start():
            end = None
        body = _BODY.match(text, m.end())
        if body:
            stop = end.end() if end else None
            if stop is None:
                stop = _body_end(text, m.end())
                if stop >= len(text.rstrip()):
                    found.opens, found.begin_at = "key", m.start()
            found.starts.append(m.start())
            found.spans.append((m.start(), stop))
            used = stop
        elif not text[m.end() :].strip(" \t\r\n\"'`\\") and not end:
            found.opens, found.opens_if, found.begin_at = "key", True, m.start()
            found.taken.append((m.start(), len(text.rstrip("\r\n"))))
    first_end = ends[0] if ends else None
    before = _BEGIN.search(text)
    if first_end and not (before and before.start() < first_end.start()):
        lines = text[: first_end.start()].split("\n")
        if _key_tail(lines[:-1]) and re.fullmatch(r"[\s\"'`#*/;>+-]*", lines[-1]):
            found.takes, found.taken = "key", [(0, first_end.end())]
    elif not before and not first_end:
        lines = [x.rstrip("\r") for x in text.split("\n") if x.strip()]
        # a short last line may also be a piece of another literal
        if lines and (all(_KEY_LINE.match(x) for x in lines) or _key_tail(lines) and not _LITERAL_LINE.match(text)):
            found.takes, found.taken = "through", [(0, len(text.rstrip("\r\n")))]


def _key_tail(lines: list[str]) -> bool:
    """Whether lines can be the last of a key: whole lines, a last one of any length and the checksum of a PGP key."""
    lines = [x.rstrip("\r") for x in lines if x.strip()]
    if lines and _CHECKSUM.match(lines[-1]):
        lines.pop()
    return all(_KEY_LINE.match(x) for x in lines[:-1]) and (not lines or _LAST_LINE.match(lines[-1]) is not None)


def _body_end(text: str, at: int) -> int:
    """Where the key lines that follow `at` end."""
    stop = text.find("\n", at)
    if stop < 0:
        return len(text)
    place = stop + 1
    while place < len(text):
        stop = text.find("\n", place)
        stop = len(text) if stop < 0 else stop
        if not _KEY_LINE.match(text[place:stop].rstrip("\r")):
            return len(text) if _key_tail(text[place : place + 512].split("\n")) and len(text) - place <= 512 else place - 1
        place = stop + 1
    return len(text)


def scan(text: str) -> Found:
    """The credentials of one chunk of text."""
    found = Found()
    first = text.partition("\n")[0].rstrip("\r")
    if "PRIVATE KEY" in text or _KEY_LINE.match(first) or _LAST_LINE.match(first) or _CHECKSUM.match(first):
        _key_blocks(text, found)
    hits: list[list[tuple[int, int]]] = []
    place = 0
    while True:
        m = _TRIGGER.search(text, place)
        if not m:
            break
        begin = text.rfind("\n", 0, m.start()) + 1
        stop = text.find("\n", m.end())
        stop = len(text) if stop < 0 else stop
        hits += _line(text, begin, stop)
        place = stop
    keys = [s for s in found.spans]
    seen: set[int] = set()
    for spans in sorted(hits, key=lambda s: (s[0][0], -(s[-1][1]))):
        a, b = spans[0][0], spans[-1][1]
        if any(k <= a < e for k, e in keys) or any(p in seen for p in range(a, min(b, a + 4))):
            continue
        seen.update(range(a, b))
        found.spans += spans
        found.starts.append(a)
        if _GOES_ON.match(text, spans[-1][1]):
            found.opens = "text"
    if not found.takes:
        m = _LITERAL_LINE.match(text)
        if m:
            found.takes, found.taken = "text", [m.span("v")]
            if _GOES_ON.match(text, m.end("v")):
                found.takes = "text through"
    return found


def _line(text: str, begin: int, stop: int) -> list[list[tuple[int, int]]]:
    """The spans of the credentials that begin on the line [begin, stop)."""
    out: list[list[tuple[int, int]]] = []
    line = text[begin:stop]
    for m in _URL.finditer(line):
        v = m["v"]
        if len(v) >= 4 and not placeholder(v) and (secret_value(v) or re.search(r"\d", v) and chars_per_subword(v) < NATURAL_NAMED):
            out.append([(begin + m.start("v"), begin + m.end("v"))])
    for m in _ASSIGN.finditer(line):
        name, at = m["name"], begin + m.end()
        named = secret_name(name)
        literal = _literal_spans(text, at) if at < stop else None
        if literal:
            value, spans, _ = literal
            if named and secret_value(value) and "://" not in value:
                out.append(spans)
            elif _PROVIDER.fullmatch(value) and _provider(value):
                out.append(spans)
        elif named and at < stop:
            bare = _BARE.match(text, at, stop)
            if bare:
                value = bare[0].rstrip(".,;")
                rest = text[bare.end() : stop]
                plain = re.fullmatch(r"[A-Za-z_][\w.]*", value) is not None
                if secret_value(value, strict=True) and not rest.startswith(("(", "[", "{")) and (not plain or chars_per_subword(value) < NATURAL or line[m.end() - 1] == "="):
                    out.append([(bare.start(), bare.start() + len(value))])
    for m in _CALL.finditer(line):
        literals = list(_INNER.finditer(m["args"]))
        if literals:
            v = literals[-1]
            if secret_value(v[1]):
                a = begin + m.start("args") + v.start(1)
                out.append([(a, a + len(v[1]))])
    for pattern, strict in ((_HEADER, True), (_CURL, False), (_PROSE, True), (_LOGIN, True)):
        for m in pattern.finditer(line):
            v = m["v"].rstrip(".,;:")
            if pattern is _LOGIN and not re.search(r"(?i)pass|pwd|secret|token|credential", line):
                continue
            if secret_value(v, strict) and not re.match(r"[\w.]+\(", v):
                out.append([(begin + m.start("v"), begin + m.start("v") + len(v))])
    for m in _PROVIDER.finditer(line):
        if _provider(m[0]) and not _DIGEST_BEFORE.search(line[: m.start()]):
            out.append([(begin + m.start(), begin + m.end())])
    # a literal in two pieces, the first with the prefix of a service
    for m in _INNER.finditer(line):
        if re.match(_PREFIX, m[1]):
            literal = _literal_spans(text, begin + m.start())
            if literal and len(literal[1]) > 1 and _PROVIDER.fullmatch(literal[0]) and _provider(literal[0]):
                out.append(literal[1])
    return out


def _provider(value: str) -> bool:
    """Whether a string with the prefix of a service is a key and no word built like one."""
    if placeholder(value):
        return False
    body = value[3:] if value.startswith("sk-") else value
    if value.startswith("sk-") and len(body) < 40 and "-" in body:
        return False
    return chars_per_subword(value) < NATURAL and bool(re.search(r"\d", value) or re.search(r"[A-Z]", value[4:]))


def mask(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """text with the spans masked, each in its own length, and the spans that were; line breaks within a span stay."""
    out, place, done = [], 0, []
    for a, b in sorted(spans):
        if a < place or a >= b:
            continue
        first = re.match(r"[^\r\n]*", text[a:b]).end()
        whole = MASK if first >= len(MASK) else ""
        out += [text[place:a], whole, re.sub(r"[^\r\n]", "*", text[a + len(whole) : b])]
        place = b
        done.append((a, b))
    return "".join([*out, text[place:]]), done


_FLAGS = (
    "chunk_id bigint, file_id bigint, start_line int, lines array<int>, spans array<struct<a:int,b:int>>, "
    "n_lines int, opens string, opens_if boolean, open_line int, takes string, taken array<struct<a:int,b:int>>"
)
_SPAN = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def scanned(chunks: DataFrame) -> DataFrame:
    """Per chunk with anything in it: the lines and spans of its credentials and what it leaves open or may take over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cols = [], [[] for _ in range(9)]
            first = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(3).to_pylist()):
                if not text:
                    continue
                f = scan(text)
                if not (f.starts or f.opens or f.takes):
                    continue
                base = first[i] or 1
                line = lambda p, t=text, b=base: b + t.count("\n", 0, p)
                keep.append(i)
                row = (
                    base, sorted({line(p) for p in f.starts}), [{"a": a, "b": b} for a, b in f.spans],
                    text.count("\n") + (not text.endswith("\n")), f.opens or None, f.opens_if,
                    line(f.begin_at) if f.opens_if else None, f.takes or None, [{"a": a, "b": b} for a, b in f.taken],
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            at = pa.array(keep, pa.int64())
            types = [pa.int32(), pa.list_(pa.int32()), _SPAN, pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), _SPAN]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=[c.split()[0] for c in "chunk_id, file_id, start_line, lines, spans, n_lines, opens, opens_if, open_line, takes, taken".split(", ")],
            )

    picked = chunks.select("chunk_id", "file_id", F.col("start_line").cast("int").alias("start_line"), "text")
    return picked.mapInArrow(run, _FLAGS)


def linked(flags: DataFrame) -> DataFrame:
    """The flags with what each chunk really takes over from the chunk before it (`got`) and whether its open mark counts (`sure`).

    Only chunks that leave something open or could take it over are put in order.
    """
    loose = flags.where("(opens is not null or takes is not null) and file_id is not null").select(
        "chunk_id", "file_id", "start_line", "n_lines", "opens", "opens_if", "takes"
    ).dropDuplicates(["chunk_id"])
    order = Window.partitionBy("file_id").orderBy("start_line", "chunk_id")
    behind = F.col("start_line") + F.col("n_lines")
    chained = loose.select(
        "*", (F.lag(behind).over(order) == F.col("start_line")).alias("joined"),
    ).withColumn("joined", F.coalesce("joined", F.lit(False)))
    # a stretch ends where a chunk doesn't follow on, or can't pass on what it got
    kind = F.when(F.col("opens").isNotNull(), F.col("opens"))
    passes = F.coalesce(F.col("takes").isin("through", "text through"), F.lit(False)) & F.col("opens").isNull()
    chained = chained.withColumn("passes", passes)
    source = F.when(~F.col("passes"), F.coalesce(kind, F.lit("none")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    chained = chained.withColumn("stretch", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("file_id", "stretch").orderBy("start_line", "chunk_id")
    del before
    chained = chained.withColumn("from", F.last(source, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    fits = ((F.col("from") == "key") & F.col("takes").isin("key", "through")) | ((F.col("from") == "text") & F.col("takes").isin("text", "text through"))
    chained = chained.withColumn("got", F.coalesce(F.col("joined") & fits, F.lit(False)))
    sure = F.coalesce(~F.col("opens_if") | F.lead("got").over(order), F.lit(False))
    return chained.select("chunk_id", "got", sure.alias("sure"))


def found(chunks: DataFrame) -> DataFrame:
    """chunk_id and line of every credential, and of every chunk into which one runs."""
    from siftwood.session import materialize

    flags = materialize(scanned(chunks), "secrets")
    link = linked(flags)
    told = flags.join(link, "chunk_id", "left")
    lines = F.concat(
        F.coalesce("lines", F.array().cast("array<int>")),
        F.when(F.col("got"), F.array("start_line")).otherwise(F.array().cast("array<int>")),
        F.when(F.col("opens_if") & F.coalesce("sure", F.lit(False)), F.array("open_line")).otherwise(F.array().cast("array<int>")),
    )
    return told.select("chunk_id", F.explode(lines).alias("line")).distinct()


def redact(chunks: DataFrame) -> DataFrame:
    """chunk_id, file_id, text, n_masks and spans (start, stop) of every chunk, the credentials masked; chunks without one come unchanged."""
    from siftwood.session import materialize

    flags = materialize(scanned(chunks), "secrets")
    told = flags.join(linked(flags), "chunk_id", "left").dropDuplicates(["chunk_id"])
    spans = F.concat("spans", F.when(F.coalesce(F.col("got"), F.lit(False)) | (F.col("opens_if") & F.coalesce("sure", F.lit(False))), F.col("taken")).otherwise(F.expr("slice(taken, 1, 0)")))
    todo = told.select("chunk_id", spans.alias("spans")).where(F.size("spans") > 0)
    rows = chunks.select("chunk_id", "file_id", "text").dropDuplicates(["chunk_id"]).join(todo, "chunk_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, places = [], [], []
            for text, found_spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                done, set_now = (text, []) if text is None or not found_spans else mask(text, [(s["a"], s["b"]) for s in found_spans])
                out.append(done)
                counts.append(len(set_now))
                places.append([{"start": a, "stop": b} for a, b in set_now])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(counts, pa.int32()), pa.array(places, kind)], names=["chunk_id", "file_id", "text", "n_masks", "spans"]
            )

    tail = T.StructType.fromDDL("text string, n_masks int, spans array<struct<start:int,stop:int>>")
    schema = T.StructType([rows.schema["chunk_id"], rows.schema["file_id"], *tail.fields])
    return rows.select("chunk_id", "file_id", "text", "spans").mapInArrow(run, schema)


def updated_files(files: DataFrame, redacted: DataFrame) -> DataFrame:
    """file_id and redacted, the masks of the latest row of the file plus those set now."""
    latest = files.where("file_id is not null").groupBy("file_id").agg(F.max_by("redacted", "indexed_at").alias("before"))
    now = redacted.groupBy("file_id").agg(F.sum("n_masks").alias("now"))
    return latest.join(now, "file_id", "left").select(
        "file_id", (F.coalesce("before", F.lit(0)) + F.coalesce("now", F.lit(0))).cast("int").alias("redacted")
    )
