"""Personal information in free text: finding it, and typed placeholders in its place.

Mail addresses, phone numbers, identity numbers and street addresses have forms of
their own. Names have not: that two capitalised words are a person is told by the
corpus. Every term that occurs in the shape of a name is counted over all
documents, altogether and where it reveals a protected entity: next to a mail
address, in one, behind a title, or where a person signs, reviews, reports or is
asked. From these co-occurrences comes its disclosure, the information in bits
that the term gives about a person being meant. Terms above the threshold are
names; a run of them is a name that is found and replaced.

The counts are summed within a batch before they are shuffled, each distinct run
of terms is judged once, and the documents take the verdict from it.

Defined results: null, empty and blank texts hold nothing; a value that stands in a
text several times gives one row; a document given twice gives its rows once; a
null doc_id keeps its rows under null, and is cleaned like any other; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.session import materialize

#: Share of a term's occurrences in the shape of a name that must reveal a person, at least.
SHARE = 0.3
#: Characters between a word that announces a phone number and the number, at most, and letters of such a word.
CUE_REACH, CUE_WORD = 24, 32
#: Words before a name among which its cue is looked for; no cue has more.
CUE_WORDS = 6
#: Bits of information about a person from which a term counts as a name.
DISCLOSURE = 1.0

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# ---- fixed values: words and forms of four languages ----
EN_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Ter|Close|Crescent|Cres|Row|Walk|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Trail|Mews|Gardens|Grove|Hill"
DE_STREETS = "straße|strasse|str\\.|gasse|weg|platz|allee|ring|ufer|damm|steig|chaussee|pfad|markt|hof"
FR_STREETS = "rue|avenue|av\\.|chemin|boulevard|bd|place|impasse|allée|quai|route|cours|square|passage|sentier|faubourg|rond-point|villa|cité|montée"
ES_STREETS = "C/|Calle|Cl\\.|Plaza|Pza\\.|Pl\\.|Avda\\.|Av\\.|Avenida|Paseo|P\\.º|Pº|Camino|Ronda|Carretera|Ctra\\.|Travesía|Glorieta|Rambla|Vía|Callejón|Cuesta"
ID_WORDS = (
    r"passport|passeport|reisepass(?:nummer)?|pasaporte|ssn|social security|sozialversicherungsnummer|svnr|sv-nummer|rentenversicherungsnummer|id card|identity card|personalausweis(?:nummer)?|ausweis(?:nummer|nr)?|"
    r"carte d['’]identité|cni|tax id(?:entification)?|tin|itin|steuer-?id(?:entifikationsnummer)?(?:nr)?|steueridentifikationsnummer|steuernummer|idnr|id-nr|nir|numéro de sécurité sociale|sécurité sociale|"
    r"numéro fiscal|spi|d\.?n\.?i|n\.?i\.?f|n\.?i\.?e|seguridad social|nuss|national insurance|nino|driver['’]?s licen[sc]e"
)
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Hr|Fr|Sr|Sra|Srta|Don|Doña|D|M|Mme|Mlle|MM|Monsieur|Madame|Señor|Señora|Maître|Me|Dipl\\.-Ing|Ing"
SUFFIXES = "Jr|Sr|II|III|IV|PhD|MD|Esq"
REVEALING = (
    r"[A-Za-z-]+-by|authors?|assignees?|owner|maintainers?|reporter|reviewer|contact|cc|from|to|verantwortlich|zuständig|responsable|autor|auteur|ansprechpartner(?:in)?|kontakt|contacto"
)
REVEALING_VERBS = (
    r"ask|asked|by|with|thanks to|thank you|thanks,?|hi|hello|dear|hey|hallo|liebe[r]?|bonjour|hola|querid[oa]|cher|chère|why did|as|this is|par|selon|d['’]après|merci à|por|según|gracias a|von|laut|danke an|dank an|hat|notó|frag(?:e|t)?|grüße von|call"
)
# ---- end of fixed values ----

_WORD = r"[^\W\d_]"
_UP = "A-ZÀ-ÖØ-ÞŁŚŽŠČĆŐŰİ"
_LOW = "a-zß-öø-ÿłśžščćőűıœ"
_TOKEN = rf"(?!(?:{SUFFIXES})\b)(?:(?:[dDoOlL]|Mc|Mac|Fitz|[A-Z])['’])?(?:Mc|Mac|De|Di|Le|La)?[{_UP}](?:[{_UP}]+|[{_LOW}]+)(?:(?:-|['’](?=[{_UP}]))(?:[dDoO]['’])?(?:Mc|Mac)?[{_UP}](?:[{_UP}]+|[{_LOW}]+))*"
_INITIAL = rf"[{_UP}]\.(?:-?[{_UP}]\.)?"
_PARTICLE = r"(?:de la|de los|del|de|von der|von|van der|van den|van|di|da|dos|le|la|zu)"
_PART = rf"(?:{_TOKEN}|{_INITIAL})"
#: A stretch of terms that stand together as the parts of a name do.
_RUN = re.compile(
    rf"(?<![\w@/\\.+`$'’-])(?P<run>{_PART}(?:,?[ \t ]+(?:{_PARTICLE}[ \t]+)?{_PART}(?![\w@/\\+$(]|\.\w)){{1,4}}(?:,?[ \t]+(?:{SUFFIXES})\b\.?)?)"
)
_PIECE = re.compile(rf"(?P<suffix>(?:{SUFFIXES})\b\.?)|(?P<initial>{_INITIAL}(?![{_LOW}]))|(?P<token>{_TOKEN})")
_CUE = re.compile(
    rf"(?:(?:^|[\s\"'@({{,*>-])(?i:{REVEALING})[\"']?[ \t]*[:=][ \t]*[\"'(]?|(?:^|[\s@(>,;\"'])(?i:{REVEALING_VERBS})[ \t]+(?:(?:{TITLES})\.?[ \t]+)?|(?:^|[\s(])(?:{TITLES})\.?[ \t]+)\Z"
)
_LAST_WORDS = frozenset(w.strip("?.,\\ ").lower() for part in (REVEALING_VERBS + "|" + TITLES).replace("(?:in)?", "").replace("(?:e|t)?", "|frage|fragt").replace("[r]", "r").replace("[oa]", "o|querida").replace("['’]", "'").split("|") for w in [part.split(" ")[-1]]) | {"lieber", "d'après", "thanks"}
_MAIL_AFTER = re.compile(r"(?:['’]s)?[ \t]*[<(\[]{1,2}(?:mailto:)?[\w.+%'’-]+(?:@|[ \t]*[\[({]?(?:at|AT|At)[\])}]?[ \t])")

_BRACKETED = re.compile(r"[\[({][ \t]?[aA][tT][ \t]?[\])}][ \t]?")
_SPELLED = re.compile(r"[\w-]+(?:\.[\w-]+)*(?:[ \t]?[\[({]|[ \t](?i:dot)[ \t])")
_LOCAL = re.compile(r"[\w.+%'’-]")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:(?:\.|[ \t]?[\[({][ \t]?(?:\.|(?i:dot|punkt|point|punto))[ \t]?[\])}][ \t]?|[ \t](?:dot|DOT|Dot)[ \t])[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_HIDDEN_DOT = re.compile(r"[\[({]|[ \t](?i:dot)[ \t]")

_DIGITS = re.compile(r"(?<![\w.,:/#=&?%@~\\-])(?:(?<=\d)|)(?P<n>(?:\(?\+\d{1,3}\)?|\(0?\d{2,5}\)|\d)[\d().\-/  ]{5,24}\d)(?P<x>[ \t]*(?:,[ \t]*)?(?:x|ext\.?|extension|Durchwahl|DW|poste|anexo)[ \t]*\d{1,6})?(?![\w%]|[.,:/-]\d|-\w)")
_EQUAL_DIGITS = re.compile(r"(?<=[=:])(?P<n>(?:\(?\+\d{1,3}\)?|\(0?\d{2,5}\)|\d)[\d().\-/  ]{5,24}\d)(?P<x>[ \t]*(?:x|ext\.?)[ \t]*\d{1,6})?(?![\w%]|[.,:/-]\d|-\w)")
_PHONE = [
    re.compile(r"(?:\(\+\d{1,3}\)|\+\d{1,3}|00[1-9]\d)(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(?\d{1,12}\)?){1,6}"),
    re.compile(r"(?:1[-. ]?)?(?:\([2-9]\d{2}\)[ -]?|[2-9]\d{2}[-. ])\d{3}[-. ]\d{4}"),
    re.compile(r"\(?0[1-9]\d{0,3}\)?(?:[ .\-/]\d{2,8}){1,4}"),
    re.compile(r"0[1-9]\d{8,9}"),
    re.compile(r"[6-9]\d{2}(?:[ .-]\d{2,3}){2,3}|[6-9]\d{8}"),
]
_PHONE_CUE = re.compile(
    r"(?i)(?:\b(?:tel|tél|tfno|tlf|phone|fone|fon|mobile?|móvil|cell|fax|call|pager|text|sms|whatsapp|portable|ruf\w*|anruf\w*|telefon\w*|téléphone|teléfono|handy|joignable|llám\w*|number is|numéro|número|notfall|ring|dial|reach me|hotline)\b[^\n]{0,%d})\Z" % CUE_REACH
)
_NO_PHONE = re.compile(r"(?i)(?:\b(?:build|ticket|checksum|section|row|rows|version|commit|hash|issue|order|invoice|line|lines|page|id|number|serial|batch|trace|case|isbn|issn|port|step|revision|rev|chapter|fila|zeile|ligne|línea)\b[ #:.=n°o]{0,4})\Z")
_ID_CUE = re.compile(rf"(?i)(?<!\w)(?:{ID_WORDS})\b\.?")
_ID_GAP = re.compile(r"(?i)[\s\"'’]*(?:(?:number|no\.?|nr\.?|nummer|numéro|número|n[°ºo]\.?|card|#|is|was|ist|war|est|es|lautet|de sécurité sociale)[\s\"'’]*){0,3}[:=(\[]{0,2}[\s\"'’(]*")
_ID_VALUE = re.compile(
    r"(?:\d{3}[- .]\d{2}[- .]\d{4}|[XYZ][- ]?\d{7}[- ]?[A-Z]|\d{8}[- ]?[A-Z]|\d{2}\.\d{3}\.\d{3}[- ]?[A-Z]|[12][ .]?\d{2}[ .]?\d{2}[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}(?:[ .]?\d{2})?"
    r"|\d{2}[ .]\d{3}[ .]\d{3}[ .]\d{3}|\d{2}[ ]?\d{6}[ ]?[A-Z][ ]?\d{3}|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]|[A-Z]{1,3}[- ]?\d{6,9}[A-Z]?|[A-Z0-9]*\d[A-Z0-9]{6,12}|\d{9,13})(?![\w-]\w|\w)"
)
_TOWN = rf"[{_UP}][\w'’]*(?:[ -](?:sur|sous|lès|les|le|la|en|de|del|am|an der|bei|im|upon|on|[{_UP}][\w'’]*))*?(?:[ -][{_UP}][\w'’]*)?"
_NAMED = rf"[{_UP}][\w'’-]*"
_SEP = r"(?:[ \t ]*,[ \t ]*\r?\n?[ \t ]*|[ \t ]*\r?\n[ \t ]*|[ \t ]+)"
_FLAT = rf"(?:,?[ \t]+(?:(?:Apt|Apartment|Unit|Suite|Ste|Flat|Fl|Floor|Room|Rm)\.?[ \t]*#?[ \t]*\w{{1,5}}|#[ \t]*\w{{1,5}}))?"
_ADDRESS = [
    re.compile(
        rf"(?<![\w./-])\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?[ \t]+(?:{_NAMED}[ \t]+){{1,4}}?(?:{EN_STREETS})\b\.?{_FLAT}{_SEP}{_NAMED}(?:[ -](?:{_NAMED}|on|upon|in|the)){{0,3}}?"
        r"(?:(?:[ \t]*,[ \t]*|[ \t]+|[ \t]*,?\r?\n[ \t]*)(?:[A-Z]{2}[ \t]+)?(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]?[ \t]*\d[A-Z]{2}))(?![\w-]\w|\w)"
    ),
    re.compile(
        rf"(?<![\w./-])(?:[{_UP}][\w-]*(?:{DE_STREETS})|(?:(?:Am|An der|Im|In der|Zum|Zur|Auf der|Unter den|Alte[rn]?|Neue[rn]?)[ \t]+)?[{_UP}][\w-]*(?:[ \t][{_UP}][\w-]*)?[ \t-](?:Straße|Str\.|Gasse|Weg|Platz|Allee|Ring))[ \t]+\d{{1,4}}[ \t]?[a-z]?(?![\w])"
        rf"{_SEP}(?:D[- ])?\d{{5}}[ \t]+{_NAMED}(?:[ -](?:{_NAMED}|am|an der|bei|im|ob der|in|vor der)){{0,3}}"
    ),
    re.compile(
        rf"(?<![\w./-])\d{{1,4}}(?:[ \t]?(?:bis|ter|quater|[A-D]))?,?[ \t]+(?i:{FR_STREETS})\b[ \t]+(?:[\w'’-]+[ \t]*){{1,6}}?{_SEP}(?:F-)?\d{{5}}[ \t]+{_NAMED}(?:[ -](?:{_NAMED}|sur|sous|lès|les|le|la|en|de|des|du)){{0,5}}"
    ),
    re.compile(
        rf"(?<![\w./-])(?:{ES_STREETS})[ \t]*(?:(?:de la|de los|de las|del|de)[ \t]+)?{_NAMED}(?:[ \t](?:{_NAMED}|de|del|la|los|las|y))*,?[ \t]*(?:n\.?[º°][ \t]*)?\d{{1,4}}[ \t]?[A-Za-z]?(?![\w])"
        rf"(?:,[ \t]*(?:bajo|ático|\d{{1,2}}\.?[ºª°o]\.?[ \t]*(?:[A-Z]|izq\.?|dcha\.?|\d)?|[A-Z]|esc\.?[ \t]*\w+|piso[ \t]*\w+|puerta[ \t]*\w+))*{_SEP}(?:E-)?\d{{5}}[ \t]+{_NAMED}(?:[ \t](?:{_NAMED}|de|del|la|los|las|el)){{0,4}}"
    ),
]
_POSTCODE = re.compile(r"\d{5}(?![\w.]\w|\w)|[A-Z]\d{1,2}[A-Z]?[ \t]\d[A-Z]{2}\b")
_SIX = re.compile(r"\d(?:[ .-]?\d){5}")
_NINE = re.compile(r"\d(?:[ .\-()/ ]{0,3}\d){8}")
_SPACES = re.compile(r"\s+")
_POSSESSIVE = re.compile(r"['’][sS]\Z")


def squeezed(value: str) -> str:
    """value with each run of white space as one space."""
    return _SPACES.sub(" ", value).strip()


def fold(token: str) -> str:
    """A term as it is counted: without accents, case and possessive."""
    token = _POSSESSIVE.sub("", token)
    plain = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    return plain.lower().replace("’", "'").replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("œ", "oe")


def _places(text: str, what: str) -> Iterator[int]:
    """Where a fixed string stands in a text."""
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def _word_start(text: str, place: int) -> int:
    """Where the stretch without white space begins that ends at place."""
    return max(text.rfind(c, 0, place) for c in " \t\n\r") + 1


def _line_start(text: str, place: int, lines: int = 0) -> int:
    """Where the line of place begins, or a line so many above it."""
    for _ in range(lines):
        place = max(0, text.rfind("\n", 0, place))
    return text.rfind("\n", 0, place) + 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The spans of mail addresses, also of such written out in words."""
    signs = [(i, i + 1) for i in _places(text, "@")]
    signs += [(m.start() - (text[m.start() - 1 : m.start()] in (" ", "\t")), m.end()) for m in _BRACKETED.finditer(text)]
    for word in (" at ", " AT ", " At "):
        signs += [(i, i + 4) for i in _places(text, word) if _SPELLED.match(text, i + 4)]
    done = 0
    for begin, end in sorted(signs):
        right = _HOST.match(text, end)
        if not right:
            continue
        low = begin
        while low > done and _LOCAL.match(text[low - 1]):
            low -= 1
        if low == begin:
            continue
        local, sign, host = text[low:begin], text[begin:end].strip(), right[0]
        start = low + len(local) - len(local.lstrip(".-'’%+"))
        stop = right.end()
        plain = sign == "@"
        if start >= begin or text[start - 1 : start] in ("@", "/", ":") and text[max(0, start - 7) : start].lower() != "mailto:" and "//" in text[_word_start(text, start) : start]:
            continue
        if text[start:begin].lower() in ("git", "hg", "svn", "ssh", "cvs") or text[stop : stop + 1] in (":", "/") and re.match(r":[\w./-]|/\w", text[stop : stop + 2]) and plain:
            continue
        parts = re.split(r"[ \t]*[\[({]?[ \t]*(?:\.|(?i:dot|punkt|point|punto))[ \t]*[\])}]?[ \t]*", host)
        if not re.fullmatch(r"[A-Za-z][A-Za-z-]{1,}", parts[-1]):
            continue
        if sign.lower() == "at" and not _HIDDEN_DOT.search(host):
            continue
        done = stop
        yield start, stop


def phones(text: str) -> Iterator[tuple[int, int]]:
    """The spans of phone numbers with their prefixes and extensions."""
    done = 0
    for near in _NINE.finditer(text):
        low, high = max(done, near.start() - 10), min(len(text), near.end() + 40)
        for m in chain(_DIGITS.finditer(text, low, high), _EQUAL_DIGITS.finditer(text, low, high)):
            if m.start("n") >= near.end() or m.start("n") < done:
                continue
            number = m["n"]
            start = m.start("n")
            digits = sum(c.isdigit() for c in number)
            if not 9 <= digits <= 15 or "  " in number:
                continue
            before = text[max(_line_start(text, start), start - CUE_REACH - CUE_WORD) : start]
            if _NO_PHONE.search(before):
                continue
            cued = _PHONE_CUE.search(before) is not None
            for i, form in enumerate(_PHONE):
                if not form.fullmatch(number):
                    continue
                kinds = {c for c in number if c in ".-/"}
                if i >= 3 and not cued or i == 2 and (len(kinds) > 1 or digits > 12 or "/" in kinds and not cued):
                    continue
                if i == 2 and not cued and re.fullmatch(r"0\d[.-]\d\d[.-]\d{4}|\d{1,2}\.\d{1,2}\.\d{1,3}\.\d{1,3}", number):
                    continue
                if number.count("(") != number.count(")"):
                    continue
                done = m.end("x") if m["x"] else m.end("n")
                yield start, done
                break


def id_numbers(text: str) -> Iterator[tuple[int, int]]:
    """The spans of identity numbers, which a word for such a number announces."""
    done, line, stop, ends = -1, 0, -1, []
    for hit in _SIX.finditer(text):
        if hit.start() >= stop:  # a new line: where the words for such numbers end in it
            line, stop = _line_start(text, hit.start()), text.find("\n", hit.start())
            stop = len(text) if stop < 0 else stop
            ends = [m.end() for m in _ID_CUE.finditer(text, line, stop)]
        at = bisect.bisect_right(ends, hit.start()) - 1
        if at < 0:
            continue
        gap = _ID_GAP.match(text, ends[at])
        value = _ID_VALUE.match(text, gap.end() if gap else ends[at])
        if value and value.start() <= hit.start() < value.end() and value.start() > done and sum(c.isdigit() for c in value[0]) >= 6:
            done = value.end()
            yield value.span()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """The spans of street addresses, from street or house number to town or postcode: looked for around postcodes."""
    windows: list[tuple[int, int]] = []
    for m in _POSTCODE.finditer(text):
        if m.start() and (text[m.start() - 1].isdigit() or text[m.start() - 1] in "./_"):
            continue
        # an address has three lines at most, so two above the postcode and one below
        low, high = _line_start(text, m.start(), 2), text.find("\n", text.find("\n", m.end()) + 1 or len(text))
        high = len(text) if high < 0 else high
        if windows and low <= windows[-1][1]:
            windows[-1] = (windows[-1][0], high)
        else:
            windows.append((low, high))
    for low, high in windows:
        for pattern in _ADDRESS:
            for m in pattern.finditer(text, low, high):
                yield m.span()


def runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """Where a run of name-like terms begins, and the run, outside of the spans taken, which are in order."""
    place = 0
    while True:
        m = _RUN.search(text, place)
        if not m:
            return
        start, stop = m.span()
        at = bisect.bisect_left(taken, (stop, stop))
        while at and taken[at - 1][1] > start:
            at -= 1
        if at < len(taken) and taken[at][0] < stop:
            place = max(start + 1, taken[at][1])
            continue
        place = stop
        yield start, m["run"]


def _before(text: str, place: int) -> str:
    """The last words of the line before place, as many as a cue may have."""
    low = place
    for _ in range(CUE_WORDS):
        low = max(0, text.rfind(" ", 0, low))
    return text[low:place].rpartition("\n")[2]


def cued(text: str, start: int, stop: int) -> bool:
    """Whether what stands before start or behind stop reveals that a person is named."""
    if _MAIL_AFTER.match(text, stop):
        return True
    before = _before(text, start)
    last = before.rstrip(" \t\"'(")
    if not last or not (last[-1] in ":=" or last.rpartition(" ")[2].strip("(@,;.>\"").lower() in _LAST_WORDS):
        return False
    return _CUE.search(before) is not None


def pieces(run: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the terms, initials and suffixes of a run; a possessive is left out."""
    out = []
    for m in _PIECE.finditer(run):
        kind = m.lastgroup
        end = m.end() - (2 if kind == "token" and _POSSESSIVE.search(m[0]) else 0)
        out.append((kind, m.start(), end))
    return out


def observe(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]], Counter[tuple[str, bool]]]:
    """(kind, start, end) of the values of a text, the spans of its runs, and the counts of its terms: (term, whether a person is revealed)."""
    values: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    terms: Counter[tuple[str, bool]] = Counter()
    digits = re.search(r"\d", text) is not None
    for kind, finder in (("email", emails), ("id_number", id_numbers if digits else None), ("address", addresses if digits else None), ("phone", phones if digits else None)):
        if finder is None:
            continue
        for a, b in finder(text):
            at = bisect.bisect_left(taken, (b, b))
            if at and taken[at - 1][1] > a:
                continue
            values.append((kind, a, b))
            taken.insert(at, (a, b))
            if kind == "email":
                for part in re.split(r"[^A-Za-z'’-]+", re.split(r"[@\s\[({]", text[a:b])[0]):
                    if len(part) > 3:
                        terms[(fold(part), True)] += 1
    found: list[tuple[int, int]] = []
    for start, run in runs(text, taken):
        parts = pieces(run)
        # the words before a name may be capitalised too, so each term may be the first of it
        lead = 0
        hit = cued(text, start, start + len(run))
        if not hit:
            for i, (kind, a, _b) in enumerate(parts[1:], 1):
                if kind in ("token", "initial") and _CUE.search(_before(text, start + a)):
                    hit, lead = True, i
                    break
        # the first two terms behind the cue, one after an initial; what follows may be the next sentence
        left = 1 if parts[lead : lead + 1] and parts[lead][0] == "initial" else 2
        for i, (kind, a, b) in enumerate(parts):
            if kind == "token":
                said = hit and i >= lead and left > 0
                left -= said
                terms[(fold(run[a:b]), said)] += 1
        found.append((start, start + len(run)))
    return values, found, terms


def is_name(term: str, names: set[str]) -> bool:
    """Whether a term, or each part of a double one, is a name."""
    return term in names or "-" in term and all(part in names for part in term.split("-"))


def judged(run: str, names: set[str]) -> list[tuple[int, int, str]]:
    """The names in a run, given which of its terms are names: first and last of its pieces, and the name."""
    parts = pieces(run)
    marks = "".join({"suffix": "s", "initial": "i"}.get(k, "n" if is_name(fold(run[a:b]), names) else "x") for k, a, b in parts)
    out = []
    for m in re.finditer(r"i{0,2}n(?:i{0,2}n){0,3}i?s?", marks):
        if m[0].count("n") < 2 and "i" not in m[0]:
            continue
        a, b = m.span()
        if run[parts[a][1] : parts[a][2]] == "M." and (m[0].count("n") > 1 or m[0].startswith("ii")):
            a += 1  # a title before a full name, no initial
        if m[0].endswith("i") and m[0].count("n") >= 1 and m[0].count("i") == 1 and m[0].count("n") > 1 and "," not in run[parts[a][1] : parts[b - 1][2]]:
            b -= 1
        out.append((a, b - 1, squeezed(run[parts[a][1] : parts[b - 1][2]])))
    return out


_COUNTS = "term string, n bigint, m bigint"
_SPAN = "kind string, start int, stop int, found string"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("found", pa.string())]))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scanned(documents: DataFrame, digests: bool = False) -> DataFrame:
    """Per document its spans (kind, start, stop, found; kind 'run' for runs of terms), and per batch the counts of terms.

    A span tells its value with white space squeezed. With digests a document is
    known by the digest of its text, so that copies and rows without an id have
    their spans too; else by doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digest, spans = [], [], []
            counts: Counter[str] = Counter()
            marked: Counter[str] = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or text.isspace():
                    continue
                values, some, terms = observe(text)
                told = [(k, a, b, squeezed(text[a:b])) for k, a, b in values] + [("run", a, b, squeezed(text[a:b])) for a, b in some]
                if not digests:
                    told = list({(k, found): (k, a, b, found) for k, a, b, found in told}.values())
                if told:
                    ids.append(doc), digest.append(_digest(text) if digests else None)
                    spans.append([dict(zip(("kind", "start", "stop", "found"), x, strict=True)) for x in told])
                for (term, hit), n in terms.items():
                    counts[term] += n
                    if hit:
                        marked[term] += n
            none, d = [None] * len(counts), len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + none, pa.int64()), pa.array(digest + none, pa.binary()), pa.array(spans + none, _SPANS),
                    pa.array([None] * d + list(counts), pa.string()), pa.array([None] * d + list(counts.values()), pa.int64()), pa.array([None] * d + [marked[t] for t in counts], pa.int64()),
                ],
                names=["doc_id", "digest", "spans", "term", "n", "m"],
            )

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id bigint, digest binary, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ',')}>>, {_COUNTS}")


def lexicon(rows: DataFrame, *, share: float = SHARE, bits: float = DISCLOSURE) -> DataFrame:
    """term, n, m and bits of the terms that disclose a person, from the counts over all documents.

    The disclosure of a term is the information in bits that it gives about a person
    being meant: the logarithm of its share of revealing occurrences over that of
    the corpus. Where nearly every term reveals one, no term can be far above the
    corpus, so the bits asked for are at most those of a share of one half.
    """
    terms = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    whole = rows.where("term is not null").agg((F.sum("m") / F.sum("n")).alias("base")).first()
    base = max(float(whole.base or 0), 1e-9)  # one number for the corpus
    asked = min(bits, log2(max(0.5 / base, 1e-9)))
    scored = terms.withColumn("bits", F.log2(F.greatest(F.col("m") / F.col("n"), F.lit(1e-9)) / F.lit(base)))
    return scored.where((F.col("m") / F.col("n") >= share) & (F.col("bits") >= asked)).select("term", "n", "m", "bits")


def verdicts(rows: DataFrame) -> DataFrame:
    """run, first, last and name of every name in a run of terms, each distinct run judged once."""
    names = lexicon(rows)
    asked = rows.where("spans is not null").select(F.explode("spans").alias("s")).where("s.kind = 'run'").select(F.col("s.found").alias("run")).distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, terms = [], []
            for text in batch.column(0).to_pylist():
                whole = {fold(text[a:b]) for kind, a, b in pieces(text) if kind == "token"}
                for term in whole | {part for term in whole for part in term.split("-")}:
                    texts.append(text), terms.append(term)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(terms, pa.string())], names=["run", "term"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name in judged(text, set(terms)):
                    for column, value in zip(out, (text, *name), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["run", "first", "last", "name"])

    known = asked.mapInArrow(split, "run string, term string").join(names.select("term"), "term")
    return known.groupBy("run").agg(F.collect_set("term").alias("terms")).mapInArrow(judge, "run string, first int, last int, name string")


def found(documents: DataFrame) -> DataFrame:
    """doc_id, kind and found of every distinct value of personal information in a document."""
    rows = materialize(scanned(documents), "pii")
    told = rows.where("spans is not null").select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.found")
    named = told.where("kind = 'run'").select("doc_id", F.col("found").alias("run")).join(verdicts(rows), "run").select("doc_id", F.lit("name").alias("kind"), F.col("name").alias("found"))
    return told.where("kind <> 'run'").unionByName(named).distinct()


def sanitized(documents: DataFrame) -> DataFrame:
    """doc_id, text, n_replaced and spans: every value found replaced by the placeholder of its type, the rest as it is.

    What is found is replaced where it stands, by its offsets, and spans tells the
    offsets in characters of the text as it was. Spans meet their documents by the
    digest of the text, so a row without doc_id is cleaned like any other and
    copies are worked out once. One row per row of documents; a null text stays null.
    """
    rows = materialize(scanned(documents, digests=True), "pii")
    # copies of a text have the same spans: one of each, folded before the shuffle
    once = rows.where("spans is not null").groupBy("digest").agg(F.first("spans").alias("spans"))
    told = materialize(once.select("digest", F.posexplode("spans").alias("pos", "s")).select("digest", "s.*"), "spans")
    plain = told.where("kind <> 'run'").select("digest", "kind", "start", "stop", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    named = told.where("kind = 'run'").join(verdicts(rows), F.col("found") == F.col("run")).select("digest", F.lit("name").alias("kind"), "start", "stop", "first", "last")
    values = plain.unionByName(named).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "first", "last"))).alias("values"))
    digest = F.pandas_udf(_digests, "binary")
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.withColumn("digest", digest("text")).join(values, "digest", "left").select("doc_id", "text", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(3)]
            for text, some in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = placed(text, some or []) if text else []
                done = masked(text, spans) if spans else text
                for column, value in zip(out, (done, len(spans), [{"kind": k, "start": a, "stop": b} for a, b, k in spans]), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "text", "n_replaced", "spans"])

    tail = T.StructType.fromDDL("text string, n_replaced int, spans array<struct<kind:string,start:int,stop:int>>")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *tail.fields]))


def _digests(texts):
    """The digest of each text of a series; none for a null."""
    return texts.map(lambda t: None if t is None else _digest(t))


def placed(text: str, values: list[dict]) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the values in order, none over another; of two that overlap the earlier one, then the longer."""
    out: list[tuple[int, int, str]] = []
    for v in values:
        a, b = v["start"], v["stop"]
        if v["first"] is not None:
            parts = pieces(text[a:b])
            a, b = a + parts[v["first"]][1], a + parts[v["last"]][2]
        out.append((a, b, v["kind"]))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for span in out:
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
    return kept


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with the spans, which are in order, replaced by the placeholders of their kinds."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])
