"""The parts that the SQL of many queries shares: the tables with each row once, and path classes."""

from siftwood.functions import paths as P


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


DEPS = _list(P.DEPENDENCY_KINDS)

BASE = """
f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC, size DESC, hash DESC) = 1),
s AS (SELECT DISTINCT * FROM symbols), e AS (SELECT DISTINCT * FROM edges), c AS (SELECT DISTINCT * FROM chunks), r AS (SELECT DISTINCT * FROM resources)
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    """A query over f, s, e, c and r, and over the further named parts in more."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{', ' + more if more else ''} {body}"


def base(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)$', 1)"


def folder(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def depth(path: str) -> str:
    return f"(length({path}) - length(replace({path}, '/', '')))"


def segment(path: str, names) -> str:
    return f"list_has_any(string_split({path}, '/'), [{', '.join(repr(n) for n in names)}])"


def ends(path: str, endings) -> str:
    return "(" + " OR ".join(f"ends_with({path}, '{e}')" for e in endings) + ")"


def vendored(path: str) -> str:
    return f"({segment(path, P.VENDOR_DIRS)} OR {ends(path, P.VENDOR_ENDINGS)})"


def test(path: str) -> str:
    marks = " OR ".join(f"contains({base(path)}, '{m}')" for m in P.TEST_MARKS)
    return f"({marks} OR starts_with({base(path)}, 'test_') OR {segment(path, P.TEST_DIRS)})"


def doc(path: str) -> str:
    return f"({ends(f'lower({path})', P.DOC_ENDINGS)} OR {segment(path, P.DOC_DIRS)})"


def tier(path: str) -> str:
    return f"CASE WHEN {vendored(path)} THEN 3 WHEN {doc(path)} THEN 2 WHEN {test(path)} THEN 1 ELSE 0 END"


def subsystem(path: str) -> str:
    d, parts = depth(path), f"string_split({path}, '/')"
    return f"CASE {d} WHEN 0 THEN '.' WHEN 1 THEN {parts}[1] ELSE {parts}[1] || '/' || {parts}[2] END"
