"""Queries over small planted rows, for operators whose cases the generated tables lack, with their SQL.

The rows stand once, as Python values, and are given to both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwood.functions import text as X
from siftwood.index import Index
from siftwood.operators import health as H
from siftwood.operators import knowledge as N
from siftwood.operators import packets as C
from siftwood.operators import search as E
from siftwood.operators import stats as A
from siftwood.operators import webdocs as W
from siftwood.plans import sqltext as S
from siftwood.plans.training import _WALK
from siftwood.sinks import store as K
from siftwood.sources import tree

ITEMS = [(1, "a", 900), (2, "b", 1200), (3, "a", 800), (4, "c", 100), (5, "b", 50)]
ANSWERS = [(1, 10_000, 1_000), (2, 500, 900), (3, 7, 0)]
FINDINGS = [("c1", "error"), ("c1", "error"), ("c2", "warn"), ("c3", "info")]
CASES = [("grep", 1, 2, 1, 1, 2), ("grep", 2, 2, 0, 2, 2), ("hybrid", 2, 2, 0, 2, 2), ("hybrid", 0, 1, 0, 0, 0)]
OLD, NEW = [(1, "x"), (2, "y"), (3, "z")], [(2, "Y"), (4, "w")]
COUNTS = [("answers", 1), ("answers", 1), ("saved", 500), ("saved", 20)]
STAGED, UNSTAGED, UNTRACKED = [("a",), ("b",)], [("b",), ("c",)], [("d",)]
ON_DISK = [("go", 40), ("cobol", 12), ("zig", 3)]
CATALOGUE = [("one", "session cache", "Caches", "cache warm", "keeps a session", "rows"), ("two", "graph walk", "Walks", "reach", "walks the cache graph", "paths"), ("three", "other", "Other", "none", "nothing", "none")]
DATES = [(1, "2024-01-01", "2024-02-01"), (2, "2024-02-01", "2024-01-01"), (3, None, "2024-01-01"), (4, "never", None), (5, None, None)]
WORDS = ["verified", "HIGH", "medium", "likely", "low", "uncertain", "", "other"]
ROBOTS = "User-agent: *\nDisallow: /private\nDisallow: /admin\nAllow: /public\nAllow: /private/open\n"
PATHS = ["/private/x", "/private/open/y", "/public/page", "/admin", "/"]
KEYS = ["SUPER, Q", "q + super", "Ctrl+Shift+A", ""]
LINES = ["one\ntwo\nthree\n", "one\r\ntwo\r\nthree", "x", "zwei\none\ntwo\nthree\n"]
QUESTION = "Where is the (session) cache of the graph?"


def _df(spark, rows, schema):
    return spark.createDataFrame([tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows], schema)


def _values(rows, names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    rows = [r if isinstance(r, (tuple, list)) else (r,) for r in rows]
    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows) + f") t({names})"


def _items(s):
    return _df(s, ITEMS, "position int, rel_path string, tokens int")


def _anchors(s, d):
    import hashlib

    want = "sha256:" + hashlib.sha256(b"two\nthree").hexdigest()
    anchors = _df(s, [(i, f"f{i}", 2, 3, want) for i in range(len(LINES) + 1)], "anchor_id int, path string, first int, last int, hash string")
    return N.checked(anchors, _df(s, [(f"f{i}", t) for i, t in enumerate(LINES)], "path string, text string")).select("anchor_id", "status", "moved_to")


def _robots(s, d):
    return _df(s, PATHS, "path string").select("path", W.permitted(F.col("path"), *W.robots(ROBOTS)).alias("ok"))


def _disk(s, d):
    rows = _df(s, [(lang,) for lang, n in ON_DISK for _ in range(n)], "lang string")
    return A.unindexed_languages(rows, Index(s, d))


def _churn(s, d):
    """Commits that the edges stand in for: one for each edge of a file."""
    index = Index(s, d)
    commits = index.edges.where("kind = 'includes'").join(index.paths, "file_id").select("rel_path")
    return A.churned(commits, index)


QUERIES = {
    "a12_savings": lambda s, d: A.savings(_df(s, ANSWERS, "id int, baseline_bytes long, answer_bytes long")),
    "a15_score": lambda s, d: A.health_score(_df(s, FINDINGS, "check string, severity string")),
    "a16_churn": _churn,
    "a19_retrieval": lambda s, d: A.retrieval_metrics(_df(s, CASES, "strategy string, hits int, expected int, distractors int, present int, required int")),
    "a20_unindexed": _disk,
    "c01_terms": lambda s, d: _df(s, X.question_terms(QUESTION), "term string"),
    "c17_confidence": lambda s, d: _df(s, WORDS, "word string").select("word", C.confidence(F.col("word")).alias("value")),
    "f16_terms": lambda s, d: _df(s, list(enumerate(X.search_terms(QUESTION), 1)), "n int, term string"),
    "f24_capabilities": lambda s, d: E.capabilities(_df(s, CATALOGUE, "id string, name string, title string, triggers string, description string, outputs string"), "session cache"),
    "h07_canonical_keys": lambda s, d: _df(s, KEYS, "name string").select("name", H.canonical_key(F.col("name")).alias("key")),
    "k01_upsert": lambda s, d: K.upsert(_df(s, OLD, "id int, v string"), _df(s, NEW, "id int, v string"), "id"),
    "k12_counters": lambda s, d: K.counters(_df(s, COUNTS, "name string, n long")),
    "n03_anchors": _anchors,
    "n06_dates": lambda s, d: _df(s, DATES, "id int, a string, b string").select("id", N.valid_dates(F.col("a"), F.col("b")).alias("ok")),
    "s13_working_state": lambda s, d: tree.working_state(*[_df(s, x, "rel_path string") for x in (STAGED, UNSTAGED, UNTRACKED)]),
    "s16_robots": _robots,
    "u04_new_findings": lambda s, d: H.new_findings(H.hardcoded_colors(Index(s, d)), H.hardcoded_colors(Index(s, d)).where("rel_path is not null")),
    "w02_diversified": lambda s, d: C.diversified(_items(s)).select("position", "rel_path", "tokens"),
    "w03_packed": lambda s, d: C.packed(_items(s), 1800).select("position", "rel_path", "tokens"),
}

_UPWARDS = (
    _WALK.format(start="")
    + """, st AS (
  SELECT symbol_id, CASE WHEN looped THEN list_min(list_slice(seen, enters + 1, len(seen))) ELSE cur END AS root_id, CAST(CASE WHEN looped THEN enters ELSE depth END AS INTEGER) AS depth,
    CASE WHEN looped THEN 'cycle' WHEN beyond IS NOT NULL AND there IS NULL THEN 'broken' WHEN beyond IS NOT NULL THEN 'crossing' WHEN depth = 0 THEN 'root' ELSE 'ok' END AS state,
    CASE WHEN looped THEN list_slice(seen, 1, enters + 1) ELSE seen END AS up
  FROM told
)
"""
)

SQL = {
    "p3_paths": _UPWARDS
    + ", nm AS (SELECT symbol_id, any_value(name) AS name FROM symbols WHERE symbol_id IS NOT NULL GROUP BY symbol_id), w AS (SELECT symbol_id, root_id, depth, unnest(up) AS a, generate_subscripts(up, 1) AS i FROM st) "
    "SELECT w.symbol_id, root_id, depth, list(nm.name ORDER BY i DESC) AS path FROM w JOIN nm ON nm.symbol_id = w.a GROUP BY ALL",
    "a12_savings": f"SELECT count(*) AS answers, CAST(sum(floor(greatest(0, b - a) * 0.7 / 4)) AS BIGINT) AS saved_tokens FROM {_values(ANSWERS, 'id, b, a')}",
    "a15_score": f"SELECT e AS errors, w AS warnings, i AS infos, greatest(0, 100 - 5 * e - 2 * w) AS score FROM (SELECT count(*) FILTER (WHERE s = 'error') AS e, count(*) FILTER (WHERE s = 'warn') AS w, count(*) FILTER (WHERE s = 'info') AS i FROM {_values(FINDINGS, 'c, s')})",
    "a16_churn": S.sql("SELECT rel_path, count(*) AS changes FROM e JOIN f USING (file_id) WHERE kind = 'includes' GROUP BY rel_path HAVING count(*) >= 5 ORDER BY changes DESC, rel_path LIMIT 10"),
    "a19_retrieval": f"SELECT strategy, round(avg(hits / greatest(expected, 1)), 6) AS recall, round(avg(CASE WHEN hits + distractors > 0 THEN hits / (hits + distractors) ELSE 1 END), 6) AS precision, round(avg(CASE WHEN required > 0 THEN present / required ELSE 1 END), 6) AS utilisation, count(*) FILTER (WHERE hits = expected AND present = required) AS complete FROM {_values(CASES, 'strategy, hits, expected, distractors, present, required')} GROUP BY strategy",
    "a20_unindexed": S.sql(f"SELECT t.lang, n, coalesce(k, 0) AS indexed FROM {_values(ON_DISK, 'lang, n')} LEFT JOIN (SELECT lang, count(*) AS k FROM f GROUP BY lang) x ON x.lang = t.lang WHERE n >= 10 AND coalesce(k, 0) * 5 < n"),
    "c01_terms": "SELECT term FROM (VALUES ('session'), ('cache'), ('graph')) t(term)",
    "c17_confidence": f"SELECT word, CASE WHEN lower(word) IN ('verified', 'high') THEN 1.0 WHEN lower(word) IN ('medium', 'likely') THEN 0.7 WHEN lower(word) IN ('low', 'uncertain') THEN 0.4 ELSE 0.8 END::DOUBLE AS value FROM {_values(WORDS, 'word')}",
    "f16_terms": "SELECT n, term FROM (VALUES (1, 'Where'), (2, '(session)'), (3, 'cache'), (4, 'graph?')) t(n, term)",
    "f24_capabilities": "SELECT id, sum(score)::INTEGER AS score FROM (SELECT id, CASE WHEN contains(lower(name), t) OR contains(lower(title), t) THEN 5 ELSE 0 END + CASE WHEN contains(lower(triggers), t) THEN 4 ELSE 0 END + CASE WHEN contains(lower(description), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(outputs), t) THEN 1 ELSE 0 END AS score "
    f"FROM {_values(CATALOGUE, 'id, name, title, triggers, description, outputs')}, (VALUES ('session'), ('cache')) q(t)) GROUP BY id HAVING sum(score) > 0 ORDER BY score DESC, id LIMIT 10",
    "h07_canonical_keys": f"SELECT name, array_to_string(list_sort(list_filter(string_split_regex(lower(translate(name, ',+', '  ')), '\\s+'), lambda x: x <> '')), '+') AS key FROM {_values(KEYS, 'name')}",
    "k01_upsert": f"SELECT * FROM {_values(NEW, 'id, v')} UNION ALL SELECT * FROM {_values(OLD, 'id, v')} WHERE id NOT IN (2, 4)",
    "k12_counters": f"SELECT name, sum(n)::BIGINT AS total FROM {_values(COUNTS, 'name, n')} GROUP BY name",
    "n03_anchors": "SELECT * FROM (VALUES (0, 'current', NULL::INTEGER), (1, 'current', NULL), (2, 'invalid', NULL), (3, 'moved', 3), (4, 'missing', NULL)) t(anchor_id, status, moved_to)",
    "n06_dates": f"SELECT id, NOT (a IS NOT NULL AND try_cast(a AS DATE) IS NULL) AND NOT (b IS NOT NULL AND try_cast(b AS DATE) IS NULL) AND coalesce(try_cast(a AS DATE) <= try_cast(b AS DATE), true) AS ok FROM {_values(DATES, 'id, a, b')}",
    "s13_working_state": "SELECT * FROM (VALUES ('a', true, false, false), ('b', true, true, false), ('c', false, true, false), ('d', false, false, true)) t(rel_path, staged, unstaged, untracked)",
    "s16_robots": "SELECT * FROM (VALUES ('/private/x', false), ('/private/open/y', true), ('/public/page', true), ('/admin', false), ('/', true)) t(path, ok)",
    "u04_new_findings": S.sql(
        "SELECT 'hardcoded_color' AS check, 'info' AS severity, rel_path, r.line, value || ' duplicates ' || variable AS detail FROM r JOIN nm USING (value) LEFT JOIN f USING (file_id) WHERE value <> '' AND NOT coalesce(name <> '', false) AND rel_path IS NULL",
        "nm AS (SELECT value, arg_max(name, resource_id) AS variable FROM r WHERE value <> '' AND name <> '' GROUP BY value)",
    ),
    "w02_diversified": f"SELECT row_number() OVER (ORDER BY k > 1, position) AS position, rel_path, tokens FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY position) AS k FROM {_values(ITEMS, 'position, rel_path, tokens')})",
    "w03_packed": f"SELECT * FROM {_values(ITEMS, 'position, rel_path, tokens')} WHERE position IN (1, 3, 4)",
}
