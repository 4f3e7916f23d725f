"""Queries of lookup, search, vectors and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.functions import text as X
from siftwood.index import Index
from siftwood.operators import fusion as Q
from siftwood.operators import hybrid as H
from siftwood.operators import search as E
from siftwood.operators import vectors as V
from siftwood.plans import sqltext as S

#: What the search queries ask for.
QUESTION, NAME, PART, TYPO = "remote session cache", "parse_line", "cache", "parse_lime"
K = 10
#: The vector that stands for the question.
ASKED = 20


def _vectors(s, d):
    return Index(s, d).raw("embeddings")


def _nearest(s, d):
    rows = _vectors(s, d).select("vec_id", "embedding")
    return V.nearest(rows.where("vec_id % 20 = 0"), rows, K)


def _lists(s, d):
    """Two rankings of the same chunks: by words, and by the length of their text."""
    index = Index(s, d)
    one = E.search_chunks(index, QUESTION, 50).select("chunk_id", F.lit(1).alias("list_no"), F.row_number().over(Window.orderBy("tier", F.desc("score"), "chunk_id")).alias("rank"))
    two = E.substring_chunks(index, PART, 50).select("chunk_id", F.lit(0).alias("list_no"), F.row_number().over(Window.orderBy("n", "chunk_id")).alias("rank"))
    return one.unionByName(two)


def _recall(s, d):
    index = Index(s, d)
    base = E.search_chunks(index, QUESTION, 20).select("chunk_id", F.row_number().over(Window.orderBy("tier", F.desc("score"), "chunk_id")).alias("position"))
    docs = E.substring_chunks(index, PART, 20).select("chunk_id", F.lit(0).alias("tier"), F.row_number().over(Window.orderBy("n", "chunk_id")).alias("position"))
    return Q.doc_recall(base, docs, "chunk_id", 50)


QUERIES = {
    "f01_exact": lambda s, d: E.exact(Index(s, d), NAME),
    "f02_phrase": lambda s, d: E.search_names(Index(s, d), PART),
    "f03_containing": lambda s, d: E.containing(Index(s, d), PART),
    "f04_named_like": lambda s, d: E.named_like(Index(s, d), PART),
    "f05_name_band": lambda s, d: E.name_band(Index(s, d), 9, 11),
    "f07_fuzzy": lambda s, d: E.fuzzy(Index(s, d), TYPO),
    "f08_find": lambda s, d: E.find(Index(s, d), PART),
    "f10_postings": lambda s, d: E.postings(Index(s, d).chunks, "chunk_id"),
    "f11_search": lambda s, d: E.search_chunks(Index(s, d), QUESTION),
    "f13_substring": lambda s, d: E.substring_chunks(Index(s, d), PART).select("chunk_id", "n"),
    "f14_snippets": lambda s, d: E.substring_chunks(Index(s, d), PART).select("chunk_id", "snippet"),
    "f15_path_recall": lambda s, d: E.path_recall(Index(s, d), QUESTION),
    "f18_concept_scores": lambda s, d: Index(s, d).paths.select("rel_path", X.concept_score(X.concept_terms(QUESTION), F.col("rel_path")).alias("score")),
    "f20_ranked": lambda s, d: E.ranked(Index(s, d), QUESTION),
    "f21_docs": lambda s, d: E.search_docs(Index(s, d), "falls back budget"),
    "f23_call_sites": lambda s, d: E.call_sites(Index(s, d), "next_token"),
    "c02_lexical_scores": lambda s, d: Index(s, d).chunks.select("chunk_id", X.lexical_score(X.question_terms("Where is the session cache?"), F.col("text")).alias("score")),
    "q01_fusion": lambda s, d: Q.reciprocal_rank(_lists(s, d), "chunk_id").select("chunk_id", "score"),
    "q02_doc_recall": _recall,
    "q03_plain": lambda s, d: H.plain_search(Index(s, d), QUESTION),
    "q04_hybrid": lambda s, d: H.hybrid_search(Index(s, d), QUESTION, _vectors(s, d), _vectors(s, d).where(f"vec_id = {ASKED}")),
    "v05_quantized": lambda s, d: _vectors(s, d).select("vec_id", V.quantized(F.col("embedding")).alias("q")).select("vec_id", F.col("q.scale").alias("scale"), F.col("q.values").cast("array<int>").alias("codes")),
    "v06_nearest": _nearest,
    "v07_embeddable": lambda s, d: Index(s, d).chunks.where(V.embeddable(F.col("text"))).select("chunk_id"),
    "j22_backlog": lambda s, d: V.backlog(Index(s, d).chunks, _vectors(s, d).select(F.col("vec_id").alias("chunk_id"))).select("chunk_id"),
}

_HIT = "SELECT symbol_id, name, kind, signature, rel_path, start_line, end_line FROM s JOIN f USING (file_id)"


def bm25(source: str, key: str, text: str, question: str, keep: str = "", mark: str = "") -> str:
    """The common parts of a search: told (with mark behind it) has key, tier and score."""
    terms = [t.lower() for part in X.search_terms(question) for t in E._split(part)]
    words = list(dict.fromkeys(terms))
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(words)))
    every, some = " AND ".join(f"tf{i} > 0" for i in range(len(words))), " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""
k{mark} AS (SELECT {key}{keep}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM {source}),
w{mark} AS (SELECT * EXCLUDE (tokens), len(tokens) AS len, contains(' ' || array_to_string(tokens, ' ') || ' ', ' {' '.join(terms)} ') AS phrase, {tf} FROM k{mark}),
st{mark} AS (SELECT count(*) AS n, avg(len) AS avg_len, {df} FROM w{mark}),
told{mark} AS (SELECT {key}{keep}, CASE WHEN phrase THEN 0 WHEN {every} THEN 1 ELSE 2 END AS tier, round({score}, 6) AS score FROM w{mark}, st{mark} WHERE {some})"""


def _chunks(question: str, limit: int, name: str = "top") -> str:
    return bm25("chunks", "chunk_id", "text", question, ", file_id, start_line") + f", {name} AS (SELECT DISTINCT chunk_id, file_id, start_line, tier, score FROM told ORDER BY tier, score DESC, chunk_id LIMIT {limit})"


_PART = f"part AS (SELECT chunk_id, length(text) AS n, text FROM c WHERE instr(lower(text), '{PART}') > 0 ORDER BY n, chunk_id LIMIT {{n}})"
_CONCEPT = " + ".join(f"CASE WHEN contains(lower({S.base('rel_path')}), '{t}') THEN 2 WHEN contains(lower(rel_path), '{t}') THEN 1 ELSE 0 END" for t in X.concept_terms(QUESTION))
_RECALL = (
    f"named AS (SELECT file_id, rel_path, {_CONCEPT} AS concept FROM f WHERE {_CONCEPT} > 0 ORDER BY concept DESC, rel_path LIMIT 40), "
    "fc AS (SELECT file_id, chunk_id, start_line FROM c QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY start_line, chunk_id) = 1), "
    "rec AS (SELECT file_id, rel_path, chunk_id, start_line, concept FROM named JOIN fc USING (file_id))"
)
_PLACED = (
    _chunks(QUESTION, 200) + ", " + _RECALL + f", lex AS (SELECT chunk_id, row_number() OVER (ORDER BY class, concept DESC, ordinal) AS rank FROM (SELECT chunk_id, ordinal, {S.tier('rel_path')} AS class, {_CONCEPT} AS concept FROM ("
    "SELECT file_id, start_line, min(ordinal) AS ordinal, min(chunk_id) AS chunk_id FROM (SELECT file_id, start_line, chunk_id, row_number() OVER (ORDER BY tier, score DESC, chunk_id) AS ordinal FROM top "
    "UNION ALL SELECT file_id, start_line, chunk_id, 200 + row_number() OVER (ORDER BY concept DESC, rel_path) FROM rec) GROUP BY ALL) JOIN f USING (file_id)) QUALIFY rank <= 20), "
    "sd AS (SELECT symbol_id, doc FROM s WHERE doc <> ''), " + bm25("sd", "symbol_id", "doc", QUESTION, mark="_d") + ", "
    "dtop AS (SELECT symbol_id, tier, score FROM told_d ORDER BY tier, score DESC, symbol_id LIMIT 20), "
    "dc AS (SELECT c.chunk_id, d.tier, d.score, d.symbol_id FROM dtop d JOIN s USING (symbol_id) JOIN c ON c.file_id = s.file_id AND s.start_line BETWEEN c.start_line AND c.end_line QUALIFY row_number() OVER (PARTITION BY c.chunk_id ORDER BY d.tier, d.score DESC, d.symbol_id) = 1)"
)
_MERGED = (
    ", miss AS (SELECT chunk_id, row_number() OVER (ORDER BY tier, score DESC, symbol_id) AS j FROM dc WHERE chunk_id NOT IN (SELECT chunk_id FROM b) QUALIFY j <= 3), "
    "m AS (SELECT chunk_id, CASE WHEN position <= 10 THEN position ELSE position + (SELECT count(*) FROM miss) END AS position FROM b UNION ALL SELECT chunk_id, (SELECT least(10, count(*)) FROM b) + j FROM miss)"
)
_CALL = "(^|[^A-Za-z0-9_])next_token[ \\t]*\\("

SQL = {
    "f01_exact": S.sql(f"{_HIT} WHERE name = '{NAME}'"),
    "f02_phrase": S.sql(
        "SELECT symbol_id, name, tier, score FROM told WHERE tier = 0 ORDER BY score DESC, name, symbol_id LIMIT 50",
        "t AS (SELECT symbol_id, name, concat_ws(' ', name, signature) AS text FROM s), " + bm25("t", "symbol_id", "text", PART, ", name"),
    ),
    "f03_containing": S.sql(f"{_HIT} WHERE instr(lower(name), '{PART}') > 0 ORDER BY length(name), rel_path, start_line, symbol_id LIMIT 50"),
    "f04_named_like": S.sql(f"{_HIT} WHERE lower(name) LIKE '%{PART}%' ORDER BY name, symbol_id LIMIT 50"),
    "f05_name_band": S.sql("SELECT DISTINCT name FROM s WHERE length(name) BETWEEN 9 AND 11 ORDER BY name LIMIT 20000"),
    "f08_find": S.sql(
        "SELECT symbol_id, name, kind, rel_path, start_line, rank, source, ordinal FROM (SELECT symbol_id, source, ordinal FROM ("
        f"SELECT symbol_id, 0 AS source, row_number() OVER (ORDER BY rel_path, start_line, symbol_id) AS ordinal FROM h WHERE name = '{PART}' "
        "UNION ALL SELECT * FROM (SELECT symbol_id, 1, row_number() OVER (ORDER BY score DESC, name, symbol_id) AS ordinal FROM told WHERE tier = 0) WHERE ordinal <= 50 "
        f"UNION ALL SELECT * FROM (SELECT symbol_id, 2, row_number() OVER (ORDER BY length(name), rel_path, start_line, symbol_id) AS ordinal FROM h WHERE instr(lower(name), '{PART}') > 0) WHERE ordinal <= 50) "
        f"QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY source, ordinal) = 1) JOIN (SELECT *, CASE WHEN kind IN {S._list(P.AUXILIARY_KINDS)} THEN 1 ELSE 0 END + CASE WHEN {S.vendored('rel_path')} THEN 2 ELSE 0 END AS rank FROM h) USING (symbol_id)",
        f"h AS ({_HIT}), t AS (SELECT symbol_id, name, concat_ws(' ', name, signature) AS text FROM s), " + bm25("t", "symbol_id", "text", PART, ", name"),
    ),
    "f10_postings": S.sql("SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM c) GROUP BY ALL"),
    "f11_search": S.sql("SELECT * FROM top", _chunks(QUESTION, 50)),
    "f13_substring": S.sql("SELECT chunk_id, n FROM part", _PART.format(n=50)),
    "f14_snippets": S.sql(f"SELECT chunk_id, substring(text, greatest(1, instr(lower(text), '{PART}') - 60), 120) AS snippet FROM part", _PART.format(n=50)),
    "f15_path_recall": S.sql("SELECT * FROM rec", _RECALL),
    "f18_concept_scores": S.sql(f"SELECT rel_path, {_CONCEPT} AS score FROM f"),
    "f20_ranked": S.sql(
        f"SELECT rel_path, start_line, chunk_id, {S.tier('rel_path')} AS class, {_CONCEPT} AS concept FROM (SELECT file_id, start_line, min(ordinal) AS ordinal, min(chunk_id) AS chunk_id FROM ("
        "SELECT file_id, start_line, chunk_id, row_number() OVER (ORDER BY tier, score DESC, chunk_id) AS ordinal FROM top "
        "UNION ALL SELECT file_id, start_line, chunk_id, 200 + row_number() OVER (ORDER BY concept DESC, rel_path) FROM rec) GROUP BY ALL) JOIN f USING (file_id) ORDER BY class, concept DESC, ordinal LIMIT 20",
        _chunks(QUESTION, 200) + ", " + _RECALL,
    ),
    "f21_docs": S.sql("SELECT symbol_id, tier, score FROM told ORDER BY tier, score DESC, symbol_id LIMIT 50", "sd AS (SELECT symbol_id, doc FROM s WHERE doc <> ''), " + bm25("sd", "symbol_id", "doc", "falls back budget")),
    "c02_lexical_scores": S.sql(
        "SELECT chunk_id, " + " + ".join(f"5 * least(3, (length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)})" for t in X.question_terms("Where is the session cache?")) + " AS score FROM c"
    ),
    "q01_fusion": S.sql(
        "SELECT chunk_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT chunk_id, 1 AS list_no, row_number() OVER (ORDER BY tier, score DESC, chunk_id) AS rank FROM top "
        "UNION ALL SELECT chunk_id, 0, row_number() OVER (ORDER BY n, chunk_id) FROM part) GROUP BY chunk_id ORDER BY score DESC, min({'list_no': list_no, 'rank': rank}) LIMIT 50",
        _chunks(QUESTION, 50) + ", " + _PART.format(n=50),
    ),
    "q02_doc_recall": S.sql(
        "SELECT chunk_id, CASE WHEN position <= 10 THEN position ELSE position + (SELECT count(*) FROM miss) END AS position FROM b UNION ALL SELECT chunk_id, (SELECT least(10, count(*)) FROM b) + j FROM miss",
        _chunks(QUESTION, 20) + ", " + _PART.format(n=20) + ", b AS (SELECT chunk_id, row_number() OVER (ORDER BY tier, score DESC, chunk_id) AS position FROM top), "
        "miss AS (SELECT chunk_id, row_number() OVER (ORDER BY n, chunk_id) AS j FROM part WHERE chunk_id NOT IN (SELECT chunk_id FROM b) QUALIFY j <= 3)",
    ),
    "q03_plain": S.sql("SELECT * FROM m WHERE position <= 20", _PLACED + ", b AS (SELECT chunk_id, rank AS position FROM lex)" + _MERGED),
    "q04_hybrid": S.sql(
        "SELECT * FROM m WHERE position <= 20",
        _PLACED + f", near AS (SELECT v.vec_id AS chunk_id, row_number() OVER (ORDER BY round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id = {ASKED} AND v.vec_id IN (SELECT chunk_id FROM chunks) QUALIFY rank <= 20), "
        "b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, first) AS position FROM (SELECT chunk_id, round(sum(1 / (60 + rank)), 9) AS score, min({'l': l, 'r': rank}) AS first FROM (SELECT chunk_id, 0 AS l, rank FROM near UNION ALL SELECT chunk_id, 1, rank FROM lex) GROUP BY chunk_id) QUALIFY position <= 20)" + _MERGED,
    ),
    "v05_quantized": "SELECT vec_id, round(m / 127, 9) AS scale, list_transform(embedding, lambda x: CAST(round(x::DOUBLE / (m / 127)) AS INTEGER)) AS codes FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)",
    "v06_nearest": "SELECT query_id, vec_id, round(d, 5) AS distance, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 10",
    "v07_embeddable": S.sql("SELECT chunk_id FROM c WHERE length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) > 0"),
    "j22_backlog": S.sql("SELECT chunk_id FROM c WHERE length(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) > 0 AND chunk_id NOT IN (SELECT vec_id FROM embeddings)"),
}
