"""Lookup of symbols and full-text search over chunks and docs.

Search ranks by Okapi BM25 (k1 = 1.2, b = 0.75). Tokens are runs of letters and
digits. Only the terms asked for are counted in a text, so a search scans the
texts and shuffles a few numbers for each that matches; `postings` is the table
that an index keeps to answer without a scan.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.functions import text as X
from siftwood.index import Index
from siftwood.operators.reads import innermost, lines_of

K1, B = 1.2, 0.75


def hits(index: Index) -> DataFrame:
    return index.symbols.join(index.paths, "file_id").select("symbol_id", "name", "kind", "signature", "rel_path", "start_line", "end_line")


def exact(index: Index, query: str) -> DataFrame:
    return hits(index).where(F.col("name") == query)


def containing(index: Index, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name holds query in any case, the shortest first."""
    rows = hits(index).where(F.instr(F.lower("name"), query.lower()) > 0)
    return rows.orderBy(F.length("name"), "rel_path", "start_line", "symbol_id").limit(limit)


def named_like(index: Index, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name holds query, wildcards working, by name."""
    return hits(index).where(F.lower("name").like(f"%{query.lower()}%")).orderBy("name", "symbol_id").limit(limit)


def _band(index: Index, low: int, high: int) -> DataFrame:
    return index.raw("symbols").where(F.length("name").between(low, high)).select("name").distinct()


def name_band(index: Index, low: int, high: int, cap: int = 20_000) -> DataFrame:
    """The distinct names of a length, by name: the first of them."""
    return _band(index, low, high).orderBy("name").limit(cap)


def fuzzy(index: Index, query: str, limit: int = 10) -> DataFrame:
    """name and distance of the names nearest to a query, of all names of about its length: one edit, two from eight letters on."""
    if len(query) < 4:
        return index.spark.createDataFrame([], "name string, distance int")
    most = 2 if len(query) >= 8 else 1
    band = _band(index, len(query) - most, len(query) + most)
    near = band.select("name", X.osa_to(query.lower())(F.lower("name")).alias("distance"))
    return near.where(F.col("distance").between(1, most)).orderBy("distance", "name").limit(limit)


def _phrase(terms: list[str]):
    return lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(terms)} ")


def _equals(word: str):
    return lambda token: token == word


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, key and tf of every term of every text: the inverted index."""
    rows = texts.select(key, F.explode(X.tokens(F.col(text))).alias("term"))
    return rows.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def scored(texts: DataFrame, key: str, text: str, question: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep, tier and score of the texts that hold a term: tier 0 the phrase, 1 all terms, 2 any."""
    terms = [t.lower() for part in X.search_terms(question) for t in _split(part)]
    words = list(dict.fromkeys(terms))
    if not words:
        return texts.limit(0).select(key, *keep, F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    found = texts.select(key, *keep, X.tokens(F.col(text)).alias("tokens"))
    counts = [F.size(F.filter("tokens", _equals(w))).alias(f"tf{i}") for i, w in enumerate(words)]
    told = found.select(key, *keep, F.size("tokens").alias("len"), _phrase(terms)(F.col("tokens")).alias("phrase"), *counts)
    stats = told.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), stats[f"df{i}"]
        idf = log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avg))
    every = [F.col(f"tf{i}") > 0 for i in range(len(words))]
    all_, any_ = every[0], every[0]
    for e in every[1:]:
        all_, any_ = all_ & e, any_ | e
    tier = F.when(F.col("phrase"), 0).when(all_, 1).otherwise(2)
    return told.where(any_).select(key, *keep, tier.alias("tier"), F.round(score, 6).alias("score"))


def _split(term: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", term)


def search_chunks(index: Index, question: str, limit: int = 50) -> DataFrame:
    """chunk_id, file_id, start_line, tier and score: the best of each tier in order, one per file and line."""
    rows = scored(index.raw("chunks"), "chunk_id", "text", question, ("file_id", "start_line")).dropDuplicates(["file_id", "start_line"])
    return rows.orderBy("tier", F.desc("score"), "chunk_id").limit(limit)


def search_docs(index: Index, question: str, limit: int = 50) -> DataFrame:
    """symbol_id, tier and score of the symbols whose doc answers."""
    rows = scored(index.symbols.where(F.length("doc") > 0), "symbol_id", "doc", question)
    return rows.orderBy("tier", F.desc("score"), "symbol_id").limit(limit)


def search_names(index: Index, question: str, limit: int = 50) -> DataFrame:
    """symbol_id and score of the symbols whose name and signature hold the phrase."""
    rows = index.symbols.select("symbol_id", "name", F.concat_ws(" ", "name", "signature").alias("text"))
    return scored(rows, "symbol_id", "text", question, ("name",)).where("tier = 0").orderBy(F.desc("score"), "name", "symbol_id").limit(limit)


def substring_chunks(index: Index, question: str, limit: int = 50) -> DataFrame:
    """chunk_id of the chunks that hold every term as it stands in any case, the shortest first."""
    terms = [t.lower() for t in X.search_terms(question)]
    rows = index.raw("chunks")
    for t in terms:
        rows = rows.where(F.instr(F.lower("text"), t) > 0)
    rows = rows.select("chunk_id", F.length("text").alias("n"), X.snippet(F.col("text"), terms).alias("snippet")).dropDuplicates(["chunk_id"])
    return rows.orderBy("n", "chunk_id").limit(limit)


def path_recall(index: Index, question: str, limit: int = 40) -> DataFrame:
    """file_id, rel_path and the first chunk of the files whose path names a term."""
    from siftwood.operators.reads import first_chunks

    score = X.concept_score(X.concept_terms(question), F.col("rel_path"))
    named = index.paths.withColumn("concept", score).where("concept > 0").orderBy(F.desc("concept"), "rel_path").limit(limit)
    return named.join(first_chunks(index), "file_id").select("file_id", "rel_path", "chunk_id", "start_line", "concept")


def placed(index: Index, question: str, limit: int = 20) -> DataFrame:
    """chunk_id, rel_path, start_line, class, concept and ordinal: source before tests, docs and vendored files, then what the path names, then rank."""
    pool = max(4 * limit, 200)
    found = search_chunks(index, question, pool)
    order = Window.orderBy("tier", F.desc("score"), "chunk_id")  # over the pool only
    found = found.withColumn("ordinal", F.row_number().over(order)).select("file_id", "start_line", "chunk_id", "ordinal")
    recall = path_recall(index, question).select("file_id", "start_line", "chunk_id", (F.lit(pool) + F.row_number().over(Window.orderBy(F.desc("concept"), "rel_path"))).alias("ordinal"))
    both = found.unionByName(recall).groupBy("file_id", "start_line").agg(F.min("ordinal").alias("ordinal"), F.min("chunk_id").alias("chunk_id"))
    rows = both.join(index.paths, "file_id").withColumn("class", P.search_tier(F.col("rel_path"))).withColumn("concept", X.concept_score(X.concept_terms(question), F.col("rel_path")))
    return rows.orderBy("class", F.desc("concept"), "ordinal").limit(limit)


def ranked(index: Index, question: str, limit: int = 20) -> DataFrame:
    """rel_path, start_line, chunk_id, class and concept of the same."""
    return placed(index, question, limit).select("rel_path", "start_line", "chunk_id", "class", "concept")


def find(index: Index, query: str) -> DataFrame:
    """position, symbol and match of the symbols a name finds: exact, then phrase, then part of the name; definitions before settings, own before vendored."""
    e = exact(index, query).select("symbol_id", F.lit(0).alias("source"), F.row_number().over(Window.orderBy("rel_path", "start_line", "symbol_id")).alias("ordinal"))
    p = search_names(index, query).select("symbol_id", F.lit(1).alias("source"), F.row_number().over(Window.orderBy(F.desc("score"), "name", "symbol_id")).alias("ordinal"))
    c = containing(index, query).select("symbol_id", F.lit(2).alias("source"), F.row_number().over(Window.orderBy(F.length("name"), "rel_path", "start_line", "symbol_id")).alias("ordinal"))
    best = e.unionByName(p).unionByName(c).groupBy("symbol_id").agg(F.min(F.struct("source", "ordinal")).alias("m"))
    rows = best.join(hits(index), "symbol_id").withColumn("rank", P.find_rank(F.col("kind"), F.col("rel_path")))
    return rows.select("symbol_id", "name", "kind", "rel_path", "start_line", "rank", "m.source", "m.ordinal").orderBy("rank", "source", "ordinal")


def call_sites(index: Index, name: str, limit: int = 40) -> DataFrame:
    """rel_path, line, text and enclosing definition of the lines that call name, its own definition left out."""
    call = rf"(?<![A-Za-z0-9_]){name}[ \t]*\("
    rows = index.chunks.where(F.col("text").contains(name)).select("file_id", "start_line", F.posexplode(lines_of(F.col("text"))).alias("at", "text"))
    rows = rows.where(F.col("text").rlike(call)).select("file_id", (F.col("start_line") + F.col("at")).alias("line"), "text").distinct()
    own = index.symbols.where(F.col("name") == name).select("file_id", F.col("start_line").alias("line"))
    rows = rows.join(own, ["file_id", "line"], "left_anti")
    held = rows.join(innermost(index, rows.select("file_id", "line")), ["file_id", "line"], "left").where(F.coalesce("name", F.lit("")) != name)
    return held.join(index.paths, "file_id").select("rel_path", "line", F.trim("text").alias("text"), F.col("name").alias("enclosing")).orderBy("rel_path", "line").limit(limit)


def capabilities(catalogue: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """id and score: for each term 5 in name or title, 4 in a trigger, 2 in the description, 1 in the outputs."""
    score = F.lit(0)
    for t in X.question_terms(question):
        for columns, weight in ((("name", "title"), 5), (("triggers",), 4), (("description",), 2), (("outputs",), 1)):
            held = F.lit(False)
            for c in columns:
                held = held | (F.instr(F.lower(F.coalesce(F.col(c), F.lit(""))), t) > 0)
            score = score + F.when(held, weight).otherwise(0)
    return catalogue.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
