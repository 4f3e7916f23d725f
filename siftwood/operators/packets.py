"""Context packets: evidence for a question, ranked by explicit factors and packed into a budget of tokens.

Candidates are few by construction (40 chunks, 8 related files, 8 paths), so the
last steps, which look at one candidate after the other, work on one row that
holds them as an array.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.functions import text as X
from siftwood.index import Index
from siftwood.operators import search
from siftwood.session import materialize

SOURCES, RELATED, PATHS, BUDGET = 40, 8, 8, 1800
LOW_SIGNAL, PROSE, MATCH_BOOST = 0.35, 0.5, 8
DIRECT, NOTE, CURRENT, STALE, CHANGED, SEMANTIC, SURE, HOP = 100, 15, 10, -20, 8, 12, 5, -2
MODES = ("compact", "standard", "full")
# ---- fixed values: words of a question that ask for a class of files ----
WANTS = {
    "lockfile": ("lock", "lockfile", "lockfiles", "dependency", "dependencies", "pinned"),
    "locale": ("locale", "locales", "i18n", "l10n", "translation", "translations", "translate", "translated", "language", "languages", "lang"),
    "generated": ("generated", "generate", "codegen", "protobuf", "proto", "grpc", "schema"),
    "minified": ("minified", "minify", "bundle", "bundled", "sourcemap"),
    "ci": ("ci", "cicd", "workflow", "workflows", "action", "actions", "pipeline", "pipelines", "release", "deploy", "deployment"),
    "docs": ("docs", "doc", "documentation", "readme", "changelog", "guide", "guides", "tutorial", "howto"),
    "test": ("test", "tests", "tested", "testing", "unit", "integration", "e2e", "fixture", "fixtures", "mock", "mocks", "spec", "specs", "coverage"),
}
# ---- end of fixed values ----


def tokens_of(text: Column) -> Column:
    """The estimate of the cost of a text: its bytes plus three, by four."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def source_id(path: Column, line: Column) -> Column:
    """The id of a place: url-safe base64 of path and line without padding."""
    return F.concat(F.lit("source:"), F.regexp_replace(F.translate(F.base64(F.encode(F.concat_ws(":", path, line), "UTF-8")), "+/", "-_"), "[=\r\n]", ""))


def confidence(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.isin("verified", "high"), 1.0).when(low.isin("medium", "likely"), 0.7).when(low.isin("low", "uncertain"), 0.4).otherwise(0.8)


def first_paragraph(body: Column) -> Column:
    """The text before the first empty line, 500 characters at most."""
    part = F.substring_index(F.regexp_replace(body, r"^\s+|\s+$", ""), "\n\n", 1)
    return F.when(F.length(part) > 500, F.concat(F.substring(part, 1, 500), F.lit("…"))).otherwise(part)


def end_line(start: Column, text: Column) -> Column:
    """The last line of a text that begins on line start."""
    n = F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0)
    return start + F.greatest(F.lit(1), n) - 1


def wanted(terms: list[str], name: Column) -> Column:
    """Whether the question itself asks for files of a class."""
    asked = [c for c, words in WANTS.items() if set(words) & set(terms)]
    return name.isin(*asked) if asked else F.lit(False)


def source_candidates(index: Index, question: str, limit: int = SOURCES) -> DataFrame:
    """chunk_id, rel_path, start_line and lexical of the chunks that answer best."""
    terms = X.question_terms(question)
    found = search.search_chunks(index, question, limit).select("chunk_id", "file_id", "start_line")
    texts = index.raw("chunks").join(found.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "text").dropDuplicates(["chunk_id"])
    return found.join(texts, "chunk_id").join(index.paths, "file_id").select("chunk_id", "file_id", "rel_path", "start_line", "text", X.lexical_score(terms, F.col("text")).alias("lexical"))


def path_candidates(index: Index, question: str, limit: int = PATHS) -> DataFrame:
    """file_id and named of the files whose name holds two terms of the question, or the one there is."""
    terms = X.question_terms(question)
    name = F.lower(P.basename(F.col("rel_path")))
    held = F.lit(0)
    for t in terms:
        held = held + F.when(name.contains(t), 1).otherwise(0)
    least = 1 if len(terms) == 1 else 2
    return index.paths.withColumn("named", held).where(F.col("named") >= least).orderBy(F.desc("named"), "rel_path").limit(limit)


def symbol_files(index: Index, question: str) -> DataFrame:
    """The files that define a symbol whose name holds a term or its stem of four letters or more."""
    forms = sorted({f for t in X.question_terms(question) for f in (t, X.stemmed(t)) if len(f) >= 4})
    hit = F.lit(False)
    for f in forms:
        hit = hit | F.instr(F.lower("name"), f).cast("int").__gt__(0)
    return index.symbols.where(hit).select("file_id").distinct()


_EMPTY_NOTES = "note_id string, title string, summary string, body string, tags string, confidence string, freshness string"


def note_candidates(notes: DataFrame, question: str) -> DataFrame:
    """The curated notes that hold a term of the question: note_id, title, summary, body, fresh, confidence and lexical.

    notes has note_id, title, summary, body, tags, confidence and freshness ('current',
    'stale', 'moved', 'missing' or, where it names no place in the source, null).
    """
    terms = X.question_terms(question)
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "tags", "body")])
    rows = notes.select("note_id", "title", "summary", "body", F.coalesce("freshness", F.lit("unverified")).alias("fresh"), confidence(F.coalesce("confidence", F.lit(""))).alias("confidence"), X.lexical_score(terms, text).alias("lexical"))
    return rows.where("lexical > 0") if terms else rows


def related(index: Index, direct: DataFrame, limit: int = RELATED) -> DataFrame:
    """file_id and position of the files one link away from direct (file_id, position): in the order of the candidates that lead to them, then by path.

    Each file is counted with the first candidate that leads to it, and the list is cut only after that.
    """
    links = index.links().where(F.col("src") != F.col("dst"))
    first = direct.groupBy("file_id").agg(F.min("position").alias("position"))
    out = links.join(first, F.col("src") == F.col("file_id")).select(F.col("dst").alias("near"), "position")
    back = links.join(first, F.col("dst") == F.col("file_id")).select(F.col("src").alias("near"), "position")
    ways = out.unionByName(back).groupBy(F.col("near").alias("file_id")).agg(F.min("position").alias("position")).join(first.select("file_id"), "file_id", "left_anti")
    return ways.join(index.paths, "file_id").orderBy("position", "rel_path").limit(limit).select("file_id", "position")


def ranked(index: Index, question: str, *, notes: DataFrame | None = None, semantic: DataFrame | None = None, direct_ids: tuple[str, ...] = (), changed: DataFrame | None = None) -> DataFrame:
    """position, id, kind, rel_path, start_line, title, summary, compact, standard, full, class, distance, score and reasons of all candidates, the best first.

    semantic has id and semantic from 0 to 1, changed has the rel_path of changed files.
    """
    spark, terms = index.spark, X.question_terms(question)
    direct = materialize(source_candidates(index, question), "sources")
    order = Window.orderBy(F.desc("lexical"), "chunk_id")  # over the candidates of one question
    placed = direct.withColumn("position", F.row_number().over(order))
    near = direct.select("file_id").distinct()
    ways = related(index, placed.select("file_id", "position")).select("file_id", F.lit(1).alias("distance"), F.lit(False).alias("by_path"))
    named = path_candidates(index, question).select("file_id").join(near, "file_id", "left_anti").select("file_id", F.lit(0).alias("distance"), F.lit(True).alias("by_path"))
    more = materialize(ways.unionByName(named).groupBy("file_id").agg(F.min("distance").alias("distance"), F.max("by_path").alias("by_path")), "more")
    # the few chunks are picked by their ids before any text is touched
    heads = index.raw("chunks").select("file_id", "chunk_id", "start_line").join(more, "file_id", "left_semi")
    heads = heads.groupBy("file_id").agg(F.min(F.struct("start_line", "chunk_id")).alias("h")).select("file_id", "h.start_line", "h.chunk_id")
    texts = index.raw("chunks").select("chunk_id", "text").join(heads.select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("text").alias("text"))
    lexical = F.when(F.col("by_path"), X.lexical_score(terms, F.col("text"))).otherwise(0)
    more = more.join(heads, "file_id").join(texts, "chunk_id").join(index.paths, "file_id").select("file_id", "rel_path", "start_line", "text", lexical.alias("lexical"), "distance")
    source = direct.select("file_id", "rel_path", "start_line", "text", "lexical", F.lit(0).alias("distance")).unionByName(more)
    defines = symbol_files(index, question).withColumn("defines", F.lit(True)) if terms else spark.createDataFrame([], "file_id bigint, defines boolean")
    source = source.join(defines, "file_id", "left")
    name_score = X.concept_score(X.concept_terms(question), F.col("rel_path"))
    source = source.select(
        source_id(F.col("rel_path"), F.col("start_line")).alias("id"), F.lit("source").alias("kind"), "rel_path", "start_line", F.col("rel_path").alias("title"), first_paragraph(F.col("text")).alias("summary"),
        first_paragraph(F.col("text")).alias("compact"), F.col("text").alias("standard"), F.col("text").alias("full"), F.when(wanted(terms, P.low_signal(F.col("rel_path"))), "").otherwise(P.low_signal(F.col("rel_path"))).alias("class"),
        "distance", F.col("lexical").cast("double").alias("lexical"), F.lit("current").alias("fresh"), F.lit(1.0).alias("confidence"), F.coalesce("defines", F.lit(False)).alias("defines"), (name_score > 0).alias("names"),
    )
    known = note_candidates(notes if notes is not None else spark.createDataFrame([], _EMPTY_NOTES), question).select(
        F.concat(F.lit("concept:"), "note_id").alias("id"), F.lit("knowledge").alias("kind"), F.lit(None).cast("string").alias("rel_path"), F.lit(None).cast(source.schema["start_line"].dataType).alias("start_line"), "title", "summary",
        F.col("summary").alias("compact"), first_paragraph(F.col("body")).alias("standard"), F.col("body").alias("full"), F.lit("").alias("class"), F.lit(0).alias("distance"), F.col("lexical").cast("double").alias("lexical"),
        "fresh", "confidence", F.lit(False).alias("defines"), F.lit(False).alias("names"),
    )
    both = source.unionByName(known)
    both = both.join(semantic.select("id", "semantic"), "id", "left") if semantic is not None else both.withColumn("semantic", F.lit(0.0))
    both = both.join(changed.select("rel_path", F.lit(True).alias("touched")).distinct(), "rel_path", "left") if changed is not None else both.withColumn("touched", F.lit(False))
    asked = F.col("id").isin(*direct_ids) if direct_ids else F.lit(False)
    low, plain = (F.col("class") != "") & ~asked, (F.col("class") == "") & ~asked
    # factor on the lexical score first, then what is added, each with its reason
    factor = F.when(low, F.when(F.col("class") == "docs", PROSE).otherwise(LOW_SIGNAL)).otherwise(1.0)
    added = (
        (F.coalesce("semantic", F.lit(0.0)) > 0, F.col("semantic") * SEMANTIC, "close in meaning"),
        (asked, F.lit(DIRECT), "asked for by id"),
        (F.col("kind") == "knowledge", F.lit(NOTE), "curated note"),
        (F.col("fresh") == "current", F.lit(CURRENT), "evidence is current"),
        (F.col("fresh") == "stale", F.lit(STALE), "evidence is stale"),
        (F.col("distance") > 0, F.col("distance") * HOP, "linked to a source"),
        (F.coalesce("touched", F.lit(False)), F.lit(CHANGED), "in a changed file"),
        (F.col("defines") & plain, F.lit(MATCH_BOOST), "defines a symbol of the question"),
        (F.col("names") & plain, F.lit(MATCH_BOOST), "path names the question"),
    )
    score = F.col("lexical") * factor + F.col("confidence") * SURE
    for when, points, _ in added:
        score = score + F.when(when, points).otherwise(0)
    reasons = F.array_compact(F.array(F.when(low, F.concat("class", F.lit(" file, counts less"))), *[F.when(when, F.lit(why)) for when, _, why in added]))
    rows = both.withColumn("score", F.round(score, 6)).withColumn("reasons", reasons)
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return rows.select("position", "id", "kind", "rel_path", "start_line", "title", "summary", "compact", "standard", "full", "class", "distance", "score", "reasons")


def diversified(rows: DataFrame) -> DataFrame:
    """The same rows in a new order: the first of every file, then the repeats."""
    place = F.coalesce("rel_path", "id") if "id" in rows.columns else F.col("rel_path")
    turn = F.row_number().over(Window.partitionBy(place).orderBy("position"))
    moved = rows.withColumn("turn", F.when(turn > 1, 1).otherwise(0))
    return moved.withColumn("position", F.row_number().over(Window.orderBy("turn", "position"))).drop("turn")


def packed(rows: DataFrame, budget: int = BUDGET, cost: str = "tokens") -> DataFrame:
    """The rows, in order of position, that fit the budget one after the other: what doesn't fit is passed over, later ones may fit."""
    items = rows.agg(F.array_sort(F.collect_list(F.struct("position", F.col(cost).cast("bigint").alias("cost")))).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["used"] + item["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + item["cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(item["position"].cast("int")))).otherwise(acc["kept"]).alias("kept"))

    kept = items.select(F.explode(F.aggregate("items", start, step)["kept"]).alias("position"))
    return rows.join(kept, "position", "left_semi")


def by_mode(mode: str) -> tuple[Column, Column]:
    """The content of a candidate in a mode and the mode it is in: what is empty falls through to the next shorter one."""
    full, standard = F.coalesce("full", F.lit("")), F.coalesce("standard", F.lit(""))
    compact = F.coalesce("compact", F.lit(""))
    if mode == "full":
        return F.when(full != "", full).when(standard != "", standard).otherwise(compact), F.when(full != "", "full").when(standard != "", "standard").otherwise("compact")
    if mode == "standard":
        return F.when(standard != "", standard).otherwise(compact), F.when(standard != "", "standard").otherwise("compact")
    return compact, F.lit("compact")


def assembled(rows: DataFrame, budget: int = BUDGET, mode: str = "standard", asked: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The candidates that fit a budget, and what was left out.

    Candidates are taken in order of position. One that doesn't fit in the mode asked
    for is tried again in its compact form; one that fits in neither is passed over
    and later ones may fit. A repeated id counts once. The second frame has reason
    ('duplicate', 'budget', 'not_found' for an asked id without a candidate) and n.
    """
    text, used = by_mode(mode)
    cost = lambda body: tokens_of(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), body))
    again = F.row_number().over(Window.partitionBy("id").orderBy("position"))
    rows = rows.withColumns({"mode": used, "cost": cost(text), "least": cost(by_mode("compact")[0]), "again": again})
    rows = materialize(rows, "candidates")
    once = rows.where("again = 1")
    items = once.agg(F.array_sort(F.collect_list(F.struct("position", "cost", "least", "mode"))).alias("items"))  # the few candidates of one question
    start = F.expr("named_struct('used', 0L, 'kept', cast(array() as array<struct<position:int,tokens:bigint,mode:string>>))")

    def step(acc: Column, item: Column) -> Column:
        whole, short = acc["used"] + item["cost"] <= budget, acc["used"] + item["least"] <= budget
        spent = F.when(whole, item["cost"]).when(short, item["least"]).otherwise(0)
        kept = F.struct(item["position"].cast("int").alias("position"), spent.cast("bigint").alias("tokens"), F.when(whole, item["mode"]).otherwise("compact").alias("mode"))
        return F.struct((acc["used"] + spent).cast("bigint").alias("used"), F.when(whole | short, F.array_append(acc["kept"], kept)).otherwise(acc["kept"]).alias("kept"))

    kept = items.select(F.explode(F.aggregate("items", start, step)["kept"]).alias("k")).select("k.position", "k.tokens", F.col("k.mode").alias("packed_as"))
    taken = materialize(once.drop("cost", "least", "again", "mode").join(kept, "position"), "packet")
    content = F.when(F.col("packed_as") == "full", F.col("full")).when(F.col("packed_as") == "standard", F.col("standard")).otherwise(F.coalesce("compact", F.lit("")))
    taken = taken.withColumn("content", content)
    missing = rows.sparkSession.createDataFrame([(i,) for i in asked], "id string").join(rows.select("id").distinct(), "id", "left_anti")
    left = rows.where("again > 1").select(F.lit("duplicate").alias("reason")).unionByName(once.join(taken, "position", "left_anti").select(F.lit("budget").alias("reason"))).unionByName(missing.select(F.lit("not_found").alias("reason")))
    return taken, left.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def packet(index: Index, question: str, budget: int = BUDGET, mode: str = "standard", **signals) -> DataFrame:
    """position, id, kind, rel_path, start_line, end_line, tokens, packed_as and score of the evidence that fits the budget; signals as in `ranked`."""
    rows = diversified(ranked(index, question, **signals))
    taken, _ = assembled(rows, budget, mode, signals.get("direct_ids", ()))
    last = F.when(F.col("kind") == "source", end_line(F.col("start_line"), F.col("full")))
    return taken.select("position", "id", "kind", "rel_path", "start_line", last.alias("end_line"), "tokens", "packed_as", "score")


def omissions(index: Index, question: str, budget: int = BUDGET, mode: str = "standard", **signals) -> DataFrame:
    """reason and n of what a packet leaves out."""
    return assembled(diversified(ranked(index, question, **signals)), budget, mode, signals.get("direct_ids", ()))[1]


def projection(packed_rows: DataFrame) -> DataFrame:
    """A packet as it is compared and stored: without what changes from one answer to the next."""
    return packed_rows.drop("trace_id", "created_at")


def trace(key: bytes, question: str, mode: str, selected: list[str]) -> dict:
    """What is kept of a question: a keyed digest, never its words."""
    return {"query_hash": hmac.new(key, question.encode(), hashlib.sha256).hexdigest(), "mode": mode, "selected_ids": selected}


def recent(traces: DataFrame, now: str, days: int = 30) -> DataFrame:
    """The traces of the last days."""
    return traces.where(F.col("created_at") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {days} DAYS"))
