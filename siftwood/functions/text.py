"""Terms of questions and texts, snippets, edit distance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words that carry nothing, by purpose ----
SEARCH_STOP = ("the", "a", "an", "of", "to", "in", "is", "for", "and", "or", "on", "with")
QUESTION_STOP = (
    "the", "a", "an", "of", "to", "in", "on", "is", "are", "was", "were", "be", "for", "and", "or", "with", "how", "does", "do", "where", "what", "when", "why", "which",
    "that", "this", "it", "by", "from", "as", "at", "into",
)
ENDINGS = ("ing", "ers", "er", "ed", "es", "s")
# ---- end of fixed values ----


def search_terms(question: str) -> list[str]:
    """The terms of a search in their order: shorter than two bytes and stop words dropped, repeats kept."""
    return [t for t in question.split() if len(t.encode()) >= 2 and t.lower() not in SEARCH_STOP]


def question_terms(question: str) -> list[str]:
    """The distinct terms of a question in order of the alphabet, punctuation around them dropped."""
    terms = {t.strip(".,:;!?()[]{}\"'`") for t in question.lower().split()}
    return sorted(t for t in terms if len(t) > 1 and t not in QUESTION_STOP)


def stemmed(term: str) -> str:
    """A term without one common ending, if four letters stay."""
    for ending in ENDINGS:
        if term.endswith(ending) and len(term) - len(ending) >= 4:
            return term[: -len(ending)]
    return term


def concept_terms(question: str, stop: tuple[str, ...] = QUESTION_STOP) -> list[str]:
    """The runs of letters and digits of a question with their stems, three characters at least, each once."""
    out: list[str] = []
    for run in re.findall(r"[a-z0-9]+", question.lower()):
        if len(run) >= 3 and run not in stop:
            out += [v for v in (run, stemmed(run)) if len(v) >= 3]
    return list(dict.fromkeys(out))


def tokens(text: Column) -> Column:
    """The runs of letters and digits of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def concept_score(terms: list[str], path: Column) -> Column:
    """For each term 2 if the name of the file holds it, 1 if the rest of its path does."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    score = F.lit(0)
    for t in terms:
        score = score + F.when(name.contains(t), 2).when(low.contains(t), 1).otherwise(0)
    return score


def occurrences(text: Column, term: str) -> Column:
    """How often a fixed string stands in a text, without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)


def lexical_score(terms: list[str], text: Column) -> Column:
    """5 for each occurrence of a term, up to three of each."""
    low, score = F.lower(text), F.lit(0)
    for t in terms:
        score = score + F.least(F.lit(3), occurrences(low, t)).cast("int") * 5
    return score


def snippet(text: Column, terms: list[str], pad: int = 60) -> Column:
    """The text around the first term found, pad characters to each side."""
    low = F.lower(text)
    places = [F.when(F.instr(low, t) > 0, F.instr(low, t)) for t in terms]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.lit(1), at - pad)
    return F.substring(text, start, 2 * pad)


def osa(a: str, b: str) -> int:
    """The restricted edit distance: insert, delete, replace, and swap of neighbours, each part edited once."""
    rows = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        row = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, rows[-2][j - 2] + 1)
            row[j] = best
        rows.append(row)
    return rows[-1][-1]


def osa_to(query: str):
    """A column function: the restricted edit distance of a column to query."""

    @F.pandas_udf("int")
    def distance(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else osa(n, query))

    return distance
