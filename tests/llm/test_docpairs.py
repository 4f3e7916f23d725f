import pytest

from siftwood.llm import docpairs as D

NOTHING = [
    None, "", "  ", "//", "/** */", "/**\n * \n */", "# ---- scope ----", "// === headers ===", "// #region x", "// endregion", "// {{{ anchor", "// MARK: - panel",
    "// TODO", "# tbd", "/** n/a */", "// TODO(sable): write this comment", "FIXME add docs", "// No description provided.", "// Auto-generated method stub", "// nolint:errcheck", "# noqa: E501",
    "// eslint-disable-next-line no-undef", "# pylint: disable=R0913", "// @ts-ignore", "//go:noinline", "/** {@inheritDoc} */", "// @override", "// SPDX-License-Identifier: MIT",
    "// Copyright 2014 The lib Authors", "/* (c) 2021 Some Works. All rights reserved. */", "// return keymap(layout);", "// if (query == null) { return; }", "# for f in c: print(f)", "// x = source[graph]",
    "// log.debug(target)\n// stream += 1", "// See above.", "// (see base class)", "/** @param import */", "// @param {string} schema", "// @param query\n// @return", "// @param widget the widget",
    ":param report:\n:return:", "Args:\n    pattern:\nReturns:", "/// <summary></summary>", "/// <param name=\"b\"></param>", "// parseTableRow()", "// Parses table row", "/** The parse table row method. */",
    "// parseTableRow: parse table row", "// . ", "!!!",
]
SOMETHING = [
    "// Caller owns the import.", "# O(n) in the number of caches.", "// TODO: speed this up. Compares the buffer line by line.", "// nolint is fine here because the buffer is closed by the caller.",
    "// Copyright lines are kept: only the file below them is touched.", "// See the guide: a packet never outlives its file, so we copy here.", "// -----\n// Orders windows by panel.\n// -----",
    "/** @returns the hidden vector, never null */", "// :param chunk: the lexeme to start from", "Args:\n    edge: the page to look at\nReturns:\n    how many chunks were dropped",
    "// 壊れた行を読み飛ばして残りを返す。", "// Проверяет, что catalog ещё жив.", "/// <summary>Closes the pool.</summary>", "// Deprecated: use the warm cache instead, this one drops packets.",
    "Returns nil when the module is gone.\r\nHolds the lock.", "// FIXME(quill): slow. Joins each graph with its config.", "x" * 20000,
]


@pytest.mark.parametrize("doc", NOTHING)
def test_says_nothing(doc):
    assert D.statements(doc, "parseTableRow") == []


@pytest.mark.parametrize("doc", SOMETHING)
def test_says_something(doc):
    assert D.statements(doc, "parseTableRow")


def test_islands():
    python = '@cached\ndef load(a, b=2):\n    """Reads it twice."""\n    return a\n\n\nx = 1\n\n# Adds them up.\ndef add(a):\n    if a:\n        return 1\n    return 2\n'
    assert D.islands(python, "python") == [("load", "def load(a, b=2)", '"""Reads it twice."""', 1, 3), ("add", "def add(a)", "# Adds them up.", 9, 12)]
    go = "// Close ends it.\n// Twice is fine.\nfunc (s *Store) Close(a int) error {\n\tif a > 1 {\n\t\treturn nil\n\t}\n\treturn nil\n}\nvar x = 1\n"
    assert D.islands(go, "go") == [("Close", "func (s *Store) Close(a int) error", "// Close ends it.\n// Twice is fine.", 2, 7)]
    assert D.islands("/** Makes one. */\npublic static int make(String a) {\n  return 1;\n}\n", "java")[0][:3] == ("make", "public static int make(String a)", "/** Makes one. */")
    assert D.islands("x", "cobol") == [] and D.islands("", "go") == []


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "symbol_id long, name string, kind string, signature string, doc string, description string")


def test_pairs(spark):
    doc = "// Caller owns it."
    rows = [(1, "a", "function", "a()", doc), (1, "a", "function", "a()", doc), (2, "a", " METHOD ", "a()", doc), (3, "a", "class", "a()", doc), (4, "a", "method", None, doc)]
    rows += [(5, None, "method", "a()", doc), (6, "a", None, "a()", doc), (7, "a", "function", "a()", None), (8, "a", "function", "a()", "// TODO"), (9, "a", "Function", "", doc)]
    assert sorted(r.symbol_id for r in D.pairs(frame(spark, rows)).collect()) == [1, 2, 5, 9]
    assert D.pairs(frame(spark, rows)).where("symbol_id = 1").collect()[0].description == "Caller owns it."
    assert D.pairs(frame(spark, [])).count() == 0
    chunks = spark.createDataFrame([(1, 7, 5, "# Adds them up.\ndef add(a):\n    return 2\n"), (2, 7, None, None), (3, 8, 1, "# Adds.\ndef b(): pass")], "chunk_id long, file_id long, start_line int, text string")
    files = spark.createDataFrame([(7, "python", "2024"), (7, "", "2023"), (8, None, "2024")], "file_id long, lang string, indexed_at string")
    assert [(r.name, r.start_line, r.end_line) for r in D.source_pairs(chunks, files).collect()] == [("add", 6, 7)]


def test_source_pairs_go_on_over_chunks(spark):
    go = ["/* Closes the store", "for good. */", "func Close(a int) error {", "\tif a > 1 {", "\t\treturn nil", "\t}", "", "\treturn nil", "}", "// Opens it again.", "func Open() {", "\tx()"]
    cuts = [(1, 1, 1), (2, 2, 2), (3, 3, 4), (4, 5, 6), (5, 8, 10), (6, 11, 12)]  # the blank line 7 is left out
    rows = [(c, 7, a, "".join(x + "\n" for x in go[a - 1 : b])) for c, a, b in cuts]
    rows += [rows[2], (9, 8, 3, "func Other() {\n}\n"), (10, 7, None, "}\n")]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_id long, start_line int, text string")
    files = spark.createDataFrame([(7, "go", "2024"), (8, "go", "2024")], "file_id long, lang string, indexed_at string")
    got = sorted((r.chunk_id, r.name, r.description, r.start_line, r.end_line) for r in D.source_pairs(chunks, files).collect())
    assert got == [(3, "Close", "Closes the store\nfor good.", 3, 9), (6, "Open", "Opens it again.", 11, 12)]


def test_source_pairs_without_lang(spark):
    text = "# Adds them up.\ndef add(a):\n    return 2\n"
    chunks = spark.createDataFrame([(i, i, 1, text) for i in range(1, 6)], "chunk_id long, file_id long, start_line int, text string")
    rows = [(1, "r/a.py", "", 2), (1, "r/a.txt", "go", 1), (2, "r/b.PY", None, 1), (3, "r/c.py", "  ", 1), (4, "r/d.txt", "", 1), (5, "r/e.py", "markdown", 1)]
    files = spark.createDataFrame(rows, "file_id long, rel_path string, lang string, indexed_at int")
    assert sorted(r.chunk_id for r in D.source_pairs(chunks, files).collect()) == [1, 2, 3]
