from siftwood.llm import provenance as P

CODE = "import a\n\nfunc one(x int) int {\n    y := x + 1\n    if y > 2 {\n        return y\n    }\n    return helper(x, \"text\")\n}\n" * 3


def test_heads():
    for head in (
        "// Code generated by tool. DO NOT EDIT.", "# @generated by x 2.3", "// <auto-generated> x 1 </auto-generated>", "// AUTOGENERATED FILE - changes will be lost", "// This file was automatically generated by x",
        "// Generated by the x compiler, do not modify", "// Output of x. Hand edits get overwritten.", "// THIS IS GENERATED CODE. Run `make a` to refresh.", "// DO NOT MODIFY: produced by x from y.idl",
        "// Fichier généré automatiquement par x, ne pas modifier", "// Diese Datei wurde automatisch erzeugt (x)", "// Automatically created from a.schema on 2024-01-12",
    ):
        assert P.notice(P.head(head + "\n" + CODE)[0]), head
        assert P.notice(P.head("// Copyright 2022 The repo Authors.\n\n" + head + "\n" + CODE)[0]), head
    for text in ('const mark = "Code generated by x. DO NOT EDIT."\n', "// Auto-generated method stub\nfunc a() {}", CODE + "// Code generated by x. DO NOT EDIT.\n", "// Do not patch the batch by hand; the next run overwrites it.\n"):
        assert not P.notice(P.head(text)[0]), text
    for head in (
        "// pkgcore v2.14.3 | (c) 2019 Some Labs | MIT License | https://pkgcore.example", "// pkgcore.js - 5.16.9\n// https://code.example/pkgcore\n// Copyright Some Works; Licensed Apache-2.0", "# @license pkgcore 3.1.2\n# Copyright (c) X",
        "// This file is part of pkgcore 4.12.1, Copyright (C) 2015 X.", "// Imported from https://code.example/pkgcore at tag 5.3.7, unmodified. (c) X",
    ):
        assert P.released(P.head(head + "\n" + CODE)[0]) == "pkgcore", head
    for head in ("// Copyright 2022 The raven-scope-00000 Authors. All rights reserved.", "// SPDX-License-Identifier: MIT", "// Licensed under the terms in LICENSE at the root of raven-scope-00000.", "// Pinned to pkgcore@3.22.8 for now."):
        assert P.released(P.head(head + "\n" + CODE)[0]) is None, head


def test_reasons(spark):
    minified = "function a(b){return b?c(d,1):e}for(f=0;f<g.length;f++)h(g[f]);" * 40
    table = "x = [\n" + "  0x15, 0x78, 0xf8, 0x72, 0x29, 0xdd,\n" * 60 + "]\n"
    files = [
        (1, "r-1/src/a.go", "go", CODE), (2, "r-1/node_modules/p/a.go", "go", CODE), (3, "r-1/lib/a.js", "javascript", minified), (4, "r-1/src/generated/a.go", "go", CODE),
        (5, "r-1/a/package-lock.json", "json", "{}"), (6, "r-1/src/t.py", "python", table), (7, "r-1/src/t.json", "json", table), (8, "r-1/src/generators/a.go", "go", CODE),
        (9, "r-1/src/a_gen.go", None, CODE), (10, "r-1/empty.go", "go", None), (11, "r-1/src/b.css", "", ".a{color:#fff;margin:1px}" * 60), (12, "r-1/src/external_ids/a.go", "go", CODE),
        (13, "r-1/src/x.go", "go", "// pkg v1.2.3 | (c) 2019 X | MIT License\n" + CODE), (14, "r-1/src/dist/distance.py", "python", CODE), (15, None, "go", CODE), (16, "r-1/vendors/vendor_a.go", "go", CODE),
    ]
    f = spark.createDataFrame([(i, p, lang, None, 1, "2024", "x") for i, p, lang, _ in files] + [(1, "r-1/src/a.go", "go", None, 1, "2023", "x")], "file_id long, rel_path string, lang string, role string, size long, indexed_at string, reason string")
    c = spark.createDataFrame([(i * 10, i, 1, t) for i, _, _, t in files] + [(60, 6, 1, table), (999, None, 1, table), (998, 77, None, table)], "chunk_id long, file_id long, start_line int, text string")
    got = {r.file_id: r.reason for r in P.found(f, c).collect()}
    assert got == {2: "vendored", 3: "minified", 4: "generated", 5: "generated", 6: "data", 9: "generated", 11: "minified", 13: "vendored"}
    assert P.classified(f, c).count() == 16
    assert P.found(f.limit(0), c).count() == 0
    assert {r.file_id for r in P.found(f, c.limit(0)).collect()} == {2, 4, 5, 9}


def test_heads_of_any_length_over_many_chunks(spark):
    mark = "// Code generated by tool. DO NOT EDIT.\n"
    assert P.notice(P.head("\n" * 45 + mark + CODE)[0])
    assert P.notice(P.head("// a licence line\n" * 90 + mark + CODE)[0])
    files = spark.createDataFrame([(1, "r-1/a.go", "go", None, 1, "x"), (2, "r-1/b.go", "go", None, 1, "x"), (3, "r-1/c.go", "go", None, 1, "x"), (4, "r-1/d.go", "go", None, 1, "x")], "file_id long, rel_path string, lang string, role string, size long, indexed_at string")
    chunks = [(1, 1, 1, "// a licence line\n" * 60), (2, 1, 61, mark + CODE), (3, 2, 1, CODE), (4, 2, 40, mark + CODE), (5, 3, 1, "/* a\n" + "b\n" * 50), (6, 3, 52, "c\n*/\n" + mark + CODE), (7, 4, 5, mark + CODE), (7, 4, 5, mark + CODE)]
    got = {r.file_id: r.reason for r in P.found(files, spark.createDataFrame(chunks, "chunk_id long, file_id long, start_line int, text string")).collect()}
    assert got == {1: "generated", 3: "generated", 4: "generated"}


def test_canonical_layout():
    assert P.emitted("func a(x int) {\n  if x > 2 { return y }\n  for (;;) { f(x); }\n}\n") == [
        (0, "func a(x int) {"), (1, "if x > 2 {"), (2, "return y"), (1, "}"), (1, "for (;;) {"), (2, "f(x);"), (1, "}"), (0, "}"),
    ]
    lua = "local function a(x)\n  if x then return y else z() end\nend"
    assert [x for _, x in P.emitted(lua)] == ["local function a(x)", "if x then", "return y", "else", "z()", "end", "end"]
    assert [x for _, x in P.emitted("a = 1; b = f(1,\n 2); c = 3\nd = 4")] == ["a = 1;", "b = f(1,\n 2);", "c = 3", "d = 4"]
    for text, big in ((CODE, False), ("x=1;y=f(x);z=g(y,x);" * 60, True), ("if a then b() else c() end " * 40, True), ("const t = [" + "0x12, 0x34, 'ab', " * 400 + "];", False)):
        lines, canonical, *_ = P.profile(text)
        assert (canonical / lines >= P.EXPANSION) == big, text[:30]
    lines, _, _, _, regular = P.profile(CODE)
    assert lines == regular


def test_long_odd_texts_take_no_more_than_their_length():
    import time

    from siftwood.llm import docpairs, pii, secrets

    n = 100_000
    for text in ("a" * n, "password" + " " * n + "=x", '"\\' * (n // 2), " " * n + "x", "1-" * (n // 2), "Abc " * (n // 4), "a@" * (n // 2), "f(" * (n // 2), "-----BEGIN RSA PRIVATE" + " KEY-----\n" * (n // 12), "\n" * n, "'\\" * (n // 2), "{;" * (n // 2), "\"" * n, "," * n, "do end " * (n // 7)):
        for work in (secrets.scan, pii.observe, P.profile, P.head, lambda t: docpairs.statements(t, "x"), lambda t: docpairs.islands(t, "java")):
            began = time.process_time()
            work(text)
            assert time.process_time() - began < 8, text[:20]
