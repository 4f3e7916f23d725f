import datetime
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwood.engine import Engine, index_tree
from siftwood.operators import fusion, graph, health, packets, redaction, vectors, webdocs
from siftwood.operators import knowledge as N
from siftwood.functions import text as X
from siftwood.sinks import formats, store
from siftwood.sources import manifests, tree
from siftwood.streaming import events, refresh

TREE = {
    "auth/main.go": "package auth\nimport \"ex.org/m/policy\"\n// Login checks a user.\nfunc Login(a int) error {\n\treturn nil\n}\n",
    "policy/p.go": "package policy\nfunc Allow() bool {\n\treturn true\n}\n",
    "web/a.ts": "import { b } from './b';\nexport function one(x: string): void {\n}\n",
    "web/b.ts": "export function two(): void {\n}\n",
    "scripts/run.sh": "source ./lib.sh\n",
    "scripts/lib.sh": "f() {\n  echo\n}\n",
    "README.md": "# Title\n",
}


def arrived(spark, texts, at=datetime.datetime(2024, 1, 1)):
    return spark.createDataFrame([(p, t, at) for p, t in texts.items()], refresh.ARRIVING)


def test_walk_and_ignores(spark, tmp_path):
    for p in ("a.py", "node_modules/x.js", "sub/b.min.js", "sub/c.log", "sub/keep.log", "build/d.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    rows = tree.walked(tree.files_below(spark, str(tmp_path)))
    assert {r.rel_path for r in rows.collect()} == {"a.py", "sub/c.log", "sub/keep.log", "build/d.py"}
    assert tree.texts(rows).where("text = 'x = 1\n'").count() == 4
    ignored = tree.patterns(spark, [("", "*.log\n# note\nbuild/\n"), ("sub", "!keep.log\n")])
    assert {r.rel_path for r in tree.kept(rows, ignored).collect()} == {"a.py", "sub/keep.log"}
    assert {r.rel_path for r in tree.kept(rows, tree.patterns(spark, [], ("/sub/*.log",))).collect()} == {"a.py", "build/d.py"}
    text = spark.createDataFrame([("a <!-- x -->\nb\n<!-- /x -->\nc",)], "t string").select(tree.without_blocks(F.col("t"), "<!-- x -->", "<!-- /x -->").alias("t"))
    assert text.first().t == "a c"


def test_working_state(spark):
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "rel_path string")
    got = {r.rel_path: (r.staged, r.unstaged, r.untracked) for r in tree.working_state(one("a", "b"), one("b"), one("c")).collect()}
    assert got == {"a": (True, False, False), "b": (True, True, False), "c": (False, False, True)}


def test_manifests():
    m = manifests.read({
        "go.mod": "module ex.org/m\n", "crates/c/Cargo.toml": '[package]\nname = "my-c"\n', "web/k/package.json": '{"name": "@k/kit"}', "d/pubspec.yaml": "name: app\n",
        "tsconfig.json": '{ // note\n "extends": "./base.json", "compilerOptions": {"paths": {"@/*": ["src/*"],}}}', "base.json": '{"compilerOptions": {"paths": {"~/*": ["lib/*"]}}}',
    })
    assert (m.go_module, m.crates, m.ts_packages, m.dart_packages) == ("ex.org/m", {"my_c": "crates/c/src"}, {"@k/kit": "web/k"}, {"app": "d"})
    assert m.ts_aliases == [(".", {"~/": ["lib"], "@/": ["src"]})]
    assert manifests.rules('[[forbid]]\nname = "n"\nfrom = "a"\nto = "b"\n') == [("n", "a", "b")]
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
    assert manifests.tensors(struct.pack("<Q", len(head)) + head + np.array([1, 2], np.float32).tobytes())["w"].tolist() == [1, 2]


def test_index_refresh_and_engine(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        s.current()
    m = manifests.read({"go.mod": "module ex.org/m\n"})
    assert index_tree(s, arrived(spark, TREE), manifests=m)
    first = s.about()["generation"]
    assert not index_tree(s, arrived(spark, TREE), manifests=m) and s.about()["generation"] == first
    assert {r.kind for r in s.table("edges").where("resolved").collect()} >= {"includes", "pkg"}
    assert refresh.refresh(s, arrived(spark, {"web/b.ts": "export function three(): void {\n}\n"}), m, gone=spark.createDataFrame([("README.md",)], "rel_path string"))
    names = {r.name for r in s.table("symbols").collect()}
    assert {"three", "one", "Login"} <= names and not {"two", "Title"} & names
    assert s.table("files").count() == 6
    s.append("counters", spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "name string, n long"))
    assert {(r.name, r.total) for r in store.counters(s.log("counters")).collect()} == {("a", 3), ("b", 5)}
    vocabulary = {"[UNK]": 0, "func": 1, "##tion": 2, "return": 3}
    embed = vectors.embedder(vocabulary, np.eye(4), np.ones(4))
    n = refresh.drain_backlog(s, embed)
    assert n == s.table("chunks").count() and refresh.drain_backlog(s, embed) == 0


def test_stream_keeps_the_index_fresh(spark, tmp_path):
    inbox, s = str(tmp_path / "in"), store.Store(spark, str(tmp_path / "index"))
    arrived(spark, TREE).write.parquet(inbox)
    refresh.keep_fresh(s, refresh.arriving(spark, inbox), str(tmp_path / "check")).awaitTermination()
    assert s.table("files").count() == len(TREE)
    arrived(spark, {"new.py": "def f():\n    return 1\n"}).write.mode("append").parquet(inbox)
    refresh.keep_fresh(s, refresh.arriving(spark, inbox), str(tmp_path / "check")).awaitTermination()
    assert s.table("files").count() == len(TREE) + 1
    assert refresh.same_tree(s.table("files"), s.table("files")) and not refresh.same_tree(s.table("files"), s.table("files").limit(1))


def test_event_windows(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m % 60) + datetime.timedelta(hours=m // 60)
    rows = spark.createDataFrame([(1, t(0), 1.0), (1, t(20), 1.0), (1, t(90), 2.0), (2, t(5), 4.0)], "user_id long, ts timestamp, value double").withColumn("event_type", F.lit("x"))
    assert {(r.user_id, r.n) for r in events.sessions(rows).collect()} == {(1, 2), (1, 1), (2, 1)}
    assert events.sliding_counts(rows).where("n = 4").count() == 5
    rows.write.parquet(str(tmp_path / "in"))
    events.to_table(events.window_counts(events.stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"), "complete").awaitTermination()
    assert {(r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(3, 6.0), (1, 2.0)}


def test_graph_fixtures(spark):
    links = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (2, 5), (9, 9), (9, 77)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    got = {r.id: r for r in graph.pagerank(nodes, links, rounds=12).collect()}
    assert max(got, key=lambda i: got[i].score) == 1 and got[1].in_degree == 3 and got[5].in_degree == 1
    assert abs(sum(r.score for r in got.values()) - 1) < 1e-9
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 1)], "src long, dst long")
    assert {r.id for r in graph.circles(chain).collect()} == {1, 2, 3}
    start = spark.createDataFrame([(5,)], "id long")
    assert {(r.id, r.depth) for r in graph.reach(chain, start).collect()} == {(1, 1), (2, 2), (3, 3)}
    parts = {r.id: r.component for r in graph.components(spark.range(1, 8), chain.union(spark.createDataFrame([(7, 6)], "src long, dst long"))).collect()}
    assert parts == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 6}
    assert graph.circles(chain.limit(0)).count() == 0 and graph.pagerank(nodes.limit(0), links).count() == 0


def test_text_helpers(spark):
    assert X.osa("ca", "abc") == 3 and X.osa("ab", "ba") == 1 and X.osa("", "x") == 1
    assert X.search_terms("the Cache of a b it") == ["Cache", "it"] and X.question_terms("How does the (cache) cache?") == ["cache"]
    assert X.concept_terms("downloaders") == ["downloaders", "download"]
    key = spark.createDataFrame([("SUPER, Q",), ("q + super",)], "k string").select(health.canonical_key(F.col("k")).alias("k"))
    assert {r.k for r in key.collect()} == {"q+super"}


def test_redaction():
    key, begin, end = "AKIA" + "QWERTYUIOPASDFGH", "-----BEGIN RSA PRIVATE" + " KEY-----", "-----END RSA PRIVATE" + " KEY-----"
    assert redaction.redact_text(f"a {key} b") == ("a [redacted] b", 1)
    for text in ("user:pass@", "https://u:<password>@h", "https://u:${DB_PASSWORD}@h", "sk-fading-circle-wrapper-inner", f"see {begin} and {end}", "API_KEY=Zx81kPq0"):
        assert redaction.redact_text(text) == (text, 0)
    full = f"x = 1\n{begin}\nMIIEabcd\n{end}\ny = 2\n"
    done, n = redaction.redact_text(full)
    assert n == 1 and done == f"x = 1\n{begin}\n[redacted]\n{end}\ny = 2\n" and redaction.redact_text(done) == (done, 0)
    assert redaction.redact_text(f"a\n{begin}\nMIIEabcd\n") == (f"a\n{begin}\n[redacted]", 1) and redaction.redact_text(f"MIIEabcd\n{end}\nb") == (f"[redacted]\n{end}\nb", 1)


def test_redaction_over_chunks(spark):
    begin, end = "-----BEGIN RSA PRIVATE" + " KEY-----", "-----END RSA PRIVATE" + " KEY-----"
    rows = spark.createDataFrame([(1, 1, 1, f"{begin}\nMIIEabcd\n"), (2, 1, 3, "QWERabcd\n"), (3, 1, 4, f"ZZZZabcd\n{end}\n"), (4, 1, 6, "x = 1\n"), (5, 2, 1, "QWERabcd\n")], "chunk_id long, file_id long, start_line int, text string")
    got = {r.chunk_id: (r.text, r.n) for r in redaction.redact_chunks(rows).collect()}
    assert got[2] == ("[redacted]", 1) and got[4] == ("x = 1\n", 0) and got[5] == ("QWERabcd\n", 0) and got[1][1] == got[3][1] == 1


def test_fusion_and_recall(spark):
    lists = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("b", 1, 1), ("c", 1, 2)], "k string, list_no int, rank int")
    assert [r.k for r in fusion.reciprocal_rank(lists, "k").collect()] == ["b", "a", "c"]
    base = spark.createDataFrame([(f"b{i}", i) for i in range(1, 13)], "k string, position int")
    docs = spark.createDataFrame([("b3", 0, 1), ("t", 1, 2), ("s", 0, 3)], "k string, tier int, position int")
    got = {r.position: r.k for r in fusion.doc_recall(base, docs, "k").collect()}
    assert [got[i] for i in range(1, 15)] == [f"b{i}" for i in range(1, 11)] + ["s", "t", "b11", "b12"]
    assert fusion.parse_order([2, 2, 9], 3) == [2, 0, 1] and fusion.order_scores([0, 0], 2) is None and fusion.order_scores([1, 0], 2) == [0.5, 1.0]


def test_packing_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 60), (2, 50), (3, 40)], "position int, tokens int")
    assert {r.position for r in packets.packed(rows, 100).collect()} == {1, 3}
    assert packets.trace(b"k", "q", "compact", [])["query_hash"] != packets.trace(b"k2", "q", "compact", [])["query_hash"]


def test_pages(spark):
    html = "<html><head><title>T</title></head><body><nav>no</nav><main><h1>Heading</h1><p>Body <a href='/b#x'>l</a> <b>x</b></p><ul><li>one</li></ul><pre>a\n b</pre></main><footer>f</footer></body></html>"
    rows = spark.createDataFrame([(1, "https://x.example/a/", html), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in webdocs.pages(rows).collect()}
    assert got[1].title == "Heading" and got[1].links == ["https://x.example/b"] and got[2].markdown == ""
    assert got[1].markdown == "# Heading\n\nBody [l](/b#x) **x**\n\n- one\n\n```\na\n b\n```"
    rules = webdocs.robots("User-agent: *\nDisallow: /private\nDisallow: /admin\nAllow: /public\n\nUser-agent: x\nDisallow: /\n")
    assert rules == (["/private", "/admin"], ["/public"])
    ok = spark.createDataFrame([("/private/x",), ("/public/page",), ("/",)], "p string").select("p", webdocs.permitted(F.col("p"), *rules).alias("ok"))
    assert {r.p: r.ok for r in ok.collect()} == {"/private/x": False, "/public/page": True, "/": True}
    table = spark.createDataFrame([("https://x.example/a/", ["https://x.example/a/b", "https://y.example/a/z"]), ("https://x.example/a/b", ["https://x.example/a/"]), ("https://x.example/c", [])], "url string, links array<string>")
    assert {(r.url, r.depth) for r in webdocs.crawl(table, "https://x.example/a/").collect()} == {("https://x.example/a/", 0), ("https://x.example/a/b", 1)}


def test_anchors_and_lint(spark):
    body = "one\ntwo\nthree\nfour\n"
    digest = lambda *x: "sha256:" + __import__("hashlib").sha256("\n".join(x).encode()).hexdigest()
    sources = spark.createDataFrame([("a.py", body), ("b.py", "x\n\n" + body), ("c.py", "changed\n")], "path string, text string")
    rows = [(1, "a.py", 2, 3, digest("two", "three")), (2, "b.py", 2, 3, digest("two", "three")), (3, "c.py", 1, 1, digest("one")), (4, "gone.py", 1, 1, "x"), (5, "../x", 1, 1, "x"), (6, "a.py", 9, 9, "x")]
    anchors = spark.createDataFrame(rows, "anchor_id long, path string, first int, last int, hash string")
    checks = N.checked(anchors, sources)
    assert {r.anchor_id: (r.status, r.moved_to) for r in checks.collect()} == {1: ("current", None), 2: ("moved", 4), 3: ("stale", None), 4: ("missing", None), 5: ("invalid", None), 6: ("invalid", None)}
    assert {r.anchor_id: r["first"] for r in N.repaired(anchors, checks).collect()}[2] == 4
    assert N.relocate("a\nb\na\n", digest("a"), 1, 2) == 3
    docs = spark.createDataFrame([
        ("a.md", "1", "accepted", None, None, None, [], "[b](b.md) [c](no.md)"), ("b.md", "1", "draft", "2024-02-01", "2024-01-01", "nope", [], "x"), ("c.md", "2", "draft", "bad", None, "https://x", [], "y"),
    ], "path string, id string, status string, valid_from string, valid_to string, resource string, related array<string>, body string")
    got = {(r.code.split(".")[1], r.path) for r in N.lint(docs, checks.select("path", "status").limit(0)).collect()}
    assert got == {("duplicate_id", "b.md"), ("contradiction", "b.md"), ("invalid_temporal_range", "b.md"), ("invalid_temporal_range", "c.md"), ("invalid_resource", "b.md"), ("broken_link", "a.md"), ("missing_evidence", "a.md"), ("orphan", "c.md")}
    fields, raw, text = N.front_matter("---\nid: 'x'\ntags:\n  - a\n---\nbody\n")
    assert fields["id"] == "x" and text == "body\n" and N.with_front_matter(raw, text) == "---\nid: 'x'\ntags:\n  - a\n---\nbody\n"
    done = {}
    assert N.decide(1, 1, "accepted", "k", done) == N.decide(7, 1, "rejected", "k", done) == {"decision": "accepted", "version": 2}
    with pytest.raises(ValueError):
        N.decide(2, 1, "accepted", "other", done)


def test_formats():
    rows = [{"a": 1, "b": "x,y"}, {"a": None, "b": "z"}]
    assert formats.as_table(rows) == 'rows[2]{a,b}:\n  1,"x,y"\n  null,z' and formats.as_table([]) == "rows[0]:"
    assert formats.as_markdown(rows).splitlines()[0] == "| a | b |"
    finding = {"check": "c", "severity": "warn", "rel_path": "p", "line": None, "detail": "d"}
    assert json.loads(formats.as_sarif([finding]))["runs"][0]["results"][0]["level"] == "warning"
    assert not formats.failed([finding]) and formats.failed([finding], "warn")
    assert '"a" -> "b";' in formats.as_graph([("a", "b")]) and "90/100" in formats.as_badge(90)


def test_engine_over_the_tables(spark, folder):
    e = Engine(spark, folder)
    path = e.index.files.orderBy("rel_path").first().rel_path
    name = e.index.symbols.where("kind = 'function'").orderBy("symbol_id").first().name
    for df in (e.find(name), e.definition(name), e.span(name), e.outline(path), e.peek(path, 1, 5), e.search("session cache"), e.relations(path), e.tests(path), e.status(), e.context("session cache")):
        assert df.columns and df.count() >= 0
    assert e.find(name).where(F.col("name") == name).count() >= 1
    assert e.dangling().count() > 0 and e.hierarchy().count() > 0
