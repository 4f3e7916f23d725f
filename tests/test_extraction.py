import pytest

from siftwood.operators import extraction as X

SAMPLES = {
    "go": ("import \"fmt\"\n// Close ends.\nfunc (s *S) Close(a int) error {\n\tif a > 1 && a < 3 { return nil }\n\treturn nil\n}\ntype T struct {\n}\n", {"method:Close", "type:T"}, {"fmt"}),
    "python": ("from a.b import c\nclass A:\n    def f(self):\n        return 1\n", {"class:A", "function:f"}, {"a.b"}),
    "typescript": ("import { x } from './a';\nexport function f(a: string): void {\n}\ninterface I {\n}\nexport class C {\n  go(a: number): void {\n  }\n}\n", {"function:f", "interface:I", "class:C", "method:go"}, {"./a"}),
    "javascript": ("const m = require('./b');\nfunction g(a) {\n}\n", {"function:g"}, {"./b"}),
    "rust": ("use crate::a::b;\nmod c;\npub fn f(a: i32) -> i32 {\n}\nstruct S {\n}\n", {"function:f", "struct:S", "module:c"}, {"crate::a::b", "mod::c"}),
    "java": ("import com.a.B;\npublic class C {\n  public static int f(String a) {\n    return 1;\n  }\n}\n", {"class:C", "method:f"}, {"com.a.B"}),
    "kotlin": ("import a.b.*\nclass A {\n  fun f() {\n  }\n}\nobject O {\n}\n", {"class:A", "function:f", "object:O"}, {"a.b.*"}),
    "ruby": ("require 'a'\nclass A\n  def f?\n  end\nend\n", {"class:A", "method:f?"}, {"a"}),
    "csharp": ("using A.B;\nnamespace N.M\n{\n  public record R {\n  }\n}\n", {"record:R"}, {"A.B"}),
    "php": ("use A\\B;\nclass C {\n  public function f() {\n  }\n}\n", {"class:C", "method:f"}, {"A\\B"}),
    "dart": ("import 'package:a/b.dart';\nclass C {\n}\n", {"class:C"}, {"package:a/b.dart"}),
    "elixir": ("defmodule A.B do\n  alias C.D\n  def f(x) do\n  end\nend\n", {"module:A.B", "function:f"}, {"C.D"}),
    "swift": ("import UIKit\nstruct S {\n  func f() {\n  }\n}\n", {"struct:S", "function:f"}, {"UIKit"}),
    "cpp": ("#include \"a.h\"\nint f(int a) {\n  return 1;\n}\nclass C {\n};\n", {"function:f", "class:C"}, {"a.h"}),
    "lua": ("local m = require(\"a.b\")\nfunction M.f(x)\nend\n", {"function:M.f"}, {"a.b"}),
    "bash": ("source ./a.sh\nf() {\n  echo\n}\n", {"function:f"}, {"./a.sh"}),
    "fish": ("source a.fish\nfunction f\nend\n", {"function:f"}, {"a.fish"}),
    "qml": ("import \"lib\"\nItem {\n  id: root\n  property int n: 1\n  signal done\n}\n", {"qml_id:root", "property:n", "signal:done"}, {"lib"}),
    "css": ("@import 'a.css';\n:root {\n  --c: #fff;\n}\n", set(), {"a.css"}),
    "scss": ("@use 'a';\n$c: #fff;\n", set(), {"a"}),
    "markdown": ("# One\ntext\n## Two\n", {"heading:One", "heading:Two"}, set()),
    "json": ("{\n  \"a\": 1\n}\n", {"setting:a"}, set()),
    "yaml": ("a: 1\n", {"setting:a"}, set()),
    "toml": ("[s]\na = 1\n", {"config_section:s", "setting:a"}, set()),
    "ini": ("[s]\na = 1\n", {"config_section:s", "setting:a"}, set()),
    "hyprlang": ("source = ./a.conf\nbind = SUPER, Q, exec, run.sh\n$x = 1\n", {"keybind:SUPER, Q"}, {"./a.conf"}),
    "plist": ("<key>A</key>\n", {"setting:A"}, set()),
    "pbxproj": ("SDKROOT = ios;\n", {"setting:SDKROOT"}, set()),
    "xcconfig": ("#include \"a.xcconfig\"\nA = 1\n", {"setting:A"}, {"a.xcconfig"}),
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_languages(lang):
    text, symbols, includes = SAMPLES[lang]
    got = X.extract(text, lang)
    assert symbols <= {f"{s['kind']}:{s['name']}" for s in got["symbols"]}
    assert includes == {e["raw"] for e in got["edges"] if e["kind"] == "includes"}


def test_spans_docs_and_complexity():
    close = X.extract(SAMPLES["go"][0], "go")["symbols"][0]
    assert (close["start_line"], close["end_line"], close["complexity"], close["doc"], close["signature"]) == (3, 6, 3, "// Close ends.", "func (s *S) Close(a int) error")
    assert X.doc_sentence("/**\n * Reads it. Then more.\n */") == "Reads it."
    assert X.extract("x", "cobol") == {"symbols": [], "edges": [], "resources": []}


def test_chunks():
    n = lambda spans, lines: X.spans_to_chunks(lines, spans)
    assert n([], 90) == [(1, 40), (41, 80), (81, 90)]
    assert n([(10, 75)], 100) == [(1, 9), (10, 75), (76, 100)]  # a definition of 66 lines stays whole
    assert n([(1, 200)], 200) == [(i, i + 39) for i in range(1, 200, 40)]
    assert n([(1, 5), (6, 10), (11, 30)], 30) == [(1, 30)]
    text = "\n".join(["a"] * 40 + [""] * 40 + ["b"] * 5)
    assert [(c["start_line"], c["end_line"]) for c in X.chunk_text(text, [])] == [(1, 40), (81, 85)]


def test_operator(spark):
    rows = spark.createDataFrame([(1, "go", SAMPLES["go"][0], "x"), (2, None, "a\n\nb", "x"), (3, "go", None, "x"), (4, "go", "", "x")], "file_id long, lang string, text string, symbols string")
    got = X.extracted(rows)
    assert X.table_of(got, "symbols").count() == 2
    assert {(r.file_id, r.text) for r in X.table_of(got, "chunks").collect() if r.file_id > 1} == {(2, "a\n\nb")}
    assert X.extracted(rows.limit(0)).count() == 0


def test_sentences_of_docs_with_many_lines(spark, tmp_path):
    from siftwood.plans import texts

    rows = [(1, "// Reads it. Then more."), (2, "/**\n * Reads it\n * twice. Then more.\n */"), (3, "# One\n#\n# Two."), (4, None)]
    spark.createDataFrame(rows, "symbol_id long, doc string").write.parquet(str(tmp_path / "symbols.parquet"))
    got = {r.symbol_id: r.sentence for r in texts.QUERIES["d04_sentences"](spark, str(tmp_path)).collect()}
    assert got == {1: "Reads it.", 2: "Reads it twice.", 3: "One"}


def test_symbols_go_on_over_chunks(spark, tmp_path):
    from siftwood.plans import texts

    go = ["package a", "func Close(a int) error {", "\tif a > 1 {", "\t\treturn nil", "\t}", "", "\tfor a < 3 && a > 0 {", "\t}", "}", "func Open() {", "}"]
    cuts = [(1, 1, 4), (2, 5, 5), (3, 7, 8), (4, 9, 11)]  # the blank line 6 is left out
    rows = [(c, 7, a, "".join(x + "\n" for x in go[a - 1 : b])) for c, a, b in cuts]
    rows += [rows[0], (9, 8, 41, "def f():\n    if x:\n"), (10, 8, 43, "        return 1 or 2\n")]
    spark.createDataFrame(rows, "chunk_id long, file_id long, start_line int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    files = [(7, "go", 1, 1, "h"), (8, "python", 1, 1, "h")]
    spark.createDataFrame(files, "file_id long, lang string, indexed_at int, size int, hash string").write.parquet(str(tmp_path / "files.parquet"))
    got = sorted(tuple(r) for r in texts.QUERIES["x01_extracted"](spark, str(tmp_path)).select("chunk_id", "name", "start_line", "end_line", "complexity").collect())
    assert got == [(1, "Close", 2, 9, 4), (4, "Open", 10, 11, 1), (9, "f", 41, 43, 3)]
