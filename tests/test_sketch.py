from siftwood.operators import knowledge as N
from siftwood.operators import sketch as Y


def test_readers():
    assert Y.sketch("Item {\n  text: 'a'\n  width: 3\n  NumberAnimation on x {\n    to: 1\n  }\n  Text {\n    color: red\n  }\n}\n", "qml") == "Item [width=3 text='a']\n  * NumberAnimation on x\n  Text [color=red]"
    assert Y.sketch("return <div className=\"a\" key={1}><b>Hi</b><Icon name='x' /></div>", "tsx") == "div [className=a]\n  b [text=Hi]\n  Icon [name=x]"
    assert Y.sketch("struct V: View {\n  var body: some View {\n    VStack {\n      Text(\"a\")\n        .padding(4)\n        .onTapGesture {\n        }\n    }\n  }\n}\n", "swift").splitlines()[:3] == ["V", "  VStack", "    Text [padding=4 text=\"a\"]"]
    assert Y.sketch("accent := lipgloss.Color(\"#fff\")\nbox := lipgloss.NewStyle().Bold(true).Padding(1)\n", "go") == "accent [color=#fff]\nbox [Bold=true Padding=1]"
    assert Y.sketch(":root { --a: 1px; --a: 2px; }\n.x { color: red; }\n", "css") == "tokens [--a=1px]\n.x [color=red]"
    assert Y.sketch("x", "cobol") == "" and Y.sketch(None, "qml") == ""


def test_bundle(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\nid: 'one'\ntitle: First\ntags:\n  - t\n---\nbody\n")
    (tmp_path / "index.md").write_text("no")
    rows = N.bundle(spark, str(tmp_path)).collect()
    assert [(r.path, r.fields["id"], r.fields["title"], r.body) for r in rows] == [("a/x.md", "one", "First", "body\n")]
    page = N.index_page([("b.md", ""), ("a.md", "A")], "top\n<!-- index -->\nold\n<!-- /index -->\nend\n")
    assert page == "top\n<!-- index -->\n- [A](a.md)\n- [b.md](b.md)\n<!-- /index -->\nend\n"
