"""Documents from pages: title, links and content of HTML, paths and names for them, crawling a table of pages.

Pages that try to command a reader are told apart before they are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.session import materialize

# ---- fixed values: elements that are no content, containers that are, sentences that command ----
CHROME = ("nav", "aside", "footer", "header", "script", "style", "noscript", "form", "svg", "button")
CONTAINERS = ("content", "main-content", "docs-content", "doc-content", "markdown-body", "markdown", "documentation", "article-content", "post-content")
COMMANDS = (
    r"ignore\s+(all\s+|the\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions|prompts?|messages?|context)",
    r"disregard\s+(all\s+|the\s+|any\s+)?(previous|prior|above|earlier|system)\s+(instructions|prompts?|rules?)",
    r"forget\s+(all\s+|everything\s+)?(previous|prior|above|your)\s+(instructions|prompts?|rules?|training)",
    r"(reveal|print|repeat|show|output)\s+(me\s+)?(your|the)\s+(system\s+prompt|instructions|initial\s+prompt)",
    r"you\s+are\s+now\s+(a|an|in|no\s+longer)", r"new\s+(system\s+)?(instructions?|directive|prompt)\s*[:\-]",
    r"(override|bypass|ignore)\s+(all\s+)?(safety|security|content)\s+(policies|guidelines|filters?|rules?)",
)
# ---- end of fixed values ----
_VOID = ("br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr")


class _Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[_Node]:
        """This node and those below it, in order of the document."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parsed(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def title(root: _Node) -> str:
    """The first first-level heading, else the title."""
    for tag in ("h1", "title"):
        node = next((n for n in root.walk() if n.tag == tag), None)
        if node and node.text().strip():
            return node.text().strip()
    return ""


def links(root: _Node, base: str) -> list[str]:
    """The addresses that a page leads to, without fragments, each once."""
    out: dict[str, None] = {}
    for n in root.walk():
        if n.tag == "a" and "href" in n.attrs:
            try:
                parts = urlsplit(urljoin(base, n.attrs["href"].strip()))
            except ValueError:
                continue
            if parts.scheme in ("http", "https"):
                out[urlunsplit(parts._replace(fragment=""))] = None
    return list(out)


def content(root: _Node) -> _Node | None:
    """main, else a known container, else article, else body."""
    nodes = list(root.walk())
    known = lambda n: n.attrs.get("id") in CONTAINERS or set(n.attrs.get("class", "").split()) & set(CONTAINERS)
    for test in (lambda n: n.tag == "main", known, lambda n: n.tag == "article", lambda n: n.tag == "body"):
        found = next((n for n in nodes if test(n)), None)
        if found:
            return found
    return None


def markdown(node: _Node) -> str:
    """The content as Markdown: headings, paragraphs, lists, code, links, emphasis; navigation and scripts left out."""
    block = ("p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "body")

    def render(x: _Node | str, pre: bool = False) -> str:
        if isinstance(x, str):
            return x if pre else re.sub(r"\s+", " ", x)
        if x.tag in CHROME:
            return ""
        inner = "".join(render(c, pre or x.tag == "pre") for c in x.children)
        if re.fullmatch("h[1-6]", x.tag):
            return f"\n\n{'#' * int(x.tag[1])} {inner.strip()}\n\n"
        if x.tag == "pre":
            return f"\n\n```\n{inner.strip(chr(10))}\n```\n\n"
        if x.tag == "code" and not pre:
            return f"`{inner}`"
        if x.tag == "li":
            return f"\n- {inner.strip()}"
        if x.tag == "a" and x.attrs.get("href"):
            return f"[{inner.strip()}]({x.attrs['href']})"
        if x.tag in ("strong", "b") and inner.strip():
            return f"**{inner.strip()}**"
        if x.tag in ("em", "i") and inner.strip():
            return f"*{inner.strip()}*"
        if x.tag == "br":
            return "\n"
        if x.tag in ("td", "th"):
            return f"| {inner.strip()} "
        return f"\n\n{inner.strip()}\n\n" if x.tag in block else inner

    return re.sub(r"\n{3,}", "\n\n", render(node)).strip()


def pages(rows: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, title, links and markdown of every page; a null page gives empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for address, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                root = parsed(body or "")
                node = content(root)
                for column, value in zip(out, (title(root), links(root, address or ""), markdown(node) if node else ""), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string())), pa.array(out[2], pa.string())], names=[key, "title", "links", "markdown"])

    return rows.select(key, url, html).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, title string, links array<string>, markdown string")


def commands(text: Column) -> Column:
    """Whether the first mebibyte of a text tries to command its reader."""
    return F.coalesce(F.lower(F.substring(text, 1, 1 << 20)).rlike("|".join(COMMANDS)), F.lit(False))


def split_quarantine(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows to keep, and those that are put aside."""
    return rows.where(~commands(F.col(text))), rows.where(commands(F.col(text)))


def relative_path(url: Column) -> Column:
    """The Markdown file for an address."""
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    ext = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\.[^.]*)$", 1)
    return (
        F.when(path == "", "index.md").when(ext == "", F.concat(path, F.lit("/index.md"))).when(ext.isin(".html", ".htm"), F.concat(F.regexp_replace(path, r"\.html?$", ""), F.lit(".md")))
        .when(ext == ".md", path).otherwise(F.concat(path, F.lit(".md")))
    )


def slug(name: Column) -> Column:
    """A short folder name for a source."""
    bare = F.regexp_replace(F.lower(F.trim(name)), "^https?://", "")
    made = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "source").otherwise(F.regexp_replace(F.substring(made, 1, 64), "-+$", ""))


def robots(text: str, agent: str = "*") -> tuple[list[str], list[str]]:
    """The disallowed and allowed prefixes for an agent: its own group if there is one, else that of all."""
    groups: dict[str, tuple[list[str], list[str]]] = {}
    names: list[str] = []
    fresh = True
    for line in text.splitlines():
        name, _, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            names = [value.lower()] if fresh or not names else [*names, value.lower()]
            fresh = False
            groups.setdefault(value.lower(), ([], []))
        elif name in ("disallow", "allow"):
            fresh = True
            for n in names:
                if value:
                    groups[n][name == "allow"].append(value)
    return groups.get(agent.lower()) or groups.get("*") or ([], [])


def permitted(path: Column, disallowed: list[str], allowed: list[str]) -> Column:
    """Whether no disallowed prefix fits a path, or a longer allowed one does."""
    best = lambda rules: F.greatest(F.lit(-1), F.lit(-1), *[F.when(path.startswith(r), len(r)).otherwise(-1) for r in rules])
    return best(allowed) >= best(disallowed)


def same_prefix(url: Column, base: str) -> Column:
    """Whether an address lies on the host and below the folder of base."""
    parts = urlsplit(base)
    folder = parts.path.rsplit("/", 1)[0] + "/"
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("/"))
    return (F.parse_url(url, F.lit("HOST")) == parts.netloc) & (path.startswith(folder) | (path == parts.path))


def crawl(table: DataFrame, start: str, depth: int = 3, most: int = 200) -> DataFrame:
    """url and depth of the pages of a table (url, links) that are reached from start on its host, in rounds; `most` is the limit of a crawl."""
    here = table.where(same_prefix(F.col("url"), start))
    seen = materialize(here.where(F.col("url") == start).select("url", F.lit(0).alias("depth")), "crawl")
    for d in range(depth):
        edge = here.join(seen.where(F.col("depth") == d), "url", "left_semi").select(F.explode("links").alias("url")).distinct()
        found = materialize(edge.join(here.select("url").distinct(), "url", "left_semi").join(seen, "url", "left_anti").select("url", F.lit(d + 1).alias("depth")), "crawl")
        if not found.limit(1).count():
            break
        seen = materialize(seen.unionByName(found), "crawl")
    return seen.orderBy("depth", "url").limit(most)


def llms_links(text: Column) -> Column:
    """The addresses that a list for models names."""
    return F.regexp_extract_all(text, F.lit(r"\]\((https?://[^)\s]+)\)"), 1)
