"""Outlines of user interfaces from source text: elements with their properties, tokens of styles.

A tree per file, given as lines of text: a plain reading of the source, without a
grammar, that shows structure and values and leaves logic out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_RULES, MOST_ROOTS = 80, 8
# ---- fixed values: order of the groups of properties, and elements that behave ----
GROUPS = (
    ("geometry", ("x", "y", "z", "width", "height", "implicitWidth", "implicitHeight", "frame", "position", "offset")),
    ("layout", ("anchors", "Layout", "spacing", "padding", "margin", "margins", "columns", "rows", "alignment", "gap")),
    ("paint", ("color", "background", "border", "radius", "opacity", "gradient", "source", "foregroundColor", "foregroundStyle", "cornerRadius", "shadow", "fill", "stroke")),
    ("text", ("text", "font", "horizontalAlignment", "verticalAlignment", "elide", "wrapMode", "lineLimit", "title", "label")),
)
BEHAVES = ("Behavior", "Transition", "State", "states", "transitions", "PropertyChanges", "Timer", "Connections")
GESTURES = ("animation", "transition", "gesture", "task", "sheet", "alert", "popover", "refreshable", "searchable", "focusable", "disabled")
# ---- end of fixed values ----


@dataclass
class Element:
    name: str
    properties: dict[str, str] = field(default_factory=dict)
    children: list[Element] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


def group(name: str) -> int:
    """The place of a property's group; others come last."""
    head = name.split(".")[0]
    return next((i for i, (_, names) in enumerate(GROUPS) if head in names), len(GROUPS))


def rendered(element: Element, depth: int = 0) -> list[str]:
    """The lines of an element: its properties by group, then its notes and children."""
    order = sorted(element.properties.items(), key=lambda kv: group(kv[0]))
    values = " ".join(f"{k}={v}" for k, v in order)
    out = ["  " * depth + element.name + (f" [{values}]" if values else "")]
    out += ["  " * (depth + 1) + "* " + n for n in element.notes]
    return out + [line for c in element.children for line in rendered(c, depth + 1)]


def qml(text: str) -> list[Element]:
    """The elements of a QML file; animations and states become notes."""
    roots: list[Element] = []
    stack: list[Element | None] = []
    for line in text.split("\n"):
        bare = re.sub(r"//.*$", "", line).strip()
        m = re.match(r"(?:(?P<on>[\w.]+)\s*:\s*)?(?P<name>[A-Z][\w.]*)(?:\s+on\s+(?P<p>\w+))?\s*\{(?P<rest>.*)$", bare)
        top = next((e for e in reversed(stack) if e), None)
        if m:
            if m["name"].endswith("Animation") or m["name"] in BEHAVES:
                if top:
                    top.notes.append(m["name"] + (f" on {m['p']}" if m["p"] else ""))
                stack.append(None)
            else:
                made = Element(m["name"])
                (top.children if top else roots).append(made)
                stack.append(made)
            bare = m["rest"].strip()
        if stack and stack[-1]:
            for k, v in re.findall(r"([\w.]+)\s*:\s*([^;{}]+)", bare):
                stack[-1].properties[k] = v.strip()
        opened, closed = bare.count("{"), bare.count("}")
        stack += [None] * opened
        for _ in range(min(closed, len(stack))):
            stack.pop()
    return roots


def jsx(text: str) -> list[Element]:
    """The element trees of a component file, the largest first; keys and references left out, texts as one property."""
    roots: list[Element] = []
    stack: list[Element] = []
    for m in re.finditer(r"<(?P<close>/)?(?P<name>[A-Za-z][\w.]*)?(?P<attrs>(?:\s+[\w:-]+(?:=(?:\"[^\"]*\"|'[^']*'|\{[^{}]*\}))?)*)\s*(?P<self>/)?>(?P<text>[^<{]*)", text):
        if m["close"]:
            if stack:
                stack.pop()
            if stack and m["text"].strip():
                stack[-1].properties["text"] = " ".join(filter(None, (stack[-1].properties.get("text"), m["text"].strip())))
            continue
        made = Element(m["name"] or "Fragment")
        for k, v in re.findall(r"([\w:-]+)(?:=(\"[^\"]*\"|'[^']*'|\{[^{}]*\}))?", m["attrs"]):
            if k not in ("key", "ref"):
                made.properties[k] = v.strip("\"'") or "true"
        (stack[-1].children if stack else roots).append(made)
        if not m["self"]:
            stack.append(made)
            if m["text"].strip():
                made.properties["text"] = m["text"].strip()
    return sorted(roots, key=lambda e: -e.size())[:MOST_ROOTS]


def swiftui(text: str) -> list[Element]:
    """The views of the first type with a body; modifiers as properties, gestures and handlers as notes."""
    m = re.search(r"struct\s+(\w+)[^{]*\{.*?var\s+body\s*:\s*some\s+\w+\s*\{", text, re.S)
    if not m:
        return []
    root = Element(m[1])
    stack, depth = [(0, root)], 1
    for line in text[m.end() :].split("\n"):
        bare = re.sub(r"//.*$", "", line).strip()
        view = re.match(r"(?P<name>[A-Z]\w*)\s*(?P<args>\([^{}]*\))?\s*(?P<open>\{)?", bare)
        mod = re.match(r"\.(?P<name>\w+)\s*(?:\((?P<args>.*?)\))?\s*\{?$", bare)
        while stack[-1][0] >= depth and len(stack) > 1:
            stack.pop()
        parent = stack[-1][1]
        if view and not mod:
            made = Element(view["name"])
            if view["args"] and view["args"] != "()":
                made.properties["text"] = view["args"].strip("()")
            parent.children.append(made)
            if view["open"]:
                stack.append((depth, made))
        elif mod and (parent.children or parent is not root):
            target = parent.children[-1] if parent.children else parent
            if re.match(r"on[A-Z]", mod["name"]) or mod["name"] in GESTURES:
                target.notes.append(mod["name"])
            else:
                target.properties[mod["name"]] = mod["args"] or "true"
        depth += bare.count("{") - bare.count("}")
        if depth <= 0:
            break
    return [root]


def terminal(text: str) -> list[Element]:
    """The colours and style chains of a terminal interface in Go."""
    out = []
    for name, color in re.findall(r"(?m)^\s*(\w+)\s*:?=\s*lipgloss\.(?:Adaptive)?Color\w*[({]\s*([^)}]*)[)}]", text):
        out.append(Element(name, {"color": color.strip().strip('"')}))
    for name, chain in re.findall(r"(?ms)^\s*(\w+)\s*:?=\s*lipgloss\.NewStyle\(\)((?:\s*\.\s*\w+\([^()]*\))*)", text):
        out.append(Element(name, {k: v.strip().strip('"') or "true" for k, v in re.findall(r"\.\s*(\w+)\(([^()]*)\)", chain)}))
    return out


def css(text: str) -> list[Element]:
    """The first value of each token, then the rules, 80 at most."""
    bare = re.sub(r"/\*.*?\*/", "", text, flags=re.S)
    tokens: dict[str, str] = {}
    for k, v in re.findall(r"(--[\w-]+|\$[\w-]+)\s*:\s*([^;{}]+)", bare):
        tokens.setdefault(k, v.strip())
    rules = [Element(s.strip(), {k.strip(): v.strip() for k, v in re.findall(r"([\w-]+)\s*:\s*([^;{}]+)", b) if not k.startswith("--")}) for s, b in re.findall(r"([^{};@]+)\{([^{}]*)\}", bare)]
    return ([Element("tokens", tokens)] if tokens else []) + [r for r in rules if r.properties][:MOST_RULES]


READERS = {"qml": qml, "tsx": jsx, "javascript": jsx, "swift": swiftui, "go": terminal, "css": css, "scss": css}


def sketch(text: str | None, lang: str | None) -> str:
    """The outline of a file; empty for a language without a reader."""
    reader = READERS.get(lang or "")
    return "\n".join(line for e in reader(text) for line in rendered(e)) if reader and text else ""


@F.pandas_udf(T.StringType())
def sketched(text: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([sketch(t, x) for t, x in zip(text, lang, strict=True)], dtype=object)
