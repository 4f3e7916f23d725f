"""Answers as JSON, as a compact table of rows, as Markdown, as findings for other tools, and as a graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

LEVELS = {"error": "error", "warn": "warning", "info": "note"}


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.selectExpr("to_json(struct(*)) AS value")


def as_table(rows: list[dict], name: str = "rows") -> str:
    """Rows of the same shape as one head with their columns and a line of values each."""
    if not rows:
        return f"{name}[0]:"
    columns = list(rows[0])

    def cell(value) -> str:
        text = "null" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        return json.dumps(text, ensure_ascii=False) if isinstance(value, str) and (text != text.strip() or any(c in text for c in ",\n\"") or text in ("", "null", "true", "false")) else text

    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:", *("  " + ",".join(cell(r[c]) for c in columns) for r in rows)])


def as_markdown(rows: list[dict]) -> str:
    if not rows:
        return ""
    columns = list(rows[0])
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line(["" if r[c] is None else r[c] for c in columns]) for r in rows)])


def as_sarif(findings: list[dict], tool: str = "siftwood") -> str:
    """Findings (check, severity, rel_path, line, detail) in the exchange format for static analysis, version 2.1.0."""
    results = [
        {
            "ruleId": f["check"], "level": LEVELS.get(f["severity"], "none"), "message": {"text": f["detail"] or f["check"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["rel_path"]}, "region": {"startLine": max(1, f["line"] or 1)}}}],
        }
        for f in findings
    ]
    rules = [{"id": c} for c in sorted({f["check"] for f in findings})]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=1)


def as_badge(score: int) -> str:
    color = "brightgreen" if score >= 90 else "yellow" if score >= 70 else "red"
    return json.dumps({"schemaVersion": 1, "label": "health", "message": f"{score}/100", "color": color})


def as_graph(links: list[tuple[str, str]]) -> str:
    """Links as nodes and edges of a drawing."""
    quoted = lambda s: json.dumps(s, ensure_ascii=False)
    return "\n".join(["digraph files {", *(f"  {quoted(a)} -> {quoted(b)};" for a, b in sorted(set(links))), "}"])


def failed(findings: list[dict], at: str = "error") -> bool:
    """Whether a finding of this severity or a worse one is there."""
    order = ("info", "warn", "error")
    return any(order.index(f["severity"]) >= order.index(at) for f in findings)
