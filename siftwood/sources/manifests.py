"""Names of modules and packages from manifests, front matter of documents, configuration and model files.

A tree has a manifest per package; they are read where they lie and give a few
names each, which the resolver takes as an argument.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import tomllib

import numpy as np

from siftwood.operators.resolution import Manifests


def go_module(text: str) -> str:
    m = re.search(r"(?m)^module\s+(\S+)", text)
    return m[1] if m else ""


def crate_name(text: str) -> str:
    try:
        return tomllib.loads(text).get("package", {}).get("name", "").replace("-", "_")
    except tomllib.TOMLDecodeError:
        return ""


def package_name(text: str) -> str:
    try:
        made = json.loads(without_comments(text))
    except ValueError:
        return ""
    return made.get("name", "") if isinstance(made, dict) and isinstance(made.get("name", ""), str) else ""


def pubspec_name(text: str) -> str:
    m = re.search(r"(?m)^name:\s*['\"]?([\w.-]+)", text)
    return m[1] if m else ""


def without_comments(text: str) -> str:
    """JSON without comments and trailing commas; strings stay."""
    kept = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[}\]])", lambda m: m[1] or "", kept)


def path_aliases(configs: dict[str, str], start: str, depth: int = 8) -> dict[str, list[str]]:
    """The alias prefixes of a compiler configuration (path: text) with their targets; what it extends is read first."""
    text = configs.get(start)
    if text is None or not depth:
        return {}
    try:
        made = json.loads(without_comments(text))
    except ValueError:
        return {}
    folder, out = posixpath.dirname(start), {}
    if isinstance(made.get("extends"), str) and made["extends"].startswith("."):
        parent = posixpath.normpath(posixpath.join(folder, made["extends"]))
        out |= path_aliases(configs, parent if parent.endswith(".json") else parent + ".json", depth - 1)
    options = made.get("compilerOptions") or {}
    base = posixpath.normpath(posixpath.join(folder, options.get("baseUrl", ".")))
    for alias, targets in (options.get("paths") or {}).items():
        out[alias.rstrip("*")] = [posixpath.normpath(posixpath.join(base, t.rstrip("*"))).removeprefix("./") for t in targets]
    return out


def read(manifests: dict[str, str]) -> Manifests:
    """What the manifests of a tree (path: text) say."""
    out = Manifests()
    for path in sorted(manifests):
        name, folder, text = posixpath.basename(path), posixpath.dirname(path), manifests[path]
        if name == "go.mod" and not out.go_module:
            out.go_module = go_module(text)
        elif name == "Cargo.toml" and crate_name(text):
            out.crates[crate_name(text)] = posixpath.join(folder, "src")
        elif name == "package.json" and package_name(text):
            out.ts_packages[package_name(text)] = folder
        elif name == "pubspec.yaml" and pubspec_name(text):
            out.dart_packages[pubspec_name(text)] = folder
        elif re.fullmatch(r"(?:ts|js)config(?:\.[\w-]+)?\.json", name):
            aliases = path_aliases(manifests, path)
            if aliases:
                out.ts_aliases.append((folder or ".", aliases))
    return out


def rules(text: str) -> list[tuple[str, str, str]]:
    """name, from and to of the forbidden links of a configuration."""
    return [(r.get("name", "forbidden crossing"), r.get("from", ""), r.get("to", "")) for r in tomllib.loads(text).get("forbid", [])]


def word_pieces(text: str) -> dict[str, int]:
    """The vocabulary of a file with one piece a line."""
    return {x: i for i, x in enumerate(text.splitlines())}


_TYPES = {"F32": np.float32, "F16": np.float16, "F64": np.float64, "I8": np.int8, "I32": np.int32, "I64": np.int64, "U8": np.uint8}


def tensors(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a file that begins with the length and the table of its tensors."""
    (n,) = struct.unpack("<Q", data[:8])
    table = json.loads(data[8 : 8 + n])
    body = memoryview(data)[8 + n :]
    out = {}
    for name, about in table.items():
        if name != "__metadata__":
            a, b = about["data_offsets"]
            out[name] = np.frombuffer(body[a:b], _TYPES[about["dtype"]]).reshape(about["shape"])
    return out
