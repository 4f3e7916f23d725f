"""Column functions over relative paths: parts, classes, tiers, roles, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: names by which paths are classified ----
TEST_MARKS = ("_test.", ".test.", "_spec.", ".spec.")
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testdata", "integration_test")
TEST_TOKENS = ("test", "tests", "testing", "spec", "specs", "e2e")
DOC_ENDINGS = (".md", ".mdx", ".markdown", ".rst", ".adoc", ".txt")
DOC_DIRS = ("docs", "doc", "i18n", "l10n", "locale", "locales", "translations")
VENDOR_DIRS = ("vendor", "third_party", "third-party", "node_modules", ".venv", "venv", "site-packages", ".yarn")
VENDOR_ENDINGS = (".pb.go", "_pb2.py", ".g.dart")
AUXILIARY_KINDS = ("setting", "keybind", "color", "heading", "config_section")
DEPENDENCY_KINDS = ("includes", "references", "execs", "binds", "autostarts", "instantiates", "uses", "pkg")
MODULE_LANGS = ("go", "rust", "typescript", "tsx", "javascript", "python", "java", "ruby", "csharp", "php", "kotlin", "dart")
DATA_LANGS = ("json", "yaml", "toml", "markdown")
LANGUAGES = {
    "lua": "lua", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx", "md": "markdown", "mdx": "markdown", "markdown": "markdown", "sh": "bash", "bash": "bash", "zsh": "bash", "css": "css",
    "scss": "scss", "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "ini": "ini", "qml": "qml", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "c++": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "c": "cpp", "h": "cpp", "fish": "fish", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "cs": "csharp",
    "php": "php", "phtml": "php", "kt": "kotlin", "kts": "kotlin", "dart": "dart", "ex": "elixir", "exs": "elixir", "swift": "swift", "plist": "plist",
    "entitlements": "plist", "pbxproj": "pbxproj", "xcconfig": "xcconfig", "conf": "generic",
}
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "go.sum", "cargo.lock", "gemfile.lock", "poetry.lock", "composer.lock", "pipfile.lock",
    "flake.lock", "bun.lockb", "packages.lock.json", "pubspec.lock", "mix.lock", "gradle.lockfile",
)
MINIFIED_ENDINGS = (".min.js", ".min.css", ".min.mjs", ".map")
GENERATED_ENDINGS = (".pb.go", ".pb.cc", "_pb2.py", ".gen.go", "_gen.go", "_generated.go", ".g.dart", ".freezed.dart")
LOCALE_DIRS = ("locale", "locales", "i18n", "l10n", "translations", "lang", "langs")
LOCALE_EXTENSIONS = ("po", "pot", "arb", "xliff", "xlf")
CI_FILES = (".gitlab-ci.yml", ".travis.yml", "azure-pipelines.yml", "appveyor.yml", "jenkinsfile", ".pre-commit-config.yaml")
PROSE_EXTENSIONS = ("md", "mdx", "markdown", "rst", "adoc")
SKIPPED_DIRS = (".git", "node_modules", ".cursor", ".vscode", ".zed", ".idea", ".helix", ".omp", ".factory")
# ---- end of fixed values ----


def _any(column: Column, how: str, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | getattr(column, how)(v)
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The folder of a path, empty for a bare name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last extension in lower case, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The name up to its first dot."""
    return F.regexp_extract(basename(path), r"^([^.]*)", 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def subsystem(path: Column) -> Column:
    """The first two folders of a path, the first of a shallow one, or a dot."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n == 1, ".").when(n == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))


def has_segment(path: Column, names) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_vendored(path: Column) -> Column:
    return has_segment(path, VENDOR_DIRS) | _any(path, "endswith", VENDOR_ENDINGS)


def is_test(path: Column) -> Column:
    name = basename(path)
    return _any(name, "contains", TEST_MARKS) | name.startswith("test_") | has_segment(path, TEST_DIRS)


def is_doc_or_locale(path: Column) -> Column:
    return _any(F.lower(path), "endswith", DOC_ENDINGS) | has_segment(path, DOC_DIRS)


def search_tier(path: Column) -> Column:
    """Source 0, test 1, documentation or locale 2, vendored 3."""
    return F.when(is_vendored(path), 3).when(is_doc_or_locale(path), 2).when(is_test(path), 1).otherwise(0)


def find_rank(kind: Column, path: Column) -> Column:
    return F.when(kind.isin(*AUXILIARY_KINDS), 1).otherwise(0) + F.when(is_vendored(path), 2).otherwise(0)


def language(path: Column, head: Column | None = None) -> Column:
    """The language of a file by marker in its path, then extension, then the interpreter its first line names."""
    low, ext, name = F.lower(path), extension(path), basename(path)
    out = F.when(low.contains("hypr/") & ((ext == "conf") | (name == "hyprland.conf")), "hyprlang").when(ext == "rasi", "rasi")
    for e, lang in LANGUAGES.items():
        out = out.when(ext == e, lang)
    if head is not None:
        line = F.when(head.startswith("#!"), F.split(head, "\n")[0]).otherwise("")
        out = out.when(line.contains("bash") | line.contains("/sh") | line.contains("zsh"), "bash")
        for word in ("python", "lua", "fish"):
            out = out.when(line.contains(word), word)
    out = out.when((name == "config") & (low.contains("sway/") | low.contains("i3/")), "generic")
    return out.otherwise("")


def role(path: Column, lang: Column) -> Column:
    """What a file is for, by its path and language; empty if nothing tells."""
    p, name = F.lower(path), F.lower(basename(path))
    has = lambda *words: _any(p, "contains", words)
    return (
        F.when(has("hypr/", "sway/", "i3/") | (name == "hyprland.conf"), "wm-config")
        .when(has("waybar/", "polybar/", "eww/", "ags/"), "bar")
        .when(has("rofi/") | p.endswith(".rasi"), "launcher")
        .when(has("dunst", "mako"), "notifications")
        .when(name.isin("kitty.conf", "alacritty.toml") | has("kitty/", "alacritty/", "foot/", "wezterm"), "terminal")
        .when(lang == "qml", "widget")
        .when(lang.isin("css", "scss") | has("gtk", "theme"), "theme")
        .when((lang == "lua") & p.contains("nvim"), "editor")
        .when((lang == "bash") | has("scripts/") | p.endswith(".sh"), "script")
        .otherwise("")
    )


def low_signal(path: Column) -> Column:
    """lockfile, minified, generated, locale, ci, test or docs, tried in this order; empty for ordinary source."""
    p = F.lower(path)
    name, ext = basename(p), extension(p)
    inside = lambda names: has_segment(dirname(p), names)
    tokens = F.split(p, "[-_./]")
    return (
        F.when(name.isin(*LOCK_FILES) | name.endswith(".lock"), "lockfile")
        .when(_any(name, "endswith", MINIFIED_ENDINGS), "minified")
        .when(inside(("generated",)) | _any(name, "endswith", GENERATED_ENDINGS), "generated")
        .when(inside(LOCALE_DIRS) | ext.isin(*LOCALE_EXTENSIONS), "locale")
        .when(inside((".github", ".circleci")) | name.isin(*CI_FILES), "ci")
        .when(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in TEST_TOKENS])), "test")
        .when(ext.isin(*PROSE_EXTENSIONS), "docs")
        .otherwise("")
    )


def is_artifact(path: Column) -> Column:
    """Lock files, minified scripts and source maps, which a walk leaves out."""
    name = F.lower(basename(path))
    return name.isin(*LOCK_FILES) | name.endswith(".lock") | _any(name, "endswith", MINIFIED_ENDINGS)


def cleaned(path: Column) -> Column:
    """A relative path with ., .. and empty parts folded; what goes up beyond the top keeps its .. parts."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.when(
            (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(folded, "/")


def joined(folder: Column, name: Column) -> Column:
    return cleaned(F.concat_ws("/", folder, name))


def suffixes(path: Column) -> Column:
    """Every tail of a path that begins at a folder boundary, the path itself first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
