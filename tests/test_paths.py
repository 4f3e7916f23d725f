import random

from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.functions import text as X


def folded(path):
    out = []
    for x in path.split("/"):
        if x in ("", "."):
            continue
        if x == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(x)
    return "/".join(out)


def test_cleaned(spark):
    rng = random.Random(4)
    paths = ["/".join(rng.choice(["a", "b.c", "..", ".", "", "d"]) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", P.cleaned(F.col("p")).alias("c")).collect()
    assert all(r.c == folded(r.p) for r in got)


def test_classes(spark):
    rows = {
        "a/b/c_test.go": (1, "test", "a/b", "go"), "vendor/x/y.go": (3, "", "vendor/x", "go"), "docs/guide.md": (2, "docs", "docs", "markdown"), "src/main.rs": (0, "", "src", "rust"), "x.pb.go": (3, "generated", ".", "go"),
        "i18n/de.json": (2, "locale", "i18n", "json"), "yarn.lock": (0, "lockfile", ".", ""), "a/b.min.js": (0, "minified", "a", "javascript"), ".github/w/ci.yml": (0, "ci", ".github/w", "yaml"), "hypr/x.conf": (0, "", "hypr", "hyprlang"),
        "latest/attestation.py": (0, "", "latest", "python"), "dev-testing/x.py": (0, "test", "dev-testing", "python"), "sway/config": (0, "", "sway", "generic"), "README": (0, "", ".", ""),
    }
    p = F.col("p")
    got = spark.createDataFrame([(k,) for k in rows], "p string").select("p", P.search_tier(p).alias("t"), P.low_signal(p).alias("c"), P.subsystem(p).alias("s"), P.language(p).alias("l")).collect()
    assert {r.p: (r.t, r.c, r.s, r.l) for r in got} == rows
    shebang = spark.createDataFrame([("run", "#!/usr/bin/env python\nx"), ("go", "#!/bin/sh\n"), ("n", "text")], "p string, h string").select(P.language(p, F.col("h")).alias("l")).collect()
    assert [r.l for r in shebang] == ["python", "bash", ""]
    tails = spark.createDataFrame([("a/b/c.d",)], "p string").select(P.suffixes(p).alias("s")).first().s
    assert tails == ["a/b/c.d", "b/c.d", "c.d"]
    assert spark.createDataFrame([("hypr/a.conf", "hyprlang"), ("x/theme.css", "css"), ("bin/a.sh", "bash"), ("a.go", "go")], "p string, l string").select(P.role(p, F.col("l")).alias("r")).collect() == [("wm-config",), ("theme",), ("script",), ("",)]


def test_scores(spark):
    df = spark.createDataFrame([("The cache, the CACHE and cache cache", "src/cache/session.py"), (None, "x")], "t string, p string")
    got = df.select(X.lexical_score(["cache", "nope"], F.col("t")).alias("s"), X.concept_score(["cache", "session"], F.col("p")).alias("c"), X.tokens(F.col("t")).alias("k")).collect()
    assert (got[0].s, got[0].c, got[0].k) == (15, 3, ["the", "cache", "the", "cache", "and", "cache", "cache"]) and got[1].k == []
    assert df.select(X.snippet(F.col("t"), ["and"], 4).alias("s")).first().s == "CHE and "
