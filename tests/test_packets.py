import random

from siftwood.operators import packets as C

COLUMNS = "position int, id string, kind string, rel_path string, start_line int, title string, summary string, compact string, standard string, full string"


def brute(rows, budget, mode):
    used, kept, left, seen = 0, [], {}, set()
    cost = lambda r, body: (len("\n".join([r[5] or "", r[6] or "", body]).encode()) + 3) // 4
    for r in sorted(rows):
        if r[1] in seen:
            left["duplicate"] = left.get("duplicate", 0) + 1
            continue
        seen.add(r[1])
        forms = {"full": r[9] or "", "standard": r[8] or "", "compact": r[7] or ""}
        chain = {"full": ("full", "standard"), "standard": ("standard",), "compact": ()}[mode]
        form = next((f for f in chain if forms[f]), "compact")
        for f in dict.fromkeys((form, "compact")):
            c = cost(r, forms[f])
            if used + c <= budget:
                used += c
                kept.append((r[0], c, f))
                break
        else:
            left["budget"] = left.get("budget", 0) + 1
    return kept, left


def test_packing_against_brute_force(spark):
    rng = random.Random(4)
    for mode in C.MODES:
        rows = []
        for i in range(1, 40):
            text = lambda n: rng.choice([None, "", "word " * rng.randint(1, n)])
            rows.append((i, f"source:{rng.randint(1, 30)}", "source", f"f{i % 7}", 1, f"title {i}", text(9), text(12), text(60), text(200)))
        taken, left = C.assembled(spark.createDataFrame(rows, COLUMNS), 300, mode, ("source:1", "source:none"))
        kept, told = brute(rows, 300, mode)
        assert sorted((r.position, r.tokens, r.packed_as) for r in taken.collect()) == kept
        told["not_found"] = 1 + all(r[1] != "source:1" for r in rows)
        assert {r.reason: r.n for r in left.collect()} == told
    taken, left = C.assembled(spark.createDataFrame([], COLUMNS))
    assert taken.count() == 0 and left.count() == 0


def test_ranking_adds_up(spark, tmp_path):
    tables = {
        "files": ([(1, "src/session_cache.go", "go", 1, "h", "2024"), (2, "docs/cache.md", "markdown", 1, "h", "2024"), (3, "lib/other.go", "go", 1, "h", "2024")], "file_id long, rel_path string, lang string, size long, hash string, indexed_at string"),
        "chunks": ([(1, 1, 1, 3, "session cache here\n"), (2, 2, 1, 3, "the session cache\n"), (3, 3, 1, 2, "nothing\n")], "chunk_id long, file_id long, start_line int, end_line int, text string"),
        "symbols": ([(1, 1, "SessionCache", "struct", None, 1, 3, None, None, None)], "symbol_id long, file_id long, name string, kind string, signature string, start_line int, end_line int, parent_id long, complexity int, doc string"),
        "edges": ([(1, "file", 1, "includes", 1, 1, "x", "file", 3, True)], "edge_id long, src_type string, src_id long, kind string, file_id long, line int, raw string, dst_type string, dst_id long, resolved boolean"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    from siftwood.index import Index

    notes = spark.createDataFrame([("n1", "On the cache", "short", "session cache\n\nmore", "", "high", "stale"), ("n2", "Other", "", "nothing", "", None, None)], C._EMPTY_NOTES)
    changed = spark.createDataFrame([("lib/other.go",)], "rel_path string")
    got = {r.rel_path or r.id: r for r in C.ranked(Index(spark, str(tmp_path)), "session cache", notes=notes, changed=changed).collect()}
    assert set(got) == {"src/session_cache.go", "docs/cache.md", "lib/other.go", "concept:n1"}
    assert got["src/session_cache.go"].score == 10 + 5 + 10 + 8 + 8
    assert got["docs/cache.md"].score == 10 * 0.5 + 5 + 10
    assert got["lib/other.go"].score == 5 + 10 - 2 + 8 and "in a changed file" in got["lib/other.go"].reasons
    assert got["concept:n1"].score == 15 + 5 + 15 - 20
    asked = C.ranked(Index(spark, str(tmp_path)), "session cache", direct_ids=(got["docs/cache.md"].id,)).where("rel_path = 'docs/cache.md'").first()
    assert asked.score == 10 + 5 + 10 + 100
