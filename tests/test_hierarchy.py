import random

import pytest

from siftwood.operators import hierarchy as H


def brute(rows):
    node = {}
    for i, p, g in rows:
        if i is not None:
            node.setdefault(i, (p, g))
    out = {}
    for i in node:
        seen, at = [], i
        while True:
            if at in seen:
                ring = seen[seen.index(at) :]
                out[i] = (min(ring), next(k for k, x in enumerate(seen) if x in ring), "cycle")
                break
            seen.append(at)
            p, g = node[at]
            if p is None or p not in node or node[p][1] != g:
                kind = "ok" if p is None else "broken" if p not in node else "crossing"
                out[i] = (at, len(seen) - 1, "root" if p is None and at == i else kind)
                break
            at = p
    return {i: o for i, o in out.items() if node[i][0] is not None}


def make(seed, n=300, files=6):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n):
        g = rng.randint(1, files)
        r = rng.random()
        if r < 0.15:
            p = None
        elif r < 0.2:
            p = rng.randint(n + 1, 2 * n)
        elif r < 0.3:
            p = rng.randint(1, n - 1)
        else:
            same = [x for x in rows if x[2] == g]
            p = rng.choice(same[-5:])[0] if same else None
        rows.append((i, p, g))
    rows += [(1000 + i, 1000 + i - 1 if i else None, 99) for i in range(150)]  # a deep chain
    rows += [(2000, 2002, 98), (2001, 2000, 98), (2002, 2001, 98), (2003, 2001, 98), (2004, 2003, 98), (2005, 2005, 98)]
    rows += rows[:20]
    return rows + [(None, 5, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, f"n/{r[0]}", "x") for r in rows], "symbol_id long, parent_id long, file_id long, name string, entry string")


@pytest.mark.parametrize("limit", [H.BLOCK_ROWS, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_states_against_brute_force(spark, seed, limit):
    rows = make(seed)
    got = {r.symbol_id: (r.root_id, r.depth, r.state) for r in H.found(frame(spark, rows), block_rows=limit).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("limit", [H.BLOCK_ROWS, 3])
def test_paths_and_descendants(spark, limit):
    rows = [(1, None, 1), (2, 1, 1), (3, 1, 1), (4, 2, 1), (5, 9, 1), (6, 5, 1), (7, None, 2), (8, 7, 2), (8, 7, 2), (10, None, None), (11, 10, None)]
    got = {r.symbol_id: r.path for r in H.paths(frame(spark, rows), block_rows=limit).collect()}
    n = lambda *ids: [f"n/{i}" for i in ids]
    assert got == {1: n(1), 2: n(1, 2), 3: n(1, 3), 4: n(1, 2, 4), 5: n(5), 6: n(5, 6), 7: n(7), 8: n(7, 8), 10: n(10), 11: n(10, 11)}
    below = {r.symbol_id: r.n_below for r in H.descendants(frame(spark, rows), block_rows=limit).collect()}
    assert below == {1: 3, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0, 10: 1, 11: 0}
    wanted = frame(spark, [(1, None, 1), (5, None, 1)])
    assert sorted((r.ancestor, r.symbol_id) for r in H.pairs(frame(spark, rows), wanted, block_rows=limit).collect()) == [(1, 2), (1, 3), (1, 4), (5, 6)]


@pytest.mark.parametrize("limit", [H.BLOCK_ROWS, 3])
def test_below_names_every_symbol_below(spark, limit):
    rows = [(1, None, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (5, 9, 1), (6, 5, 1), (7, 1, 2)]
    rows += [(20, 22, 3), (21, 20, 3), (22, 21, 3), (23, 21, 3), (24, 23, 3), (30, 30, 3), (31, 30, 3)]
    want = {(1, 2), (1, 3), (2, 3), (5, 6), (23, 24), (30, 31)} | {(a, b) for a in (20, 21, 22) for b in range(20, 25) if a != b}
    got = [tuple(r) for r in H.below(frame(spark, rows), block_rows=limit).select("symbol_id", "below_id").collect()]
    assert sorted(got) == sorted(want)
    asked = frame(spark, [(20, None, 3), (30, None, 3), (1, None, 1)])
    some = [tuple(r) for r in H.pairs(frame(spark, rows), asked, block_rows=limit).select("ancestor", "symbol_id").collect()]
    assert sorted(some) == sorted(p for p in want if p[0] in (1, 20, 30))


def test_empty(spark):
    assert H.found(frame(spark, [])).count() == 0
    assert H.paths(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [4, 7])
def test_tours_of_trees_and_circles_over_many_blocks(spark, limit):
    rng = random.Random(limit)
    rows = [(i, 10 + (i - 9) % 12, 1) for i in range(10, 22)]  # a circle of twelve
    rows += [(i, rng.choice([r[0] for r in rows]), 1) for i in range(30, 60)]
    rows += [(100, None, 2)] + [(i, rng.choice([100, *range(100, i)]), 2) for i in range(101, 140)]
    rows += [(200, 200, 2), (201, 200, 2), (300 - 1, 100, 1)] + [(400 + i, 400, 2) for i in range(1, 30)] + [(400, 139, 2)]
    rows += [(-5, -6, 5), (-6, -7, 5), (-7, -5, 5), (-8, -6, 5), (-4, -8, 5)]
    up = {i: p for i, p, _ in rows}
    grp = {i: g for i, _, g in rows}
    above = {}
    for i in up:
        seen, at = [], i
        while True:
            p = up[at]
            if p is None or p not in up or grp[p] != grp[at] or p in seen:
                break
            seen.append(p)
            at = p
        above[i] = set(seen) - {i}
    want = {i: sum(i in a for a in above.values()) for i in up}
    got = {r.symbol_id: r for r in H.descendants(frame(spark, rows), block_rows=limit).collect()}
    assert {i: r.n_below for i, r in got.items()} == want
    for a in got.values():
        for d in got.values():
            told = a.top == d.top and a.entry < d.entry and d.leave < a.leave
            told = told or a.circle is not None and d.state == "cycle" and d.root_id == a.circle and d.symbol_id != a.symbol_id
            assert told == (a.symbol_id in above[d.symbol_id]), (a, d)
    for top in {r.top for r in got.values()}:
        places = sorted(x for r in got.values() if r.top == top for x in (r.entry, r.leave))
        assert places == list(range(len(places)))
    named = {(r.symbol_id, r.below_id) for r in H.below(frame(spark, rows), block_rows=limit).collect()}
    assert named == {(a, d) for d, some in above.items() for a in some}
