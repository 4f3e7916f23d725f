import random

import numpy as np
import pytest

from siftwood.llm import packing as P


def plain_best_two_fit(sizes, capacity):
    """The same rule item by item, without runs of equal containers."""
    left = sorted(s for s in sizes if s)
    bins = []
    while left:
        gap, inside = capacity, []
        for s in reversed(left[:]):
            if s <= gap:
                left.remove(s)
                inside.append(s)
                gap -= s
        if gap and len(inside) > 1:
            small, best = inside[-1], (0, 0)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if a + b <= gap + small and a + b > sum(best):
                        best = (a, b)
            if sum(best) > small:
                inside.remove(small)
                left.remove(best[0])
                left.remove(best[1])
                inside += best
                left = sorted([*left, small])
        bins.append(sorted(inside))
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_against_the_plain_rule(seed):
    rng = random.Random(seed)
    capacity = 30
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 5, 60, 150]))]
    plan = P.best_two_fit(np.bincount(sizes or [0], minlength=capacity + 1) * (1 if sizes else 0), capacity)
    want = plain_best_two_fit(sizes, capacity)
    assert plan.bins == len(want)
    filled = [[] for _ in range(plan.bins)]
    for s in range(1, capacity + 1):
        n = sizes.count(s)
        if n:
            for b in plan.place(np.full(n, s), np.arange(n)):
                filled[b].append(s)
    assert sorted(map(sorted, filled)) == sorted(want)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n long, bin_id string")


def test_pack_keeps_every_token_and_never_overfills(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 7, 50, 99, 100, 101, 250, 1000, rng.randint(1, 100)])) for i in range(500)]
    rows += [(1000, None), (1001, -3), (5, 50), (None, 20)]
    out = P.pack(frame(spark, rows), "doc_id", "n", 100).toPandas()
    used = out[out["size"] > 0].groupby("bin_id")["size"].sum()
    assert used.max() <= 100
    assert out["size"].sum() == sum(max(n or 0, 0) for _, n in rows)
    assert set(out[out["size"] == 0]["bin_id"].isna()) == {True}
    assert sorted(used.index) == list(range(len(used)))
    long = out[out.doc_id == next(i for i, n in rows if n == 250)].sort_values("piece")
    assert list(long["size"]) == [100, 100, 50] and list(long["start"]) == [0, 100, 200]
    whole = [i for i, n in rows if n and 0 < n <= 100 and i != 5]
    assert (out[out.doc_id.isin(whole)].groupby("doc_id").size() == 1).all()
    bound = -(-int(out["size"].sum()) // 100)
    assert bound <= len(used) <= bound * 1.1 + 1


def test_empty(spark):
    assert P.pack(frame(spark, []), "doc_id", "n", 100).count() == 0
    only = P.pack(frame(spark, [(1, 0), (2, None)]), "doc_id", "n", 100).collect()
    assert {(r.doc_id, r.bin_id, r.size) for r in only} == {(1, None, 0), (2, None, 0)}
