import random

import pytest

from siftwood.operators import graph


def closure(n, links):
    reach = {i: set() for i in range(n)}
    for i in reach:
        todo = [i]
        while todo:
            for a, b in links:
                if a == todo[-1] and b not in reach[i]:
                    reach[i].add(b)
                    todo.insert(0, b)
            todo.pop()
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng, n = random.Random(seed), 40
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(48)]
    reach = closure(n, links)
    df = spark.createDataFrame(links, "src long, dst long")
    rings = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n) if any(j != i and j in reach[i] and i in reach[j] for j in range(n))}
    assert {r.id: r.circle for r in graph.circles(df).collect()} == rings
    both = closure(n, links + [(b, a) for a, b in links])
    assert {r.id: r.component for r in graph.components(spark.range(n), df).collect()} == {i: min(both[i] | {i}) for i in range(n)}
    rounds = 7
    kept = [(a, b) for a, b in links if a != b]
    out = {i: sum(a == i for a, _ in kept) for i in range(n)}
    score = dict.fromkeys(range(n), 1 / n)
    for _ in range(rounds):
        lost = sum(score[i] for i in range(n) if not out[i])
        new = dict.fromkeys(range(n), 0.15 / n + 0.85 * lost / n)
        for a, b in kept:
            new[b] += 0.85 * score[a] / out[a]
        score = new
    got = {r.id: r.score for r in graph.pagerank(spark.range(n), df, rounds=rounds).collect()}
    assert all(abs(got[i] - score[i]) < 1e-12 for i in range(n))
