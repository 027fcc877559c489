"""Growth from lists of neighbours: the heaviest few of each node are enough, and a long list is several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covey.operators import graph, search
from covey.plans.catalog import dense_score


def network(spark, seed=4, n=30):
    """Random edges of few weights, so that many are equal, and a hub."""
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(x)) for x in rng.integers(0, n, (4 * n, 2)).tolist() if x[0] != x[1]} | {(0, i) for i in range(1, n)}
    edges = {p: float(rng.integers(1, 4)) for p in sorted(pairs)}
    return edges, graph.adjacency(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")).cache()


def plain_heaviest(edges, seed, most, threshold):
    """The search of one seed, a neighbour at a time."""
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    members, score = [seed, min(near[seed], key=lambda x: (-near[seed][x], x))], 0.0
    while len(members) < most:
        around = [(-w, x) for m in members for x, w in near[m].items() if x not in members]
        if not around:
            break
        both = [*members, min(around)[1]]
        dens = 2 * sum(a in both and b in both for a, b in edges) / (len(both) * (len(both) - 1))
        if dens < threshold:
            break
        members, score = both, dens
    return tuple(sorted(members)), round(score, 9)


@pytest.mark.parametrize("few", [0, 200_000])
def test_heaviest_growth_keeps_few_neighbours(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    edges, neighbours = network(spark)
    lists = search._heaviest(neighbours, 5)
    assert lists.agg(F.max(F.size("near"))).first()[0] == 5
    got = {r.seed: (tuple(r.members), round(r.score, 9)) for r in search.grow(neighbours.select("node"), neighbours, dense_score, search.Growth(method="heaviest", max_size=5, threshold=0.5)).collect()}
    assert got == {x: plain_heaviest(edges, x, 5, 0.5) for x in {a for e in edges for a in e}}


@pytest.mark.parametrize("method", ["top", "metropolis"])
def test_long_lists_grow_the_same(spark, monkeypatch, method):
    _, neighbours = network(spark, 5, 20)
    run = lambda: sorted((r.seed, tuple(r.members), r.score) for r in search.grow(neighbours.select("node"), neighbours, dense_score, search.Growth(method=method, max_size=5, threshold=0.5, explore=0.3)).collect())
    whole = run()
    monkeypatch.setattr(search, "LISTED", 3)
    monkeypatch.setattr(search, "BLOCK_LINKS", 9)
    assert run() == whole
