"""Independent splits with a wanted share, and cliques by a peeling order."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from test_graph import edges_of

from covey.operators import graph, search, training


def split_of(spark, groups, pairs, share, seed=0):
    own = spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "cid long, node string")
    induced = graph.induced_edges(edges_of(spark, pairs), own).cache()
    sides = {r.cid: r.train for r in training.independent_split(induced, own, share, seed).collect()}
    assert len(sides) == len(groups)
    edges = {True: set(), False: set()}
    for r in induced.collect():
        edges[sides[r.cid]].add((r.src, r.dst))
    assert not edges[True] & edges[False]
    return sum(sides.values()) / len(sides)


def test_shares_are_met_with_large_and_small_components(spark):
    groups, pairs = [], []
    for c, n in enumerate([60, 45, 30, 10]):  # components of communities that share an edge
        for i in range(n):
            groups.append([f"h{c}a", f"h{c}b", f"x{c}_{i}"])
        pairs.append((f"h{c}a", f"h{c}b"))
        pairs += [(f"h{c}a", f"x{c}_{i}") for i in range(n)]
    for i in range(155):
        groups.append([f"s{i}a", f"s{i}b", f"s{i}c"])
        pairs += [(f"s{i}a", f"s{i}b"), (f"s{i}b", f"s{i}c")]
    for share in (0.5, 0.7, 0.9):
        assert split_of(spark, groups, pairs, share, seed=3) == pytest.approx(share, abs=0.01)


def test_one_giant_component_stays_whole(spark):
    groups = [["a", "b", f"x{i}"] for i in range(180)] + [[f"s{i}", f"t{i}", f"u{i}"] for i in range(20)]
    pairs = [("a", "b"), *((f"s{i}", f"t{i}") for i in range(20))]
    assert split_of(spark, groups, pairs, 0.7) in (0.9, 0.1)


def test_choice_of_large_components():
    assert training._chosen([50, 30, 20], 70, 0) == [True, False, True]
    assert training._chosen([], 7, 10) == []
    taken = training._chosen([40, 40], 50, 20)
    assert sum(taken) == 1


def plain_cliques(pairs):
    nbrs = {}
    for a, b in pairs:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    found = []

    def grow(clique, open_, shut):
        if not open_ and not shut:
            found.append(tuple(sorted(clique)))
        for x in list(open_):
            grow([*clique, x], open_ & nbrs[x], shut & nbrs[x])
            open_, shut = open_ - {x}, shut | {x}

    grow([], set(nbrs), set())
    return sorted(found)


def test_cliques_of_random_networks_and_hubs(spark):
    rng = np.random.default_rng(6)
    for n, m in ((9, 20), (25, 90), (40, 80)):
        pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, n, (m, 2)) if p[0] != p[1]}
        pairs |= {(x, 1000) for x in range(n)}  # a hub next to all
        pairs |= {(x, 2000 + x) for x in range(n)}
        edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src long, dst long, weight double")
        want = plain_cliques(pairs)
        assert sorted(tuple(r.members) for r in search.maximal_cliques(edges, 2).collect()) == want
        assert sorted(tuple(r.members) for r in search.maximal_cliques(edges, 3, 4).collect()) == [c for c in want if 3 <= len(c) <= 4]
    assert search.maximal_cliques(edges.limit(0)).count() == 0


def test_a_task_holds_no_more_than_the_degeneracy_allows(spark):
    pairs = [("hub", f"x{i:03}") for i in range(300)] + [(f"k{a}", f"k{b}") for a, b in combinations(range(5), 2)] + [("hub", "k0")]
    turn = {r.node: (r.turn, r.node) for r in search.peeling_order(edges_of(spark, pairs)).collect()}
    later = {}
    for a, b in pairs:
        later.setdefault(min(a, b, key=turn.get), []).append(b)
    assert max(map(len, later.values())) <= 2 * 1.5 * 4 and len(turn) == 306


def test_cliques_of_a_node_with_earlier_neighbours():
    """An earlier node joined to all of a clique tells that it isn't maximal, without a look at other tasks."""
    own = pd.DataFrame({"src": [2, 3, 4, 1], "others": [np.array([3, 4]), np.array([], int), np.array([], int), np.array([2, 3])]})
    assert sorted(search._cliques_of((1,), own)) == [[1, 2, 4]]
    assert sorted(search._cliques_of((1,), own[:3])) == [[1, 2, 3], [1, 2, 4]]
