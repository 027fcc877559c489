"""Sampled clique comparison against all subsets and plain readings."""

from __future__ import annotations

from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
import pytest

from covey.operators import clique_samples, metrics


def rows(spark, groups, key):
    return spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], f"{key} long, node string")


def plain(known, predicted, k, weighted, excluded=()):
    inside = set().union(*known)
    predicted = [set(p) & inside for p in predicted]

    def side(own, other):
        weight = {}
        for g in own:
            for c in combinations(sorted(g), k):
                w = len(g) / comb(len(g), k)
                weight[c] = min(w, weight.get(c, w))
        hit = miss = 1e-5
        for c, w in weight.items():
            w = w if weighted else 1
            if any(set(c) <= set(o) for o in other):
                hit += w
            elif own is known or not any(set(c) <= set(x) for x in excluded):
                miss += w
        return hit, miss

    return *side(predicted, known), *side(known, predicted)


KNOWN = [list("abcdef"), list("cdefg"), list("hijk"), list("xyz"), list("ab")]
FOUND = [list("abcde"), list("defgh"), list("hijkl"), list("xyzq"), list("mno"), list("a")]


@pytest.mark.parametrize("weighted", [True, False])
def test_many_samples_give_all_subsets(spark, weighted):
    known, found = rows(spark, KNOWN, "kid"), rows(spark, FOUND, "pid")
    hidden = rows(spark, [list("gh")], "kid")
    curve = {r.k: r for r in clique_samples.sampled_clique_curve(known, found, 4000, weighted=weighted, seed=3, excluded=hidden).collect()}
    assert sorted(curve) == [2, 3, 4, 5]
    sums = np.zeros(4)
    for k, r in curve.items():
        want = np.array(plain(KNOWN, FOUND, k, weighted, [list("gh")]))
        assert np.allclose((r.tp, r.fp, r.known_tp, r.fn), want, atol=1e-9)
        sums += want
        assert (r.precision, r.recall) == pytest.approx((want[0] / (want[0] + want[1]), want[2] / (want[2] + want[3])))
        assert (r.cumulative_precision, r.cumulative_recall) == pytest.approx((sums[0] / (sums[0] + sums[1]), sums[2] / (sums[2] + sums[3])))
    assert [curve[k].n_communities for k in (2, 3, 4, 5)] == [4, 4, 3, 2]


def test_sizes_beyond_the_known_and_empty_tables(spark):
    known, found = rows(spark, [list("abc"), list("de")], "kid"), rows(spark, [list("abcde")], "pid")
    curve = {r.k: r for r in clique_samples.sampled_clique_curve(known, found, 500).collect()}
    assert sorted(curve) == [2, 3, 4, 5] and curve[4].tp == 0 and curve[5].n_communities == 0 and curve[4].f1 == pytest.approx(1e-5 / (500 + 2e-5))
    assert sorted(r.k for r in clique_samples.sampled_clique_curve(known, found, 500, max_clique=3).collect()) == [2, 3]
    assert clique_samples.sampled_clique_curve(known, found.limit(0)).count() == 0
    row = metrics.clique_summary(clique_samples.sampled_clique_curve(known, found, 500)).first()
    assert 0 < row.precision < 1 and row.weighted_recall > 0.9


def test_draws_fall_by_the_number_of_subsets_and_evenly_on_members(spark):
    big, small = [f"m{i:03}" for i in range(200)], list("abcdefghij")
    drawn = clique_samples.clique_samples(rows(spark, [big, small], "pid"), "pid", 60, 3000, 1).filter("k in (2, 50)").collect()
    two = [r.subset for r in drawn if r.k == 2]
    assert sum(s[0][0] == "m" for s in two) == pytest.approx(comb(200, 2) / (comb(200, 2) + comb(10, 2)) * len(two), abs=25)
    fifty = [r.subset for r in drawn if r.k == 50]
    assert len(fifty) == 3000 and all(len(set(s)) == 50 for s in fifty)
    uses = np.array(list(Counter(x for s in fifty for x in s).values()))
    assert len(uses) == 200 and abs(uses - 750).max() < 130
    again = clique_samples.clique_samples(rows(spark, [big, small], "pid").repartition(7), "pid", 60, 3000, 1).filter("k in (2, 50)").collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))


def test_samples_are_near_the_exact_form(spark):
    rng = np.random.default_rng(4)
    nodes = [f"n{i}" for i in range(60)]
    known = [list(rng.choice(nodes, 12, False)) for _ in range(12)]
    found = [list({*g[:9], *rng.choice(nodes, 3)}) for g in known]
    k, p = rows(spark, known, "kid"), rows(spark, found, "pid")
    sampled = {r.k: r for r in clique_samples.sampled_clique_curve(k, p, 3000, 4).collect()}
    for r in clique_samples.exact_clique_curve(k, p, 4).collect():
        assert (sampled[r.k].precision, sampled[r.k].recall) == pytest.approx((r.precision, r.recall), abs=0.05)
        assert sampled[r.k].n_communities == r.n_communities
