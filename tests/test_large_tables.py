"""Steps that have to stay in proportion to their input, against plain ones on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from covey.operators import graph, overlap


def _communities(count, nodes, most, seed):
    draw = random.Random(seed)
    return {c: set(draw.sample(range(nodes), draw.randint(1, most))) for c in range(count)}


def _table(spark, groups, key):
    return spark.createDataFrame([(c, x) for c, g in groups.items() for x in g], f"{key} long, node long")


@pytest.mark.parametrize("most", [6, 50])
def test_best_matches_need_only_some_overlaps(spark, most):
    known, predicted = _communities(60, 60, most, 1), _communities(50, 60, most, 2)
    k, p = _table(spark, known, "kid"), _table(spark, predicted, "pid")
    every = {(a, b): len(x & y) for (a, x), (b, y) in itertools.product(known.items(), predicted.items()) if x & y}
    found = overlap.best_overlaps(k, p).cache()
    rows = {(r.kid, r.pid): r for r in found.collect()}
    assert {q for q, c in every.items() if c > 1} <= set(rows) <= set(every)
    assert all((r.c, r.nk, r.np) == (every[q], len(known[q[0]]), len(predicted[q[1]])) for q, r in rows.items())
    assert most > 32 or len(rows) < len(every)
    for of in ("kid", "pid"):
        for by in ("f1", "na", "jaccard"):
            best, plain = (overlap.best_matches(overlap.measures(x), of, by).select("kid", "pid", "c").collect() for x in (found, overlap.overlaps(k, p)))
            assert sorted(best) == sorted(plain)
    totals = {r.pid: r.total for r in overlap.met_members(k, p).collect()}
    assert totals == {b: sum(c for (_, y), c in every.items() if y == b) for b in {q[1] for q in every}}


def test_overlaps_over_several_lists_of_a_node(spark, monkeypatch):
    monkeypatch.setattr(overlap, "TOGETHER", 4)
    groups = _communities(40, 15, 9, 3)
    pairs = {(r.cid1, r.cid2): (r.c, r.n1, r.n2) for r in overlap.self_overlaps(_table(spark, groups, "cid")).collect()}
    assert pairs == {(a, b): (len(groups[a] & groups[b]), len(groups[a]), len(groups[b])) for a, b in itertools.combinations(groups, 2) if groups[a] & groups[b]}
    # Pairs meet as lists, a row for each community, member and list.
    assert "sort_array" in overlap.self_overlaps(_table(spark, groups, "cid"))._jdf.queryExecution().optimizedPlan().toString()


def test_edges_inside_small_and_large_communities(spark):
    draw = random.Random(4)
    edges = {tuple(sorted(draw.sample(range(120), 2))): 1.0 for _ in range(900)}
    groups = {0: set(range(100)), 1: set(range(60, 70)), 2: {1}, 3: set(draw.sample(range(120), 64)), 4: set(draw.sample(range(120), 65))}
    table = spark.createDataFrame([(*e, w) for e, w in edges.items()], "src long, dst long, weight double")
    found = graph.induced_edges(table, _table(spark, groups, "cid"))
    expected = {(c, a, b) for c, g in groups.items() for a, b in edges if a in g and b in g}
    assert sorted((r.cid, r.src, r.dst) for r in found.collect()) == sorted(expected)


def test_small_communities_do_not_meet_all_edges_of_their_members(spark):
    # A hub with 3,000 edges in 300 communities of three: 900 pairs are looked up, not 900,000 edges of the hub.
    edges = spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    own = _table(spark, {c: {0, 2 * c + 1, 2 * c + 2} for c in range(300)}, "cid")
    found = graph.induced_edges(edges, own)
    assert found.count() == 600
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert not any(line.strip(" :+-").startswith("Join Inner, (src") and "dst" not in line for line in joins)
