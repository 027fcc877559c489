"""Components of splits and matchings see no more links than they need."""

import itertools

import pytest
from pyspark.sql import functions as F

from covey.operators import graph, metrics, overlap, training
from covey.operators.components import components


def _spy(monkeypatch, module, name):
    seen, real = [], getattr(module, name)

    def spied(rows, *more):
        seen.append(rows.count())
        return real(rows, *more)

    monkeypatch.setattr(module, name, spied)
    return seen


def test_a_split_links_communities_over_shared_edges_only(spark, monkeypatch):
    groups = {i: {10 * i, 10 * i + 1, 10 * i + 2} for i in range(30)} | {30: {0, 1, 5}, 31: {0, 1, 6}, 32: {7}}
    known = spark.createDataFrame([(c, x) for c, g in groups.items() for x in g], "cid long, node long")
    edges = spark.createDataFrame(sorted({(*e, 1.0) for g in groups.values() for e in itertools.combinations(sorted(g), 2)}), "src long, dst long, weight double")
    induced = graph.induced_edges(edges, known).cache()
    # The parts as they are over all communities and edges.
    c, e = F.xxhash64(F.lit("c"), "cid"), F.xxhash64(F.lit("e"), "src", "dst")
    plain = known.select("cid").distinct().join(components(induced.select(c.alias("a"), e.alias("b"))), c == F.col("node"), "left").select("cid", F.coalesce("component", c).alias("part"))
    named, real = [], training.running_sums
    monkeypatch.setattr(training, "running_sums", lambda rows, *more: named.extend(r.part for r in rows.collect()) or real(rows, *more))
    seen = _spy(monkeypatch, training, "components")
    sides = {r.cid: r.train for r in training.independent_split(induced, known).collect()}
    assert seen == [2] and sorted(named) == sorted({r.part for r in plain.collect()})
    assert len(sides) == 33 and sides[0] == sides[30] == sides[31]


def _overlaps(spark):
    known = {i: {4 * (i % 3) + x for x in range(1 + i % 4)} for i in range(12)}
    predicted = {i: {4 * (i % 3) + x for x in range(4 - i % 4)} for i in range(9)}
    k, p = (spark.createDataFrame([(c, x) for c, g in groups.items() for x in g], f"{key} long, node long") for key, groups in (("kid", known), ("pid", predicted)))
    return overlap.overlaps(k, p).cache(), overlap.sizes(k, "kid", "n")


def test_components_of_a_matching_come_from_few_links(spark, monkeypatch):
    pairs, _ = _overlaps(spark)
    seen = _spy(monkeypatch, metrics, "components")
    found = metrics.match_communities(pairs)
    assert seen[0] <= 9 < pairs.count()
    assert found.select("kid").distinct().count() == found.count() == 9


@pytest.mark.parametrize("task_pairs", [2_000_000, 8])
def test_all_steps_of_a_curve_are_matched_in_one_task(spark, monkeypatch, task_pairs):
    pairs, known = _overlaps(spark)
    scored = spark.createDataFrame([(i, i / 9) for i in range(9)], "pid long, score double")
    expected = [(metrics.match_communities(pairs.filter(F.col("pid") >= low)).agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]) / 12 for low in (0, 2, 4, 6)]
    seen = _spy(monkeypatch, metrics, "_parts")
    found = {r.step: r.recall for r in metrics.matching_curve(pairs, known, scored, 4, task_pairs).collect()}
    assert seen[0] == pairs.count() and (len(seen) == 1) == (task_pairs > 8)
    assert [found[i] for i in range(4)] == pytest.approx(expected, abs=1e-4)
