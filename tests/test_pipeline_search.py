"""The search over pipelines: its grammar, its selection, and that it repeats."""

from __future__ import annotations

import numpy as np

from covey.operators import models
from covey.operators import pipeline_search as ps


def test_variation_stays_in_the_grammar(spark):
    rng, p = np.random.default_rng(1), ps.Search(longest=2, classifiers=("LinearSVC", "NaiveBayes"))
    pipelines = [ps.random_pipeline(rng, p) for _ in range(40)]
    for _ in range(300):
        a, b = (pipelines[i] for i in rng.integers(len(pipelines), size=2))
        pipelines += [ps.mutated(rng, a, p), ps.crossed(rng, a, b, p)]
    for steps in pipelines[::7]:
        assert 1 <= len(steps) <= 3 and steps[-1][0] in p.classifiers and all(name in ps.PREPARE for name, _ in steps[:-1])
        for name, values in steps:
            kind = ps.PREPARE.get(name) or ps.CLASSIFY[name]
            assert all(v in options for v, options in zip(values, kind.values.values(), strict=True))
        assert ps.described(steps).startswith(steps[-1][0]) and len(ps.built(steps, ["a"])) == len(steps) + 1


def test_fronts_prefer_scores_and_few_steps():
    one, two, three = ((("LinearSVC", (1.0,)),), (("MinMaxScaler", ()), ("LinearSVC", (1.0,))), (("MinMaxScaler", ()), ("PCA", (2,)), ("LinearSVC", (1.0,))))
    assert ps.fronts({one: 0.7, two: 0.9, three: 0.8}) == [two, one, three]
    assert ps.fronts({one: 0.9, two: 0.9}) == [one, two]


def test_a_search_finds_a_good_pipeline_and_repeats(spark):
    rng = np.random.default_rng(3)
    x = rng.random((160, 3))
    rows = spark.createDataFrame([(i, float((a - 0.5) * (b - 0.5) > 0), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)], "cid long, label double, a double, b double, c double").cache()
    p = ps.Search(generations=1, population=3, folds=2, longest=1, classifiers=("LogisticRegression", "RandomForest"), seed=6)
    registry, best = ps.search_pipelines(rows, ["a", "b", "c"], "cid", p)
    found = sorted(map(tuple, registry.collect()))
    assert len({t for *_, t in found}) == len(found) >= 4
    top = models.best_classifier(registry).first()
    assert top.pipeline == ps.described(best) and top.score > 0.8 and best[-1][0] == "RandomForest"
    assert {r.family for r in models.best_pipeline_per_family(registry).collect()} <= {"LogisticRegression", "RandomForest"}
    again, _ = ps.search_pipelines(rows, ["a", "b", "c"], "cid", p)
    assert sorted(map(tuple, again.collect())) == found
