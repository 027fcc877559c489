"""Search over pipelines: a grammar of steps, varied and selected over generations.

A pipeline is some preparing steps and a classifier, each with values from a short
list.  Generations vary the better pipelines by changing a value, adding or leaving
out a step, another classifier, or crossing two of them, and keep those that no other
beats in both score and number of steps, then the next such front, until the
population is full.  All candidates are scored on the same stored folds, several at
a time from driver threads, and none twice.  Draws come from one seeded generator,
so a search repeats.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import PCA, MinMaxScaler, Normalizer, PolynomialExpansion, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame

from ..sources.scratch import forget, stored
from .extra_trees import ExtraTrees, Forest
from .metrics import average_precision
from .models import Classifier, fit_stages
from .training import stratified_folds

#: A step is its name and its values, in the order of their lists; a pipeline is a tuple of steps, the classifier last.
Step = tuple[str, tuple]
Steps = tuple[Step, ...]


@dataclass(frozen=True)
class Kind:
    """A step of the grammar: the lists its values come from, and how to build it between two columns."""

    values: dict[str, list]
    build: Callable


def _selected(i: str, o: str, mode: str, threshold: float):
    return UnivariateFeatureSelector(featuresCol=i, outputCol=o, labelCol="label", selectionMode=mode).setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(threshold)


PREPARE = {
    "StandardScaler": Kind({"mean": [True, False]}, lambda i, o, mean: StandardScaler(inputCol=i, outputCol=o, withMean=mean)),
    "MinMaxScaler": Kind({}, lambda i, o: MinMaxScaler(inputCol=i, outputCol=o)),
    "Normalizer": Kind({"p": [1.0, 2.0, float("inf")]}, lambda i, o, p: Normalizer(inputCol=i, outputCol=o, p=p)),
    "VarianceThreshold": Kind({"least": [1e-4, 1e-3, 1e-2]}, lambda i, o, least: VarianceThresholdSelector(featuresCol=i, outputCol=o, varianceThreshold=least)),
    "PolynomialFeatures": Kind({}, lambda i, o: PolynomialExpansion(inputCol=i, outputCol=o, degree=2)),
    "PCA": Kind({"k": [2, 3]}, lambda i, o, k: PCA(inputCol=i, outputCol=o, k=k)),
    "Select": Kind({"mode": ["fpr", "fdr", "fwe"], "threshold": [0.01, 0.05, 0.2]}, _selected),
}
CLASSIFY = {
    "LogisticRegression": Kind({"penalty": [1e-4, 1e-2, 1.0]}, lambda i, penalty: LogisticRegression(featuresCol=i, regParam=penalty)),
    "LinearSVC": Kind({"penalty": [1e-4, 1e-2, 1.0]}, lambda i, penalty: LinearSVC(featuresCol=i, regParam=penalty, maxIter=50)),
    "NaiveBayes": Kind({"smoothing": [0.1, 1.0, 10.0]}, lambda i, smoothing: NaiveBayes(featuresCol=i, smoothing=smoothing)),
    "RandomForest": Kind({"trees": [20, 100], "depth": [5, 8]}, lambda i, trees, depth: RandomForestClassifier(featuresCol=i, numTrees=trees, maxDepth=depth, seed=1)),
    "GradientBoosting": Kind({"rounds": [10, 20], "depth": [3, 5]}, lambda i, rounds, depth: GBTClassifier(featuresCol=i, maxIter=rounds, maxDepth=depth, seed=1)),
    "ExtraTrees": Kind({"trees": [20, 100], "leaf": [1, 5]}, lambda i, trees, leaf: ExtraTrees(Forest(trees=trees, leaf=leaf, seed=1))._set(featuresCol=i)),
}


@dataclass(frozen=True)
class Search:
    """Parameters of a search."""

    generations: int = 5
    population: int = 20
    folds: int = 5
    #: Preparing steps of a pipeline at most.
    longest: int = 3
    #: Share of new pipelines that come from crossing two; the others are changed ones.
    crossing: float = 0.1
    classifiers: tuple[str, ...] = tuple(CLASSIFY)
    #: Candidates that are fitted at a time.
    at_once: int = 4
    seed: int = 0


def _step(rng: np.random.Generator, name: str) -> Step:
    values = (PREPARE.get(name) or CLASSIFY[name]).values
    return name, tuple(options[rng.integers(len(options))] for options in values.values())


def random_pipeline(rng: np.random.Generator, p: Search) -> Steps:
    """Any pipeline of the grammar."""
    prepare = [_step(rng, str(rng.choice(list(PREPARE)))) for _ in range(rng.integers(0, p.longest + 1))]
    return (*prepare, _step(rng, str(rng.choice(p.classifiers))))


def mutated(rng: np.random.Generator, steps: Steps, p: Search) -> Steps:
    """The pipeline with one thing changed."""
    prepare, last = list(steps[:-1]), steps[-1]
    how = rng.integers(4)
    if how == 0 and len(prepare) < p.longest:
        prepare.insert(rng.integers(len(prepare) + 1), _step(rng, str(rng.choice(list(PREPARE)))))
    elif how == 1 and prepare:
        prepare.pop(rng.integers(len(prepare)))
    elif how == 2:
        last = _step(rng, str(rng.choice(p.classifiers)))
    else:
        at = rng.integers(len(steps))
        changed = _step(rng, steps[at][0])
        prepare, last = [*steps[:at], changed, *steps[at + 1 :]][:-1], changed if at == len(steps) - 1 else last
    return (*prepare, last)


def crossed(rng: np.random.Generator, a: Steps, b: Steps, p: Search) -> Steps:
    """The beginning of one pipeline with the end of another."""
    return (*a[: rng.integers(len(a))], *b[rng.integers(len(b)) :])[-p.longest - 1 :]


def described(steps: Steps) -> str:
    """A pipeline as text, the classifier outside: ``Classifier(Scaler(input, mean=True), trees=20)``."""
    text = "input"
    for name, values in steps:
        names = (PREPARE.get(name) or CLASSIFY[name]).values
        text = f"{name}({', '.join([text, *(f'{k}={v}' for k, v in zip(names, values, strict=True))])})"
    return text


def built(steps: Steps, columns: list[str]) -> list:
    """Spark ML stages of a pipeline."""
    stages, column = [VectorAssembler(inputCols=columns, outputCol="v0")], "v0"
    for i, (name, values) in enumerate(steps[:-1], 1):
        stages.append(PREPARE[name].build(column, f"v{i}", *values))
        column = f"v{i}"
    name, values = steps[-1]
    return [*stages, CLASSIFY[name].build(column, *values)]


def fronts(scores: dict[Steps, float]) -> list[Steps]:
    """Pipelines front by front: those that none beats in score with as few steps, or in steps with as good a score; within a front by score."""
    left, out = dict(scores), []
    while left:
        best = [s for s, v in left.items() if not any((w >= v and len(t) < len(s)) or (w > v and len(t) <= len(s)) for t, w in left.items())]
        out += sorted(best, key=lambda s: (-left[s], len(s), described(s)))
        left = {s: v for s, v in left.items() if s not in set(best)}
    return out


def search_pipelines(rows: DataFrame, columns: list[str], key: str, p: Search = Search()) -> tuple[DataFrame, Steps]:
    """``classifier, score, pipeline`` of all pipelines that were tried, and the one with the best score, of equal ones the shortest.

    ``rows(label, key, *columns)``; a score is the mean average precision over the folds.
    A pipeline that cannot be fitted, as one with nothing selected, scores 0.
    """
    rng = np.random.default_rng(p.seed)
    dealt = stored(stratified_folds(rows, "label", key, p.folds))
    sides = [(stored(dealt.filter(f"fold <> {i}")), stored(dealt.filter(f"fold = {i}"))) for i in range(p.folds)]
    tried: dict[Steps, float] = {}

    def scored(steps: Steps) -> float:
        found = []
        for fit, rest in sides:
            try:
                fitted: Classifier = fit_stages(built(steps, columns), fit)
                found.append(average_precision(fitted.score(rest).select("label", "score")).first().average_precision)
            except Exception as error:  # noqa: BLE001
                if not any(word in str(error) for word in ("Nonnegative", "nonnegative", "requirement failed", "IllegalArgument")):
                    raise
                return 0.0
        return float(np.mean(found))

    population = [random_pipeline(rng, p) for _ in range(p.population)]
    with ThreadPoolExecutor(p.at_once) as pool:
        for generation in range(p.generations + 1):
            fresh = [s for s in dict.fromkeys(population) if s not in tried]
            tried |= zip(fresh, pool.map(scored, fresh), strict=True)
            kept = fronts({s: tried[s] for s in dict.fromkeys(population)})[: p.population]
            if generation == p.generations:
                break
            new = []
            for _ in range(p.population):
                a, b = (min(rng.integers(len(kept), size=2)) for _ in range(2))  # the better of two draws
                new.append(crossed(rng, kept[a], kept[b], p) if rng.random() < p.crossing else mutated(rng, kept[a], p))
            population = [*kept, *new]
    forget(dealt, *(t for side in sides for t in side))
    best = min(tried, key=lambda s: (-tried[s], len(s), described(s)))
    table = [(s[-1][0], v, described(s)) for s, v in tried.items()]
    return rows.sparkSession.createDataFrame(table, "classifier string, score double, pipeline string"), best
