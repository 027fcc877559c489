"""What growth holds on disk: neighbours in a few bytes each, and no shuffle files of tables that are stored."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from covey.operators import graph, search
from covey.plans.catalog import dense_score
from covey.sources.scratch import stored


@pytest.mark.parametrize("nbr", [[], [7], [5, -3, 1 << 62, -(1 << 62), 0], ["b", "a", 'quo"te', "ä"]])
def test_lists_come_back_as_they_were(nbr):
    nbr = np.array(nbr, dtype=object if nbr and isinstance(nbr[0], str) else np.int64)
    weight = np.arange(len(nbr)) % 2 + 0.5
    got = search.unpack(search.pack(nbr, weight))
    assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == sorted(zip(nbr.tolist(), weight.tolist(), strict=True))


def test_a_neighbour_takes_a_few_bytes(spark):
    rng = np.random.default_rng(1)
    rows = [(node, int(x), float(rng.integers(1, 3))) for node in range(20) for x in rng.choice(1_000_000, 200, replace=False)]
    lists = search._lists(spark.createDataFrame(rows, "node long, nbr long, weight double"), ["node"])
    n, size = lists.agg(F.sum("n"), F.sum(F.length("near"))).first()
    assert n == 4000 and size < 4 * n


def test_names_grow_as_numbers_do(spark):
    rng = np.random.default_rng(3)
    edges = sorted({tuple(sorted(x)) for x in rng.integers(10, 40, (120, 2)).tolist() if x[0] != x[1]})
    grown = {}
    for kind, of in (("long", int), ("string", str)):  # numbers of two digits are in the same order as their names
        neighbours = graph.adjacency(spark.createDataFrame([(of(a), of(b), 1.0) for a, b in edges], f"src {kind}, dst {kind}, weight double")).cache()
        found = search.grow(neighbours.select("node"), neighbours, dense_score, search.Growth(max_size=5, threshold=0.3, explore=0.0))
        grown[kind] = sorted((tuple(map(int, r.members)), round(r.score, 9)) for r in found.collect())
    assert grown["long"] == grown["string"]


def test_what_was_shuffled_goes_with_the_write(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = stored(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s")))
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert table.count() == 997


def test_cliques_are_looked_for_after_one_shuffle(spark):
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)] + [(3, 4), (4, 5), (3, 5)], "src long, dst long")
    found = search.maximal_cliques(edges)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r.members) for r in found.collect()) == [(0, 1, 2, 3), (3, 4, 5)]
