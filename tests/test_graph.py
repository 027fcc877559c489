"""Sources, features and the whole way on small graphs."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from covey.functions import sets
from covey.operators import features, graph, merge, metrics, models, overlap, ranges, search, training
from covey.operators.components import Forest, components
from covey.plans import detect
from covey.plans.catalog import dense_score as density
from covey.sources import sinks, text


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")


def members_of(spark, groups):
    return spark.createDataFrame([(i, x) for i, g in enumerate(groups) for x in g], "cid long, node string")


SHAPES = {
    "K4": (list(combinations("abcd", 2)), [1, 4, 3, 3, 3, 0, 1, 1, 0, 1, 1, 0, 3, 0, 3, 3, 1, 1]),
    "K3": (list(combinations("abc", 2)), [1, 3, 2, 2, 2, 0, 1, 1, 0, 1, 1, 0, 2, 0, 2, 2, 1, 1]),
    "path3": ([("a", "b"), ("b", "c")], [2 / 3, 3, 2, 4 / 3, 1, 2 / 9, 0, 0, 0, 1, 1, 0, 5 / 3, 2 / 9, 2, math.sqrt(2), math.sqrt(2), 0]),
    "cycle4": ([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")], [2 / 3, 4, 2, 2, 2, 0, 0, 0, 0, 1, 1, 0, 2, 0, 2, 2, 2, 0]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_golden_features(spark, shape):
    pairs, want = SHAPES[shape]
    own = members_of(spark, [sorted({x for p in pairs for x in p})])
    row = features.all_features(graph.induced_edges(edges_of(spark, pairs), own), own).first()
    assert np.allclose([row[c] for c in text.FEATURES], want, atol=1e-9)
    plain = search.subgraph_features(sorted({x for p in pairs for x in p}), {p: 1.0 for p in pairs})
    assert np.allclose([plain[c] for c in text.FEATURES], want, atol=1e-9)


def test_readers(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("a b 2\nb a 3\na a 1\n# note\nb c\n")
    edges = graph.canonical_edges(text.read_edges(spark, str(tmp_path / "edges.txt")))
    assert sorted(map(tuple, edges.collect())) == [("a", "b", 3.0), ("b", "c", 1.0)]
    (tmp_path / "groups.txt").write_text("a b c \nNone a b\n\nx y z\n")
    groups = text.read_communities(spark, str(tmp_path / "groups.txt"))
    assert sorted(sorted(r.members) for r in groups.collect()) == [["a", "b"], ["a", "b", "c"], ["x", "y", "z"]]
    kept = graph.clean_communities(groups, edges).collect()
    assert [r.members for r in kept] == [["a", "b", "c"]]
    (tmp_path / "pred.txt").write_text("a b 0.5\nc d e 0.25\n")
    assert sorted((sorted(r.members), r.score) for r in text.read_predictions(spark, str(tmp_path / "pred.txt")).collect()) == [(["a", "b"], 0.5), (["c", "d", "e"], 0.25)]
    assert {r.score for r in text.read_predictions(spark, str(tmp_path / "pred.txt"), scored=False).collect()} == {1.0}
    (tmp_path / "names.tsv").write_text("id\tname\n1\tone\n1\tuno\n2\t-\n")
    assert sorted(map(tuple, text.read_id_names(spark, str(tmp_path / "names.tsv")).collect())) == [("1", "uno"), ("2", "-")]
    (tmp_path / "log.txt").write_text("F1 = 0.5\nF1 = -1\nx = 2\nF1 = 0.75\nno number = a\n")
    assert dict(map(tuple, text.read_metrics(spark, str(tmp_path / "log.txt")).collect())) == {"F1": 0.75, "x": 2.0}
    (tmp_path / "blocks.txt").write_text("a\n\nb\nc\n\nd\n")
    assert sorted((r.block, r.value) for r in text.read_blocks(spark, str(tmp_path / "blocks.txt")).collect()) == [(0, "a"), (1, "b"), (1, "c"), (2, "d")]
    (tmp_path / "pairs.txt").write_text("b a 1\na b 2\nbad\n")
    assert [tuple(r) for r in text.read_pair_scores(spark, str(tmp_path / "pairs.txt")).collect()] == [("a", "b", 2.0)]
    (tmp_path / "index.txt").write_text("p : c1 c2\n")
    assert sorted(map(tuple, text.read_index(spark, str(tmp_path / "index.txt")).collect())) == [("p", "c1"), ("p", "c2")]
    sinks.write_communities(groups, str(tmp_path / "out"))
    assert text.read_communities(spark, str(tmp_path / "out")).count() == 3


def test_zip_by_place(spark):
    left = spark.createDataFrame([(i, f"l{i}") for i in range(20)], "a int, l string").repartition(3)
    right = spark.createDataFrame([(i * 2, f"r{i}") for i in range(20)], "b int, r string").repartition(4)
    assert all(r.l[1:] == r.r[1:] for r in text.zip_by_place(left, right, "a", "b").collect())


def test_zip_by_place_whole(spark):
    n = 500_000
    left = spark.range(n).select((F.col("id") * 7919 % n).alias("a"), F.col("id").alias("x"))
    right = spark.range(n).select((F.col("id") * 104729 % n * 2).alias("b"))
    row = text.zip_by_place(left, right, "a", "b").agg(F.count("*").alias("n"), F.sum((F.col("a") * 2 != F.col("b")).cast("int")).alias("wrong"), F.countDistinct("place").alias("places")).first()
    assert tuple(row) == (n, 0, n)


def test_last_line_wins_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("u v 1\n")
    (tmp_path / "b.txt").write_text("u v 2\n" + "# long\n" * 1000)
    (tmp_path / "c.txt").write_text("v u 3\nx y\n")
    a, b, c = (str(tmp_path / f"{x}.txt") for x in "abc")
    for order, want in (([a, b, c], 3.0), ([c, b, a], 1.0), ([a, c, b], 2.0)):
        assert {(r.src, r.dst): r.weight for r in graph.canonical_edges(text.read_edges(spark, order)).collect()}["u", "v"] == want
        assert {(r.a, r.b): r.score for r in text.read_pair_scores(spark, order).collect()}["u", "v"] == want


def test_ranges(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=3000), 1)
    table = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    assert np.allclose(list(ranges.percentile(table, "v", [0.02, 0.25, 0.5, 1.0]).first()), np.quantile(values, [0.02, 0.25, 0.5, 1.0]))
    assert list(ranges.percentile(table.limit(0), "v", [0.5]).first()) == [None]


def test_set_measures(spark):
    row = spark.sql("select array(1,2,3,4) a, array(3,4,5,6) b, cast(array() as array<int>) e")
    got = row.select(sets.jaccard_arrays(row.a, row.b).alias("x"), sets.jaccard_arrays(row.e, row.e).alias("y")).first()
    assert got.x == pytest.approx(1 / 3) and got.y == 1.0
    assert spark.range(1).select(sets.combinations(sets.F.lit(5), 2).alias("c")).first().c == 10


def test_sizewise_accuracy(spark):
    rows = spark.createDataFrame(list(zip([3, 3, 3, 3, 4], [1, 1, 0, 0, 1], strict=True)), "size int, pred int")
    assert sorted(map(tuple, metrics.sizewise_accuracy(rows, 1).collect())) == [(3, 0.5, 4), (4, 1.0, 1)]


def test_components_and_forest(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    forest = Forest()
    for a, b in pairs:
        forest.join(a, b)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert all(got.get(x, x) == forest.root(x) for x in nodes)


def test_overlaps_and_assignment(spark):
    rng = np.random.default_rng(1)
    known = [set(map(str, rng.integers(0, 30, 6))) for _ in range(12)]
    found = [set(map(str, rng.integers(0, 30, 5))) for _ in range(9)]
    pairs = overlap.overlaps(members_of(spark, known).withColumnRenamed("cid", "kid"), members_of(spark, found).withColumnRenamed("cid", "pid"))
    want = {(i, j, len(a & b)) for i, a in enumerate(known) for j, b in enumerate(found) if a & b}
    assert {(r.kid, r.pid, r.c) for r in pairs.collect()} == want
    weights = rng.random((5, 4))
    best = max(sum(weights[i, j] for j, i in enumerate(p)) for p in __import__("itertools").permutations(range(5), 4))
    assert sum(weights[i, j] for i, j in metrics.assignment(weights)) == pytest.approx(best)
    na = np.array([[len(a & b) ** 2 / (len(a) * len(b)) for b in found] for a in known])
    total = sum(r.w for r in metrics.match_communities(pairs).collect())
    assert total == pytest.approx(sum(na[i, j] for i, j in metrics.assignment(na)))


def test_cliques(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(f"{a:02}", f"{b:02}") for a, b in rng.integers(0, 14, (45, 2)) if a < b})
    nodes = sorted({x for p in pairs for x in p})
    full = lambda c: all((a, b) in pairs for a, b in combinations(sorted(c), 2))
    every = [set(c) for k in range(2, 8) for c in combinations(nodes, k) if full(c)]
    want = {tuple(sorted(c)) for c in every if len(c) >= 3 and not any(c < d for d in every)}
    assert {tuple(r.members) for r in search.maximal_cliques(edges_of(spark, pairs)).collect()} == want


TOY = [list(combinations(g, 2)) for g in (["a1", "a2", "a3", "a4"], ["b1", "b2", "b3"], ["c1", "c2", "c3", "c4", "c5"])]


def test_toy_end_to_end(spark):
    edges = edges_of(spark, [p for g in TOY for p in g])
    neighbours = graph.adjacency(edges)
    grown = search.grow(training.seeds(neighbours, "all_nodes"), neighbours, density, search.Growth(method="top", max_size=8, explore=0.0))
    merged = merge.merge_overlapping(merge.distinct_candidates(grown.select("members", "score")), edges, 0.1, density)
    found = merged.select(metrics.F.xxhash64("members").alias("pid"), metrics.F.explode("members").alias("node"))
    known = members_of(spark, [sorted({x for p in g for x in p}) for g in TOY]).withColumnRenamed("cid", "kid")
    values = {r.metric: r.value for r in metrics.evaluate(known, found).collect()}
    assert values["matched.f1"] == 1.0 and values["matching.f1"] == pytest.approx(1.0) and values["clustering.acc"] == pytest.approx(1.0)


def traced(neighbours, score, p, seed_members, began_score):
    """A plain reading of one search without random moves, with all draws at the given chance."""
    members, edges, previous, shown, idle, made = list(seed_members), {}, began_score, began_score, 0, 1
    weight = {(r.node, r.nbr): r.weight for r in neighbours.collect()}
    greedy, limit = p.method in ("heaviest", "top"), p.max_size - len(members)
    within = lambda m: {(a, b): weight[a, b] for a, b in combinations(sorted(m), 2) if (a, b) in weight}
    while len(members) < p.max_size if greedy else made < limit:
        around = {}
        for a in members:
            for (x, y), w in weight.items():
                if x == a and y not in members:
                    around[y] = max(w, around.get(y, 0))
        if not around:
            break
        value = {x: score(search.subgraph_features([*members, x], within([*members, x]))) for x in around}
        x = min(around, key=lambda x: (-around[x] if p.method == "heaviest" else -value[x], x))
        if value[x] < p.threshold:
            break
        if greedy or value[x] >= previous or p.accept >= 1:
            members.append(x)
        idle = 0 if value[x] > previous else idle + 1
        if not greedy and idle > p.patience:
            break
        previous = shown = value[x]
        made += 1
    return tuple(sorted(members)), round(shown, 9)


@pytest.mark.parametrize(("method", "accept"), [("heaviest", 1.0), ("top", 1.0), ("metropolis", -1.0), ("metropolis", 1.0)])
def test_searches_equal_a_plain_reading(spark, method, accept):
    rng = np.random.default_rng(8)
    pairs = sorted({(f"n{a:02}", f"n{b:02}") for a, b in rng.integers(0, 16, (60, 2)) if a < b})
    edges = spark.createDataFrame([(a, b, float(rng.integers(1, 9))) for a, b in pairs], "src string, dst string, weight double").cache()
    neighbours = graph.adjacency(edges)
    p = search.Growth(method=method, max_size=8, threshold=0.45, explore=0.0, accept=accept, patience=2)
    got = {r.seed: (tuple(r.members), round(r.score, 9)) for r in search.grow(neighbours.select("node"), neighbours, density, p).collect()}
    start = {r.node: (r.node, r.nbr) for r in graph.starting_edges(neighbours).collect()}
    assert got == {x: traced(neighbours, density, p, m, 0.0) for x, m in start.items()}
    cliques = search.maximal_cliques(edges).filter("size(members) = 3").cache()
    got = sorted((tuple(r.members), round(r.score, 9)) for r in search.grow(None, neighbours, density, p, cliques).collect())
    assert got == sorted(traced(neighbours, density, p, r.members, 1.0) for r in cliques.collect()) and got


def test_share_of_the_frontier(spark):
    neighbours = graph.adjacency(spark.createDataFrame([("a", f"x{i}", float(i)) for i in range(1, 9)] + [("x1", "x8", 1.0)], "src string, dst string, weight double"))
    p = search.Growth(method="top", max_size=3, threshold=0.1, explore=0.0)
    kept = lambda p: search.grow(neighbours.select("node").filter("node = 'a'"), neighbours, density, p).first().members
    assert kept(p) == ["a", "x1", "x8"] and "x1" not in kept(search.Growth(**{**p.__dict__, "share": 0.3, "share_from": 2}))


def test_detects_communities(spark):
    groups = [[f"{k}{i}" for i in range(n)] for k, n in zip("abcdefghij", [4, 3, 5, 4, 3, 5, 4, 6, 3, 4], strict=True)]
    pairs = [(x, y, 5.0) for g in groups for x, y in combinations(g, 2)] + [(g[0], h[-1], 0.2) for g, h in zip(groups, groups[1:])]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "src string, dst string, weight double").cache()
    found, split, scorer = detect.detect(edges, members_of(spark, groups), detect.Job(negatives=2.0))
    assert sorted(tuple(r.members) for r in found.collect()) == sorted(tuple(sorted(g)) for g in groups)
    values = {(r.scope, r.variant, r.metric): r.value for r in detect.measure(found, members_of(spark, groups), split).collect()}
    assert values["both", "all", "matched.f1"] == 1.0 and values["both", "known", "matching.f1"] == pytest.approx(1.0)
    assert {s for s, *_ in values} == {"train", "test", "both"} and len(scorer.weights) == 18


@pytest.mark.parametrize("method", ["heaviest", "metropolis", "annealing"])
def test_growth_is_repeatable(spark, method):
    neighbours = graph.adjacency(edges_of(spark, [p for g in TOY for p in g] + [("a1", "b1"), ("b3", "c1")]))
    p = search.Growth(method=method, max_size=5, seed=4)
    runs = [sorted(map(str, search.grow(neighbours.select("node").repartition(n), neighbours, density, p).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and runs[0]


def test_merge_by_component_equals_global_sweep(spark):
    rng = np.random.default_rng(3)
    nodes = [f"n{i:02}" for i in range(24)]
    pairs = sorted({tuple(sorted((nodes[a], nodes[b]))) for a, b in rng.integers(0, 24, (60, 2)) if a != b})
    items = sorted({(tuple(sorted(set(rng.choice(nodes[k : k + 12], 4).tolist()))), float(rng.integers(1, 9)) / 10) for k in (0, 12) for _ in range(10)}, key=lambda x: (-x[1], x[0]))
    items = [x for x in items if len(x[0]) >= 3]
    rows = spark.createDataFrame([(list(m), s) for m, s in items], "members array<string>, score double")
    for method in ("jaccard", "qi"):
        got = sorted((tuple(r.members), r.score) for r in merge.merge_overlapping(rows, edges_of(spark, pairs), 0.3, density, method).collect())
        assert got == sorted(merge.sweep(items, {p: 1.0 for p in pairs}, 0.3, method, density))


def test_split_has_no_shared_edge(spark):
    edges = edges_of(spark, [p for g in TOY for p in g])
    own = members_of(spark, [["a1", "a2", "a3"], ["a2", "a3", "a4"], ["b1", "b2", "b3"], ["c1", "c2", "c3"], ["c4", "c5"]])
    induced = graph.induced_edges(edges, own)
    sides = {r.cid: r.train for r in training.independent_split(induced, own).collect()}
    assert len(sides) == 5 and sides[0] == sides[1]


def test_walks(spark):
    neighbours = graph.adjacency(edges_of(spark, [p for g in TOY for p in g] + [("a1", "b1"), ("b3", "c1")]))
    plan = spark.createDataFrame([(3, 4), (5, 2)], "size long, n long")
    walks = training.random_walks(neighbours, plan, seed=5).collect()
    known = {(r.node, r.nbr) for r in neighbours.collect()}
    assert len({r.gid for r in walks}) == 6 and all((r.src, r.dst) in known for r in walks)


def test_empty_tables(spark):
    none = edges_of(spark, [("x", "x")]).filter("src <> dst")
    assert graph.network_stats(none).first().n_nodes == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_united_communities_equal_plain_rounds(spark):
    rng = np.random.default_rng(8)
    own = {i: frozenset(rng.choice(9, rng.integers(3, 7), replace=False).tolist()) for i in range(30)}
    rows = spark.createDataFrame([(i, x) for i, m in own.items() for x in m], "cid long, node long")
    near = lambda m, a, b: len(m[a] & m[b]) / len(m[a] | m[b])
    got = sorted((r.cid1, r.cid2, round(r.jaccard, 9)) for r in overlap.similar_pairs(rows, 0.6).collect())
    assert got == [(a, b, round(near(own, a, b), 9)) for a, b in combinations(own, 2) if near(own, a, b) >= 0.6]
    want = dict(own)
    while pairs := [(-near(want, a, b), a, b) for a, b in combinations(sorted(want), 2) if near(want, a, b) >= 0.6]:
        best = {x: min(p for p in pairs if x in p[1:]) for x in {y for p in pairs for y in p[1:]}}
        for p in {p for p in pairs if best[p[1]] == p == best[p[2]]}:
            want[p[1]] |= want.pop(p[2])
    united = {}
    for r in merge.unite_known(rows, 0.6).collect():
        united.setdefault(r.cid, set()).add(r.node)
    assert united == want and len(want) < 30


def test_clique_sizes(spark):
    known = spark.createDataFrame([(1, x) for x in "abcd"] + [(2, x) for x in "def"], "kid long, node string")
    predicted = spark.createDataFrame([(1, x) for x in "abcx"] + [(2, x) for x in "efghi"], "pid long, node string")
    counts = lambda k, **how: metrics.clique_precision_recall(known, predicted, k, **how).first()[:3]
    assert [counts(k, restricted=False) for k in (2, 3, 4, 5)] == [(4, 12, 5), (1, 13, 4), (0, 6, 1), (0, 1, 0)]
    assert [counts(k) for k in (2, 3, 4)] == [(4, 0, 5), (1, 0, 4), (0, 0, 1)]
    curve = spark.createDataFrame([(2, 0.25, 4 / 9, 2), (3, 0.1, 0.2, 2), (4, 0.0, 0.0, 2), (5, 0.0, 0.0, 1)], "k int, precision double, recall double, n_communities long")
    row = metrics.clique_summary(curve).first()
    assert row.grand_f1 == 0 < row.grand_mean and row.precision < 0.1
    hidden = spark.createDataFrame([(9, x) for x in "efgh"], "kid long, node string")
    assert metrics.clique_precision_recall(known, predicted, 2, excluded=hidden, restricted=False).first()[:3] == (4, 7, 5)


@pytest.mark.parametrize("name", ["estimator_SVM", "log_reg"])
def test_saved_models(spark, name, tmp_path):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(float(a), float(b), float(a + b > 1)) for a, b in rng.random((60, 2))], "x double, y double, label double")
    fitted = models.train(rows, ["x", "y"], name)
    fitted.save(str(tmp_path / "m"))
    scores = lambda m: [round(r.score, 9) for r in m.score(rows).orderBy("x").collect()]
    assert scores(models.Classifier.load(str(tmp_path / "m"))) == scores(fitted)


def test_sparse_matching():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (4, 7), (7, 4), (6, 6)):
        weights = rng.random((n, m)) * (rng.random((n, m)) < 0.5)
        wide = weights if n <= m else weights.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in __import__("itertools").permutations(range(wide.shape[1]), wide.shape[0]))
        row, column = np.nonzero(weights)
        found = metrics.sparse_assignment(row, column, weights[row, column], weights.shape)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        assert sum(weights[i, j] for i, j in found) == pytest.approx(best)


def test_matching_at_each_threshold(spark):
    rng = np.random.default_rng(5)
    known = members_of(spark, [set(map(str, rng.integers(0, 30, 6))) for _ in range(12)]).withColumnRenamed("cid", "kid")
    found = members_of(spark, [set(map(str, rng.integers(0, 30, 5))) for _ in range(9)]).withColumnRenamed("cid", "pid")
    scores = spark.createDataFrame([(i, i / 8) for i in range(9)], "pid long, score double")
    k = overlap.sizes(known, "kid", "n")
    curve = {r.step: r for r in metrics.matching_curve(overlap.overlaps(known, found), k, scores).collect()}
    assert len(curve) == 10
    for step in (0, 4, 9):
        kept = found.join(scores.filter(F.col("score") >= step / 10), "pid", "left_semi")
        want = metrics.matching_metrics(overlap.overlaps(known, kept), k, overlap.sizes(kept, "pid", "n")).first()
        assert curve[step].precision == pytest.approx(want.precision) and curve[step].recall == pytest.approx(want.recall)


def test_weighted_cliques(spark):
    known = spark.createDataFrame([(1, x) for x in "abcd"] + [(2, x) for x in "def"], "kid long, node string")
    predicted = spark.createDataFrame([(1, x) for x in "abcx"] + [(2, x) for x in "cef"], "pid long, node string")
    row = metrics.weighted_clique_precision_recall(known, predicted, 2, 0.0).first()
    # abc: 3 pairs of weight 1; cef: ef is known, ce and cf are not. abcd: 6 pairs of weight 2/3, three found; def: ef of weight 1.
    assert (row.tp, row.fp) == (4.0, 2.0) and (row.known_tp, row.fn) == (pytest.approx(3.0), pytest.approx(4.0))


def test_folders_of_predictions(spark, tmp_path):
    for folder, name, line in (("run1", "res_pred_comp_list0", "a b c 0.5"), ("run1", "res_pred.out", "a b 0.25"), ("run2", "res_pred_comp_list1", "d e 0.75"), ("run2", "res_pred.out", "d e f 1.0"), (".", "res_pred_comp_list0", "g h 0.5"), (".", "res_pred_comp_list1", "i j 0.5"), (".", "res_pred_comp_list2", "k l 0.5")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(line + "\n")
    read = lambda **mode: sorted(" ".join(r.members) for r in text.read_prediction_folders(spark, str(tmp_path), **mode).collect())
    assert read(folders=["run1"]) == ["a b c"] and read(prefix="run") == ["a b c", "d e"]
    assert read(final_prefix="run") == ["a b", "d e f"] and read(parts=2) == ["g h", "i j"]
    with pytest.raises(ValueError):
        read(prefix="run", parts=1)
    (tmp_path / "map.csv").write_text("Bait,Prey,Score\nb1,p1,0.5\nb1,p1,0.75\n,p2,1\n")
    assert [tuple(r) for r in text.read_interactions(spark, str(tmp_path / "map.csv")).collect()] == [("b1", "p1", 0.75)]


def test_written_outputs(spark, tmp_path):
    edges = edges_of(spark, [p for g in TOY for p in g])
    found = spark.createDataFrame([(["a1", "a2", "a3"], 0.5), (["a1", "a2", "b1", "b2"], 0.9)], "members array<string>, score double")
    train, test = (spark.createDataFrame([(x,) for x in nodes], "node string") for nodes in (["a1", "a2"], ["b1", "b2", "a1"]))
    sinks.write_found(found, edges, train, test, str(tmp_path))
    lines = lambda name: [r.value for r in spark.read.text(str(tmp_path / name)).collect()]
    assert [r.members for r in text.read_predictions(spark, str(tmp_path / "res_pred.out")).orderBy(F.desc("score")).collect()] == [["a1", "a2", "b1", "b2"], ["a1", "a2", "a3"]]
    assert sorted(filter(None, lines("res_pred_edges.out"))) == ["a1 a2 1.0", "a1 a2 1.0", "a1 a3 1.0", "a2 a3 1.0", "b1 b2 1.0"] and lines("res_pred_edges.out").count("") == 2
    every = "res_tot_pred_edges_unique_max_comp_prob"
    assert sorted(lines(f"{every}.out")) == ["a1\ta2\t0.900", "a1\ta3\t0.500", "a2\ta3\t0.500", "b1\tb2\t0.900"]
    assert sorted(lines(f"{every}_inKnown.out")) == ["a1\ta2\t0.900", "b1\tb2\t0.900"]
    assert lines(f"{every}_inKnown_train.out") == ["a1\ta2\t0.900"] and lines(f"{every}_inKnown_test.out") == ["b1\tb2\t0.900"]
    own = members_of(spark, [["a1", "a2"], ["b1", "b2", "b3"]])
    sinks.write_known(own, graph.induced_edges(edges, own), str(tmp_path))
    assert sorted(lines("res_known.out")) == ["a1 a2", "b1 b2 b3"] and len(lines("res_tot_known_edges_unique.out")) == 4
    assert lines("res_known_edges.out") == ["a1 a2 1.0", "", "b1 b2 1.0", "b1 b3 1.0", "b2 b3 1.0", ""]
    matches = spark.createDataFrame([(["a"], ["b"], 0.5, 0.25), (["c", "d"], ["c"], 0.75, 1.0)], "known array<string>, predicted array<string>, f1 double, score double")
    sinks.write_best_matches(matches, str(tmp_path / "matches"))
    assert [x for x in lines("matches") if not x.startswith("Known")] == ["c d ||| c ||| 0.750 ||| 1.000", "a ||| b ||| 0.500 ||| 0.250"]


@pytest.mark.parametrize("method", ["jaccard", "qi"])
def test_merge_nearest_equals_plain_rounds(spark, method):
    rng = np.random.default_rng(11)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 14, (60, 2)) if a < b})
    graph_rows = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double")
    own = sorted({(tuple(sorted(rng.choice(14, rng.integers(3, 6), replace=False).tolist())), round(float(rng.random()) * 0.6, 3)) for _ in range(30)})
    dense = lambda m: 2 * sum(a in m and b in m for a, b in edges) / (len(m) * (len(m) - 1))
    rows = spark.createDataFrame([(list(m), s) for m, s in own], "members array<long>, score double")
    name = {(tuple(r.members), r.score): r.cid for r in rows.withColumn("cid", F.md5(F.to_json(F.struct("members", "score")))).collect()}

    def near(x, y):
        shared, a, b = len({*x[0]} & {*y[0]}), len(x[0]), len(y[0])
        if method == "jaccard":
            return shared / (a + b - shared), shared / (a + b - shared) >= 0.4
        return shared / a * (shared / b), shared / a >= 0.4 and shared / b >= 0.4

    def cid(c):
        if c not in name:
            name[c] = spark.createDataFrame([(list(c[0]), c[1])], "members array<long>, score double").select(F.md5(F.to_json(F.struct("members", "score")))).first()[0]
        return name[c]

    want = set(own)
    while pairs := [(-near(x, y)[0], cid(x), cid(y), x, y) for x in want for y in want if cid(x) < cid(y) and near(x, y)[1]]:
        best = {c: min(p[:3] for p in pairs if c in p[3:]) for c in {c for p in pairs for c in p[3:]}}
        for p in pairs:
            x, y = p[3:]
            if best[x] == p[:3] == best[y]:
                union = tuple(sorted({*x[0], *y[0]}))
                value = dense(union)
                if value > x[1] and value > y[1]:
                    want = want - {x, y} | {(union, value)}
                else:
                    want = want - {x if x[1] < y[1] else y}
    got = sorted((tuple(r.members), round(r.score, 9)) for r in merge.merge_nearest(rows, graph_rows, 0.4, density, method).collect())
    assert got == sorted((m, round(s, 9)) for m, s in want) and len(got) < len(own) and any(c not in own for c in want)
