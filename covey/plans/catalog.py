"""Registered queries over the driver tables and their SQL.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clique_samples, features, graph, merge, metrics, models, overlap, reporting, search, training
from ..sources.text import FEATURES
from ..sources.scratch import forget, scratch, stored
from . import detect, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views of :mod:`covey.plans.views` in SQL, by name.
VIEWS = {
    "basket": "SELECT DISTINCT l_orderkey AS kid, l_partkey AS node FROM lineitem",
    "known": "SELECT kid, node FROM basket QUALIFY count(*) OVER (PARTITION BY kid) >= 3",
    "hq": "SELECT DISTINCT l_orderkey AS pid, l_partkey AS node FROM lineitem WHERE l_quantity > 15",
    "predicted": "SELECT pid, node FROM hq QUALIFY count(*) OVER (PARTITION BY pid) >= 3",
    "scores": "SELECT l_orderkey AS pid, CAST(floor(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS DOUBLE) / 100 AS score FROM lineitem WHERE l_quantity > 15 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3",
    "copart": "SELECT a.node AS src, b.node AS dst, CAST(count(*) AS DOUBLE) AS weight FROM basket a JOIN basket b ON a.kid = b.kid AND a.node < b.node GROUP BY 1, 2",
    "often": "SELECT src, dst FROM copart WHERE weight >= 2",
    "adj": "SELECT src AS node, dst AS nbr, weight FROM copart UNION ALL SELECT dst, src, weight FROM copart",
    "brand": "SELECT p_brand AS cid, p_partkey AS node FROM part WHERE p_partkey IN (SELECT node FROM adj)",
    "induced": "SELECT a.cid, src, dst, weight FROM copart JOIN brand a ON a.node = src JOIN brand b ON b.node = dst AND a.cid = b.cid",
    "ends": "SELECT cid, src AS node, dst AS nbr FROM induced UNION ALL SELECT cid, dst, src FROM induced",
    "deg": "SELECT brand.cid, brand.node, CAST(count(nbr) AS BIGINT) AS d FROM brand LEFT JOIN ends USING (cid, node) GROUP BY 1, 2",
    "pairs": "SELECT kid, pid, count(*) AS c FROM known JOIN predicted USING (node) GROUP BY 1, 2",
    "ks": "SELECT kid, count(*) AS nk FROM known GROUP BY 1",
    "ps": "SELECT pid, count(*) AS np FROM predicted GROUP BY 1",
    "ov": "SELECT kid, pid, CAST(c AS DOUBLE) AS c, CAST(nk AS DOUBLE) AS nk, CAST(np AS DOUBLE) AS np FROM pairs JOIN ks USING (kid) JOIN ps USING (pid)",
    "sup": "SELECT DISTINCT l_suppkey AS cid, l_partkey AS node FROM lineitem",
    "supn": "SELECT cid, count(*) AS n FROM sup GROUP BY 1",
    "selfov": "SELECT cid1, cid2, c, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2 FROM (SELECT x.cid AS cid1, y.cid AS cid2, CAST(count(*) AS DOUBLE) AS c FROM sup x JOIN sup y ON x.node = y.node AND x.cid < y.cid GROUP BY 1, 2) JOIN supn a ON a.cid = cid1 JOIN supn b ON b.cid = cid2",
    "typ": "SELECT p_type AS kid, p_partkey AS node FROM part",
    "bra": "SELECT p_brand AS pid, p_partkey AS node FROM part",
    "tb": "SELECT kid, pid, CAST(c AS DOUBLE) AS c, CAST(nk AS DOUBLE) AS nk, CAST(np AS DOUBLE) AS np FROM (SELECT kid, pid, count(*) AS c FROM typ JOIN bra USING (node) GROUP BY 1, 2) JOIN (SELECT kid, count(*) AS nk FROM typ GROUP BY 1) USING (kid) JOIN (SELECT pid, count(*) AS np FROM bra GROUP BY 1) USING (pid)",
    "inter": "SELECT l_suppkey AS bait, l_partkey AS prey, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2",
    "names": "SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN '-' ELSE p_name END AS name FROM part",
    "ann": "SELECT p_partkey AS node, CAST(p_size % 6 AS INT) AS score FROM part WHERE p_size <= 40",
    "edge_score": "SELECT src, dst, max(score) AS score FROM (SELECT a.pid, a.node AS src, b.node AS dst FROM predicted a JOIN predicted b ON a.pid = b.pid AND a.node < b.node) JOIN scores USING (pid) GROUP BY 1, 2",
    "labelled": "SELECT score, CASE WHEN often.src IS NULL THEN 0 ELSE 1 END AS label FROM edge_score LEFT JOIN often USING (src, dst)",
    "curve": "SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, sum(pos) OVER () AS tot, pos FROM (SELECT score, sum(label) AS pos, count(*) AS n FROM labelled GROUP BY 1)",
}
_USES = {
    "known": ["basket"], "predicted": ["hq"], "copart": ["basket"], "adj": ["copart"], "brand": ["adj"], "induced": ["copart", "brand"], "ends": ["induced"], "deg": ["brand", "ends"],
    "pairs": ["known", "predicted"], "ks": ["known"], "ps": ["predicted"], "ov": ["pairs", "ks", "ps"], "supn": ["sup"], "selfov": ["sup", "supn"], "tb": ["typ", "bra"],
    "edge_score": ["predicted", "scores"], "often": ["copart"], "labelled": ["edge_score", "often"], "curve": ["labelled"],
}


def sql(uses: list[str], body: str) -> str:
    """``body`` below the views that it and they use."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _USES.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    first, _, rest = body.strip().partition(" ")
    more = rest + "\n" if first == "WITH" else None
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in order)
    return f"WITH {ctes}" + (f",\n{more}" if more else f"\n{body}") if ctes else body


def query(name: str, uses: list[str] = [], oracle: str | None = None):  # noqa: B006
    """Registers a query and its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(uses, oracle)
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sizes(membership: DataFrame, key: str) -> DataFrame:
    return overlap.sizes(membership, key, "n")


def _overlaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that can be best matches, and sizes; what several branches of a plan read is stored."""
    k, p = stored(views.known(spark, sf)), stored(views.predicted(spark, sf))
    return stored(overlap.best_overlaps(k, p)), _sizes(k, "kid"), _sizes(p, "pid")


def _best_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs alone, for plans that read them once."""
    return overlap.best_overlaps(views.known(spark, sf), views.predicted(spark, sf))


def _type_brand(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlaps(views.types(spark, sf).withColumnRenamed("cid", "kid"), views.brands(spark, sf).withColumnRenamed("cid", "pid"))


def _induced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = views.brand_parts(spark, sf)
    return views.inner_copart(spark, sf, own), own


# Networks ------------------------------------------------------------------


@query("network_stats", ["adj"], "SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, max(d) AS max_neighbors, round(avg(d), 6) AS avg_neighbors FROM (SELECT node, count(*) AS d FROM adj GROUP BY 1)")
def network_stats(spark, sf):
    return rounded(graph.network_stats(views.copart(spark, sf)))


@query(
    "canonical_edges",
    [],
    """WITH e AS (SELECT o_orderkey AS line, c_nationkey AS u, s_nationkey AS v, w FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, min(l_suppkey) AS s, max(l_quantity) AS w FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = s)
    SELECT least(u, v) AS src, greatest(u, v) AS dst, arg_max(w, line) AS weight FROM e WHERE u <> v GROUP BY 1, 2""",
)
def canonical_edges(spark, sf):
    lines = views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("l_quantity"))
    orders = views.table(spark, sf, "orders").join(views.table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    trade = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(views.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return graph.canonical_edges(trade.select(F.col("o_orderkey").alias("line"), F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_quantity").alias("weight")))


@query("graph_restriction", ["copart"], "SELECT src, dst, weight FROM copart WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 15) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 15)")
def graph_restriction(spark, sf):
    return graph.restrict(views.copart(spark, sf), views.table(spark, sf, "part").filter("p_size > 15").select(F.col("p_partkey").alias("node")))


@query("induced_edges", ["induced"], "SELECT * FROM induced")
def induced_edges(spark, sf):
    return _induced(spark, sf)[0]


@query("unique_edges", ["induced"], "SELECT DISTINCT src, dst FROM induced")
def unique_edges(spark, sf):
    return graph.unique_edges(_induced(spark, sf)[0])


@query(
    "edge_sharing",
    ["known"],
    "WITH e AS (SELECT x.kid AS cid, x.node AS src, y.node AS dst FROM known x JOIN known y ON x.kid = y.kid AND x.node < y.node) SELECT DISTINCT cid FROM e WHERE cid % 2 = 0 AND EXISTS (SELECT 1 FROM e f WHERE f.cid % 2 <> 0 AND f.src = e.src AND f.dst = e.dst)",
)
def edge_sharing(spark, sf):
    k = views.known(spark, sf)
    e = k.select(F.col("kid").alias("cid"), F.col("node").alias("src")).join(k.select(F.col("kid").alias("cid"), F.col("node").alias("dst")), "cid").filter("src < dst")
    return graph.edges_sharing(e.filter("cid % 2 = 0"), e.filter("cid % 2 <> 0"))


@query(
    "connected_communities",
    ["brand", "ends"],
    """WITH RECURSIVE reach(cid, node, other) AS (SELECT cid, node, node FROM brand UNION SELECT r.cid, r.node, e.nbr FROM reach r JOIN ends e ON e.cid = r.cid AND e.node = r.other),
    label AS (SELECT cid, node, min(other) AS c FROM reach GROUP BY 1, 2)
    SELECT cid, count(DISTINCT c) AS parts, count(DISTINCT c) = 1 AS connected FROM label GROUP BY 1""",
)
def connected_communities(spark, sf):
    return graph.connected_communities(*_induced(spark, sf))


ORACLES["connected_communities"] = ORACLES["connected_communities"].replace("WITH basket", "WITH RECURSIVE basket", 1).replace("RECURSIVE reach(", "reach(", 1)


@query("frontier_top_weight", ["brand", "adj"], """WITH r AS (SELECT cid, nbr, max(weight) AS weight FROM brand JOIN adj USING (node) GROUP BY 1, 2), f AS (SELECT r.* FROM r LEFT JOIN brand b ON b.cid = r.cid AND b.node = r.nbr WHERE b.node IS NULL)
    SELECT cid, nbr, weight FROM (SELECT *, count(*) OVER (PARTITION BY cid) AS n, row_number() OVER (PARTITION BY cid ORDER BY weight DESC, nbr) AS k FROM f) WHERE n <= 30 OR k <= ceil(CAST(0.7 AS DOUBLE) * n)""")
def frontier_top_weight(spark, sf):
    around = graph.frontier(views.brand_parts(spark, sf), graph.adjacency(views.copart(spark, sf)))
    return graph.top_frontier(around, 0.7, 30)


@query("starting_edge", ["adj"], "SELECT node, nbr, weight FROM adj QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, nbr) = 1")
def starting_edge(spark, sf):
    return graph.starting_edges(graph.adjacency(views.copart(spark, sf)))


# Features ------------------------------------------------------------------

_DEGREES = "SELECT cid, CAST(max(d) AS DOUBLE) AS degree_max, round(avg(d), 6) AS degree_mean, round(CAST(median(d) AS DOUBLE), 6) AS degree_median, round(var_pop(d), 6) AS degree_var FROM deg GROUP BY 1"
_CC = """tri AS (SELECT a.cid, a.src AS x, a.dst AS y, b.dst AS z FROM induced a JOIN induced b ON a.cid = b.cid AND a.dst = b.src JOIN induced c ON c.cid = a.cid AND c.src = a.src AND c.dst = b.dst),
    tn AS (SELECT cid, node, count(*) AS t FROM (SELECT cid, x AS node FROM tri UNION ALL SELECT cid, y FROM tri UNION ALL SELECT cid, z FROM tri) GROUP BY 1, 2),
    cc AS (SELECT deg.cid, CASE WHEN d < 2 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * coalesce(t, 0) / (d * (d - 1)) END AS c FROM deg LEFT JOIN tn USING (cid, node)),
    ccs AS (SELECT cid, round(max(c), 6) AS CC_max, round(avg(c), 6) AS CC_mean, round(var_pop(c), 6) AS CC_var FROM cc GROUP BY 1)"""
_DC = """nd AS (SELECT ends.cid, ends.node, avg(deg.d) AS m FROM ends JOIN deg ON deg.cid = ends.cid AND deg.node = ends.nbr GROUP BY 1, 2),
    dcs AS (SELECT deg.cid, round(avg(coalesce(m, 0)), 6) AS DC_mean, round(var_pop(coalesce(m, 0)), 6) AS DC_var, round(max(coalesce(m, 0)), 6) AS DC_max FROM deg LEFT JOIN nd USING (cid, node) GROUP BY 1)"""
_WT = "SELECT cid, round(avg(weight), 6) AS edge_wt_mean, max(weight) AS edge_wt_max, round(var_pop(weight), 6) AS edge_wt_var FROM induced GROUP BY 1"


@query("degree_stats", ["deg"], _DEGREES)
def degree_stats(spark, sf):
    return rounded(features.degree_stats(graph.node_degrees(*_induced(spark, sf))))


@query("clustering_stats", ["deg", "induced"], f"WITH {_CC} SELECT * FROM ccs")
def clustering_stats(spark, sf):
    induced, own = _induced(spark, sf)
    return rounded(features.clustering_stats(induced, graph.node_degrees(induced, own)))


@query("neighbor_degree_stats", ["deg"], f"WITH {_DC} SELECT * FROM dcs")
def neighbor_degree_stats(spark, sf):
    induced, own = _induced(spark, sf)
    return rounded(features.neighbor_degree_stats(induced, graph.node_degrees(induced, own)))


@query("edge_weight_stats", ["induced"], _WT)
def edge_weight_stats(spark, sf):
    return rounded(features.edge_weight_stats(_induced(spark, sf)[0]))


@query(
    "subgraph_features15",
    ["deg", "induced"],
    f"""WITH {_CC}, {_DC}, wt AS ({_WT}), dg AS ({_DEGREES}), base AS (SELECT cid, CAST(count(*) AS DOUBLE) AS nodes, CASE WHEN count(*) < 2 THEN 0 ELSE round(sum(d) / CAST(count(*) * (count(*) - 1) AS DOUBLE), 6) END AS dens FROM deg GROUP BY 1)
    SELECT base.cid, dens, nodes, degree_max, degree_mean, degree_median, degree_var, CC_max, CC_mean, CC_var, coalesce(edge_wt_mean, 0) AS edge_wt_mean, coalesce(edge_wt_max, 0) AS edge_wt_max, coalesce(edge_wt_var, 0) AS edge_wt_var, DC_mean, DC_var, DC_max
    FROM base JOIN dg USING (cid) JOIN ccs USING (cid) JOIN dcs USING (cid) LEFT JOIN wt USING (cid)""",
)
def subgraph_features15(spark, sf):
    return rounded(features.relational_features(*map(stored, _induced(spark, sf))))


@query("svd_features")
def svd_features(spark, sf):
    return rounded(features.singular_values(views.inner_copart(spark, sf, views.brands(spark, sf))))


@query("community_density", ["induced", "brand"], """WITH m AS (SELECT cid, count(*) AS m FROM induced WHERE weight > 0 GROUP BY 1), n AS (SELECT cid, count(*) AS nodes FROM brand GROUP BY 1)
    SELECT cid, nodes, CAST(coalesce(m, 0) AS BIGINT) AS edges, round(CAST(2 * coalesce(m, 0) AS DOUBLE) / (nodes * (nodes - 1)), 6) AS density, CAST(2 * coalesce(m, 0) AS DOUBLE) / (nodes * (nodes - 1)) > 0.8 AS dense FROM n LEFT JOIN m USING (cid)""")
def community_density(spark, sf):
    return rounded(reporting.display_density(*_induced(spark, sf)))


# Overlaps ------------------------------------------------------------------


@query("na_table", ["tb"], "SELECT kid, pid, CAST(c AS BIGINT) AS c, round(c / (nk + np - c), 6) AS jaccard, round(greatest(c / nk, c / np), 6) AS containment, round(c * c / (nk * np), 6) AS na, round(2 * c / (nk + np), 6) AS f1 FROM tb")
def na_table(spark, sf):
    return rounded(overlap.measures(_type_brand(spark, sf)).select("kid", "pid", "c", "jaccard", "containment", "na", "f1"))


@query("jaccard_pairs", ["selfov"], "SELECT cid1, cid2, round(c / (n1 + n2 - c), 6) AS jaccard FROM selfov")
def jaccard_pairs(spark, sf):
    return rounded(overlap.jaccard_pairs(views.supplier_parts(spark, sf)))


@query("jaccard_threshold", ["selfov"], "SELECT round(quantile_cont(j, 0.25) + 0.5 * (quantile_cont(j, 0.5) - quantile_cont(j, 0.25)), 6) AS threshold FROM (SELECT c / (n1 + n2 - c) AS j FROM selfov)")
def jaccard_threshold(spark, sf):
    return rounded(overlap.jaccard_threshold(views.supplier_parts(spark, sf)))


@query("containment_threshold", ["selfov"], "SELECT round(quantile_cont(j, 0.02) + (quantile_cont(j, 0.25) - quantile_cont(j, 0.02)) / 2, 6) AS threshold FROM (SELECT greatest(c / n1, c / n2) AS j FROM selfov)")
def containment_threshold(spark, sf):
    return rounded(overlap.containment_threshold(views.supplier_parts(spark, sf)))


@query("subset_filter", ["selfov"], "SELECT DISTINCT cid FROM sup WHERE cid NOT IN (SELECT CASE WHEN n1 <= n2 THEN cid1 ELSE cid2 END FROM selfov WHERE c / (n1 + n2 - c) > 0.2)")
def subset_filter(spark, sf):
    return overlap.subset_filter(views.supplier_parts(spark, sf), 0.2)


@query("best_match_known", ["ov"], "SELECT kid, pid, CAST(c AS BIGINT) AS c, round(2 * c / (nk + np), 6) AS f1 FROM ov QUALIFY row_number() OVER (PARTITION BY kid ORDER BY 2 * c / (nk + np) DESC, pid) = 1")
def best_match_known(spark, sf):
    return rounded(overlap.best_matches(overlap.measures(_best_overlaps(spark, sf)), "kid", "f1").select("kid", "pid", "c", "f1"))


@query("best_match_pred", ["ov"], "SELECT kid, pid, CAST(c AS BIGINT) AS c, round(2 * c / (nk + np), 6) AS f1 FROM ov QUALIFY row_number() OVER (PARTITION BY pid ORDER BY 2 * c / (nk + np) DESC, kid) = 1")
def best_match_pred(spark, sf):
    return rounded(overlap.best_matches(overlap.measures(_best_overlaps(spark, sf)), "pid", "f1").select("kid", "pid", "c", "f1"))


@query(
    "nearest_gold_name",
    ["tb"],
    """WITH best AS (SELECT pid, kid, format('{:.1f}', c / (nk + np - c)) AS s FROM tb QUALIFY row_number() OVER (PARTITION BY pid ORDER BY c / (nk + np - c) DESC, kid) = 1),
    b AS (SELECT pid, CASE WHEN s = '1.0' THEN 'T ' || kid WHEN s = '0.0' THEN '0.05 T ' || kid ELSE s || ' T ' || kid END AS base FROM best)
    SELECT pid, CASE WHEN k = 1 THEN base ELSE base || ' match ' || CAST(k AS VARCHAR) END AS name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pid) AS k FROM b)""",
)
def nearest_gold_name(spark, sf):
    gold = views.types(spark, sf).withColumnRenamed("cid", "kid")
    return overlap.name_by_gold(views.brands(spark, sf).withColumnRenamed("cid", "pid"), gold, gold.select("kid", F.concat(F.lit("T "), F.col("kid")).alias("gold_name")).distinct())


# Metrics -------------------------------------------------------------------

_NK, _NP = "(SELECT count(*) FROM ks)", "(SELECT count(*) FROM ps)"
_HMEAN = "CASE WHEN {0} > 0 AND {1} > 0 THEN 2 * {0} * {1} / ({0} + {1}) ELSE 0 END"


@query("precision_recall_f1", ["ov"], f"""WITH m AS (SELECT kid, pid FROM ov WHERE c / nk > 0.5 AND c / np > 0.5), r AS (SELECT CAST(count(DISTINCT pid) AS DOUBLE) / {_NP} AS p, CAST(count(DISTINCT kid) AS DOUBLE) / {_NK} AS r FROM m)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({_HMEAN.format('p', 'r')}, 6) AS f1 FROM r""")
def precision_recall_f1(spark, sf):
    return rounded(metrics.matched_precision_recall(*_overlaps(spark, sf)))


@query("ppv_sn_acc", ["ov"], f"WITH r AS (SELECT (SELECT sum(v) FROM (SELECT max(c / np) AS v FROM ov GROUP BY pid)) / {_NP} AS p, (SELECT sum(v) FROM (SELECT max(c / nk) AS v FROM ov GROUP BY kid)) / {_NK} AS s) SELECT round(p, 6) AS ppv, round(s, 6) AS sn, round(sqrt(p * s), 6) AS acc FROM r")
def ppv_sn_acc(spark, sf):
    return rounded(metrics.unbiased_accuracy(*_overlaps(spark, sf)))


@query("best_match_f1", ["ov"], f"WITH r AS (SELECT (SELECT sum(v) FROM (SELECT max(2 * c / (nk + np)) AS v FROM ov GROUP BY kid)) / {_NK} AS k, (SELECT sum(v) FROM (SELECT max(2 * c / (nk + np)) AS v FROM ov GROUP BY pid)) / {_NP} AS p) SELECT round(k, 6) AS known_f1, round(p, 6) AS predicted_f1, round({_HMEAN.format('k', 'p')}, 6) AS net_f1 FROM r")
def best_match_f1(spark, sf):
    return rounded(metrics.best_match_f1(*_overlaps(spark, sf)))


@query("f1_summary", ["ov"], "WITH b AS (SELECT ks.kid, coalesce(max(2 * c / (ov.nk + np)), 0) AS v FROM ks LEFT JOIN ov USING (kid) GROUP BY 1) SELECT CAST(sum(CASE WHEN v = 1 THEN 1 ELSE 0 END) AS BIGINT) AS perfect, CAST(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, round(avg(v), 6) AS mean_f1 FROM b")
def f1_summary(spark, sf):
    pairs, k, _ = _overlaps(spark, sf)
    return rounded(metrics.f1_summary(pairs, k))


@query("mmr_na", ["ov"], f"WITH r AS (SELECT (SELECT sum(v) FROM (SELECT max(c * c / (nk * np)) AS v FROM ov GROUP BY kid)) / {_NK} AS k, (SELECT sum(v) FROM (SELECT max(c * c / (nk * np)) AS v FROM ov GROUP BY pid)) / {_NP} AS p) SELECT round(k, 6) AS mmr, round(p, 6) AS pwmmr, round({_HMEAN.format('k', 'p')}, 6) AS hmean FROM r")
def mmr_na(spark, sf):
    return rounded(metrics.maximum_matching_ratio(*_overlaps(spark, sf)))


@query("size_weighted_pr", ["ov"], f"""WITH r AS (SELECT (SELECT sum(v * np) FROM (SELECT max(c * c / (nk * np)) AS v, max(np) AS np FROM ov GROUP BY pid)) / (SELECT sum(np) FROM ps) AS p, (SELECT sum(v * nk) FROM (SELECT max(c * c / (nk * np)) AS v, max(nk) AS nk FROM ov GROUP BY kid)) / (SELECT sum(nk) FROM ks) AS k)
    SELECT round(p, 6) AS precision, round(k, 6) AS recall, round({_HMEAN.format('p', 'k')}, 6) AS hmean FROM r""")
def size_weighted_pr(spark, sf):
    return rounded(metrics.size_weighted(*_overlaps(spark, sf)))


@query("clustering_accuracy", ["ov"], "WITH r AS (SELECT (SELECT sum(v) FROM (SELECT max(c) AS v FROM ov GROUP BY kid)) / (SELECT sum(nk) FROM ks) AS s, (SELECT sum(v) / sum(t) FROM (SELECT max(c) AS v, sum(c) AS t FROM ov GROUP BY pid)) AS p) SELECT round(s, 6) AS sensitivity, round(p, 6) AS ppv, round(sqrt(s * p), 6) AS acc FROM r")
def clustering_accuracy(spark, sf):
    k, p = stored(views.known(spark, sf)), stored(views.predicted(spark, sf))
    return rounded(metrics.clustering_accuracy(stored(overlap.best_overlaps(k, p)), _sizes(k, "kid"), _sizes(p, "pid"), overlap.met_members(k, p)))


@query("mmr_matching")
def mmr_matching(spark, sf):
    k = views.supplier_parts(spark, sf).withColumnRenamed("cid", "kid")
    p = views.supplier_parts(spark, sf, 25).withColumnRenamed("cid", "pid")
    return rounded(metrics.matching_metrics(overlap.overlaps(k, p), _sizes(k, "kid"), _sizes(p, "pid")))


@query("pr_threshold_curve", ["ov", "scores"], f"""WITH b AS (SELECT min(score) AS lo, (max(score) - min(score)) / 10 AS w FROM scores), t AS (SELECT CAST(i AS INT) AS step, lo + i * w AS threshold FROM b, generate_series(0, 9) g(i)),
    m AS (SELECT kid, pid, score FROM ov JOIN scores USING (pid) WHERE c / nk > 0.5 AND c / np > 0.5), n AS (SELECT step, threshold, count(pid) AS n_pred FROM t LEFT JOIN scores ON score >= threshold GROUP BY 1, 2),
    h AS (SELECT step, count(DISTINCT pid) AS hp, count(DISTINCT kid) AS hk FROM t JOIN m ON score >= threshold GROUP BY 1)
    SELECT step, round(threshold, 6) AS threshold, n_pred, round(CASE WHEN n_pred = 0 THEN 0 ELSE CAST(coalesce(hp, 0) AS DOUBLE) / n_pred END, 6) AS precision, round(CAST(coalesce(hk, 0) AS DOUBLE) / {_NK}, 6) AS recall FROM n LEFT JOIN h USING (step)""")
def pr_threshold_curve(spark, sf):
    pairs, k, _ = _overlaps(spark, sf)
    return rounded(metrics.threshold_curve(pairs, k, views.scores(spark, sf)))


@query("mmr_threshold_curve")
def mmr_threshold_curve(spark, sf):
    k = views.supplier_parts(spark, sf).withColumnRenamed("cid", "kid")
    p = views.supplier_parts(spark, sf, 25).withColumnRenamed("cid", "pid")
    score = views.table(spark, sf, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_suppkey").alias("pid")).agg(F.avg("l_discount").alias("score"))
    return rounded(metrics.matching_curve(overlap.overlaps(k, p), _sizes(k, "kid"), score))


@query("first_predictions", ["ov", "scores"], """WITH f AS (SELECT pid FROM scores ORDER BY score DESC, pid LIMIT 500), m AS (SELECT kid, pid FROM ov WHERE pid IN (SELECT pid FROM f) AND c / nk > 0.5 AND c / np > 0.5),
    r AS (SELECT CAST(count(DISTINCT pid) AS DOUBLE) / (SELECT count(*) FROM f) AS p, CAST(count(DISTINCT kid) AS DOUBLE) / (SELECT count(*) FROM ks) AS r FROM m)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def first_predictions(spark, sf):
    k, p = views.known(spark, sf), metrics.first_predictions(views.predicted(spark, sf), views.scores(spark, sf), 500)
    return rounded(metrics.matched_precision_recall(overlap.overlaps(k, p), _sizes(k, "kid"), _sizes(p, "pid")))


def _weighted_clique_sql(k: int) -> str:
    columns = ", ".join(f"t{i}.node AS n{i}" for i in range(k))
    same = " AND ".join(f"a.n{i} = b.n{i}" for i in range(k))
    weight = {2: "2 / CAST(n - 1 AS DOUBLE)", 3: "6 / CAST((n - 1) * (n - 2) AS DOUBLE)"}[k]

    def own(table: str, key: str) -> str:
        joins = " ".join(f"JOIN {table} t{i} ON t{i}.{key} = t0.{key} AND t{i}.node > t{i - 1}.node" for i in range(1, k))
        return f"SELECT {columns}, {weight} AS w FROM {table} t0 {joins} JOIN (SELECT {key}, count(*) AS n FROM {table} GROUP BY 1) z ON z.{key} = t0.{key}"

    def part(a: str, b: str, how: str) -> str:
        return f"(SELECT coalesce(sum(w), 0) + CAST(1e-5 AS DOUBLE) FROM {a} a WHERE {how} (SELECT 1 FROM {b} b WHERE {same}))"

    return f"""WITH shown AS (SELECT pid, node FROM predicted WHERE node IN (SELECT node FROM known) QUALIFY count(*) OVER (PARTITION BY pid) >= {k}), p AS ({own('shown', 'pid')}), g AS ({own('known', 'kid')}),
    r AS (SELECT {part('p', 'g', 'EXISTS')} AS tp, {part('p', 'g', 'NOT EXISTS')} AS fp, {part('g', 'p', 'EXISTS')} AS known_tp, {part('g', 'p', 'NOT EXISTS')} AS fn)
    SELECT round(tp, 6) AS tp, round(fp, 6) AS fp, round(known_tp, 6) AS known_tp, round(fn, 6) AS fn, round(tp / (tp + fp), 6) AS precision, round(known_tp / (known_tp + fn), 6) AS recall FROM r"""


@query("weighted_clique_pr_k2", ["known", "predicted"], _weighted_clique_sql(2))
def weighted_clique_pr_k2(spark, sf):
    return rounded(metrics.weighted_clique_precision_recall(views.known(spark, sf), views.predicted(spark, sf), 2))


@query("weighted_clique_pr_k3", ["known", "predicted"], _weighted_clique_sql(3))
def weighted_clique_pr_k3(spark, sf):
    return rounded(metrics.weighted_clique_precision_recall(views.known(spark, sf), views.predicted(spark, sf), 3))


def _clique_sql(k: int) -> str:
    names = [f"t{i}.node" for i in range(k)]

    def own(table: str, key: str) -> str:
        joins = " ".join(f"JOIN {table} t{i} ON t{i}.{key} = t0.{key} AND t{i}.node > t{i - 1}.node" for i in range(1, k))
        return f"SELECT DISTINCT {', '.join(f'{n} AS n{i}' for i, n in enumerate(names))} FROM {table} t0 {joins}"

    return f"""WITH shown AS (SELECT pid, node FROM predicted WHERE node IN (SELECT node FROM known)), p AS ({own('shown', 'pid')}), g AS ({own('known', 'kid')}), r AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng)
    SELECT tp, np - tp AS fp, ng - tp AS fn, round((tp + CAST(1e-5 AS DOUBLE)) / (np + CAST(1e-5 AS DOUBLE)), 6) AS precision, round((tp + CAST(1e-5 AS DOUBLE)) / (ng + CAST(1e-5 AS DOUBLE)), 6) AS recall FROM r"""


@query("clique_pr_k2", ["known", "predicted"], _clique_sql(2))
def clique_pr_k2(spark, sf):
    return rounded(metrics.clique_precision_recall(views.known(spark, sf), views.predicted(spark, sf), 2))


@query("clique_pr_k3", ["known", "predicted"], _clique_sql(3))
def clique_pr_k3(spark, sf):
    return rounded(metrics.clique_precision_recall(views.known(spark, sf), views.predicted(spark, sf), 3))


@query("clique_curve")
def clique_curve(spark, sf):
    return rounded(clique_samples.sampled_clique_curve(views.known(spark, sf), views.predicted(spark, sf)))


@query("clique_summary")
def clique_summary(spark, sf):
    return rounded(metrics.clique_summary(stored(clique_samples.sampled_clique_curve(views.known(spark, sf), views.predicted(spark, sf)))))


@query("unite_known")
def unite_known(spark, sf):
    return merge.unite_known(views.known(spark, sf).withColumnRenamed("kid", "cid"))


@query("saved_model")
def saved_model(spark, sf):
    fitted, rest = _community_model(spark, sf, "SVM")
    path = scratch(spark)
    fitted.save(path)
    return rounded(models.Classifier.load(path).score(rest).groupBy("label", "pred").agg(F.count("*").alias("n"), F.avg("score").alias("score")))


def _edge_scores(spark, sf):
    p = views.predicted(spark, sf).withColumnRenamed("pid", "cid")
    inside = p.select("cid", F.col("node").alias("src")).join(p.select("cid", F.col("node").alias("dst")), "cid").filter("src < dst")
    return metrics.edge_max_scores(inside, views.scores(spark, sf).withColumnRenamed("pid", "cid"))


@query("edge_max_score", ["edge_score"], "SELECT src, dst, round(score, 6) AS score FROM edge_score")
def edge_max_score(spark, sf):
    return rounded(_edge_scores(spark, sf))


@query("edge_pr_curve", ["curve"], "SELECT round(score, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(n AS BIGINT) AS n, round(CAST(tp AS DOUBLE) / n, 6) AS precision, round(CAST(tp AS DOUBLE) / tot, 6) AS recall, round(CAST(n - tp AS DOUBLE) / ((SELECT count(*) FROM labelled) - tot), 6) AS fpr FROM curve")
def edge_pr_curve(spark, sf):
    return rounded(metrics.ranked_curve(metrics.edge_labels(_edge_scores(spark, sf), views.copart(spark, sf, least=2))))


@query("average_precision", ["curve"], "SELECT round(sum(pos * CAST(tp AS DOUBLE) / n) / sum(pos), 6) AS average_precision FROM curve")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(metrics.edge_labels(_edge_scores(spark, sf), views.copart(spark, sf, least=2))))


@query("running_fdr", [], "SELECT doc_id AS id, CAST(quality AS DOUBLE) AS score, round(1 - CAST(sum(toxic) OVER w AS DOUBLE) / count(*) OVER w, 6) AS fdr FROM labels WINDOW w AS (ORDER BY quality DESC, doc_id ROWS UNBOUNDED PRECEDING)")
def running_fdr(spark, sf):
    return rounded(metrics.running_fdr(views.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"), F.col("toxic").alias("label"))))


@query("overall_fdr", ["labelled"], "SELECT round(CAST(sum(1 - label) AS DOUBLE) / count(*), 6) AS fdr FROM labelled")
def overall_fdr(spark, sf):
    return rounded(metrics.edge_labels(_edge_scores(spark, sf), views.copart(spark, sf, least=2)).agg(F.avg((1 - F.col("label")).cast("double")).alias("fdr")))


_RESULTS = "SELECT toxic AS label, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS pred FROM labels"


@query("confusion_metrics", [], f"""WITH r AS (SELECT CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM ({_RESULTS})),
    m AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r FROM r)
    SELECT tp, fn, fp, tn, round(r, 6) AS acc_pos, round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 6) AS acc_neg, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m""")
def confusion_metrics(spark, sf):
    rows = views.table(spark, sf, "labels").select(F.col("toxic").alias("label"), (F.col("quality") == 0).cast("int").alias("pred"))
    return rounded(metrics.confusion(rows))


@query("sizewise_accuracy", ["predicted", "scores", "ps"], "SELECT CAST(np AS INT) AS size, round(avg(CASE WHEN score >= 0.05 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy, count(*) AS total FROM ps JOIN scores USING (pid) GROUP BY 1")
def sizewise_accuracy(spark, sf):
    p = overlap.sizes(views.predicted(spark, sf), "pid", "size").join(views.scores(spark, sf), "pid")
    return rounded(metrics.sizewise_accuracy(p.select("size", (F.col("score") >= 0.05).cast("int").alias("pred")), 1))


@query("sizewise_scores", ["ps", "scores"], "SELECT np AS size, round(avg(score), 6) AS mean_score, count(*) AS total FROM ps JOIN scores USING (pid) GROUP BY 1")
def sizewise_scores(spark, sf):
    return rounded(metrics.sizewise_scores(overlap.sizes(views.predicted(spark, sf), "pid", "size").join(views.scores(spark, sf), "pid")))


# Training data -------------------------------------------------------------


def _basket_sizes(spark, sf):
    return overlap.sizes(views.known(spark, sf), "kid", "size")


@query("size_histogram", ["ks"], "SELECT nk AS size, count(*) AS n FROM ks GROUP BY 1")
def size_histogram(spark, sf):
    return _basket_sizes(spark, sf).groupBy("size").agg(F.count("*").alias("n"))


@query("iqr_max_size", ["ks"], "SELECT least(CAST(ceil(q3 + CAST(4.5 AS DOUBLE) * (q3 - q1)) AS BIGINT), m, 50) AS max_size FROM (SELECT quantile_cont(CAST(nk AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(nk AS DOUBLE), 0.75) AS q3, max(nk) AS m FROM ks)")
def iqr_max_size(spark, sf):
    return training.iqr_max_size(_basket_sizes(spark, sf), 50)


@query("negative_sizes_uniform", ["ks"], "SELECT CAST(s AS BIGINT) AS size, n FROM (SELECT min(nk) AS lo, max(nk) AS hi, CAST(ceil(ceil(CAST(count(*) AS DOUBLE) / (max(nk) - min(nk) + 1)) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS n FROM ks), generate_series(lo, hi) g(s)")
def negative_sizes_uniform(spark, sf):
    return training.uniform_sizes(_basket_sizes(spark, sf), 1.1)


@query("negative_sizes_same", ["ks"], "SELECT nk AS size, CAST(ceil(count(*) * CAST(1.1 AS DOUBLE)) AS BIGINT) AS n FROM ks GROUP BY 1")
def negative_sizes_same(spark, sf):
    return training.same_sizes(_basket_sizes(spark, sf), 1.1)


@query("exact_row_antijoin", [], "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'N' AND a.l_quantity = b.l_quantity AND a.l_discount = b.l_discount AND a.l_tax = b.l_tax AND a.l_partkey = b.l_partkey)")
def exact_row_antijoin(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    return training.drop_equal_rows(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'N'"), ["l_quantity", "l_discount", "l_tax", "l_partkey"]).select("l_orderkey", "l_linenumber")


@query("small_community_filter", ["basket"], "SELECT kid, count(*) AS n FROM basket GROUP BY 1 HAVING count(*) > 2")
def small_community_filter(spark, sf):
    return overlap.sizes(views.baskets(spark, sf), "kid", "n").filter("n > 2")


@query("known_node_filter", ["predicted"], "SELECT pid, node FROM predicted JOIN part ON p_partkey = node WHERE p_size > 15 QUALIFY count(*) OVER (PARTITION BY pid) >= 3")
def known_node_filter(spark, sf):
    return metrics.known_only(views.predicted(spark, sf), views.table(spark, sf, "part").filter("p_size > 15").select(F.col("p_partkey").alias("node")))


@query("known_node_filter_pairs", ["predicted"], "SELECT pid, node FROM predicted JOIN part ON p_partkey = node WHERE p_size > 15 QUALIFY count(*) OVER (PARTITION BY pid) >= 2")
def known_node_filter_pairs(spark, sf):
    return metrics.known_only(views.predicted(spark, sf), views.table(spark, sf, "part").filter("p_size > 15").select(F.col("p_partkey").alias("node")), 2)


@query("distinct_candidates", ["predicted", "scores"], "SELECT DISTINCT array_to_string(list_sort(list(node)), ' ') AS members, round(max(score), 6) AS score FROM predicted JOIN scores USING (pid) GROUP BY pid")
def distinct_candidates(spark, sf):
    lists = views.predicted(spark, sf).join(views.scores(spark, sf), "pid").groupBy("pid").agg(F.collect_list("node").alias("members"), F.max("score").alias("score"))
    return rounded(merge.distinct_candidates(lists).select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "score"))


@query("independent_split")
def independent_split(spark, sf):
    """Baskets, many of which share pairs of parts."""
    known = stored(views.known(spark, sf).withColumnRenamed("kid", "cid"))
    return training.independent_split(stored(graph.induced_edges(views.copart(spark, sf), known)), known)


# Reports -------------------------------------------------------------------


@query("id_name_lookup", ["brand", "names"], "SELECT DISTINCT cid, coalesce(nullif(name, '-'), CAST(node AS VARCHAR)) AS name FROM brand LEFT JOIN names ON id = node")
def id_name_lookup(spark, sf):
    return reporting.with_names(views.brand_parts(spark, sf), views.part_names(spark, sf))


@query("edge_relabel", ["copart", "names"], "SELECT coalesce(nullif(a.name, '-'), CAST(src AS VARCHAR)) AS src, coalesce(nullif(b.name, '-'), CAST(dst AS VARCHAR)) AS dst, weight FROM copart LEFT JOIN names a ON a.id = src LEFT JOIN names b ON b.id = dst")
def edge_relabel(spark, sf):
    return reporting.relabel_edges(views.copart(spark, sf), views.part_names(spark, sf))


@query("edge_in_known_flags", ["copart"], """WITH tr AS (SELECT p_partkey AS node FROM part WHERE p_size <= 30), te AS (SELECT p_partkey AS node FROM part WHERE p_size >= 20 AND p_size <= 45)
    SELECT src, dst, (src IN (SELECT node FROM tr) OR src IN (SELECT node FROM te)) AND (dst IN (SELECT node FROM tr) OR dst IN (SELECT node FROM te)) AS in_known, src IN (SELECT node FROM tr) AND dst IN (SELECT node FROM tr) AS in_train, src IN (SELECT node FROM te) AND dst IN (SELECT node FROM te) AS in_test FROM copart""")
def edge_in_known_flags(spark, sf):
    parts = views.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return reporting.in_known(views.copart(spark, sf), parts.filter("p_size <= 30"), parts.filter("p_size >= 20 and p_size <= 45"))


@query("inverted_index", ["sup", "supn"], "SELECT node, array_to_string(list(cid ORDER BY -n, cid), ' ') AS cids FROM sup JOIN supn USING (cid) GROUP BY 1")
def inverted_index(spark, sf):
    own = views.supplier_parts(spark, sf)
    return reporting.inverted_index(own, overlap.sizes(own, "cid", "n").select("cid", (-F.col("n")).alias("rank"))).select("node", F.array_join(F.col("cids").cast("array<string>"), " ").alias("cids"))


@query("bucketed_index", [], "SELECT CASE WHEN p_size <= 40 THEN CAST(p_size % 6 AS VARCHAR) ELSE 'Unknown' END AS bucket, CAST(p_partkey AS VARCHAR) AS name FROM part")
def bucketed_index(spark, sf):
    names = views.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"))
    return reporting.by_bucket(names, views.annotations(spark, sf).select(F.col("node").cast("string").alias("name"), "score"))


@query("annotation_scores", ["known", "ann"], """WITH s AS (SELECT kid AS cid, coalesce(score, 0) AS s FROM known LEFT JOIN ann USING (node)),
    g AS (SELECT cid, CAST(0.2 AS DOUBLE) * sum(s) / count(*) AS char, CAST(count(*) FILTER (s = 5) AS DOUBLE) AS c5, CAST(count(*) FILTER (s = 4) AS DOUBLE) AS c4, CAST(count(*) FILTER (s = 3) AS DOUBLE) AS c3, CAST(count(*) FILTER (s = 2) AS DOUBLE) AS c2, CAST(count(*) FILTER (s < 2) AS DOUBLE) AS c01, min(s) AS least, median(s) AS median FROM s GROUP BY 1)
    SELECT cid, round(char, 6) AS char, CASE WHEN (c5 + c4) * (c01 + c2 + c3) = 0 THEN 0 ELSE round((c5 + CAST(0.9 AS DOUBLE) * c4) * (c01 + CAST(0.9 AS DOUBLE) * c2 + CAST(0.8 AS DOUBLE) * c3) / ((c5 + c4) * (c01 + c2 + c3)), 6) END AS cand, least, median FROM g""")
def annotation_scores(spark, sf):
    return rounded(reporting.annotation_scores(views.known(spark, sf).withColumnRenamed("kid", "cid"), views.annotations(spark, sf)))


@query("interactor_counts", ["known", "inter"], "SELECT kid AS cid, count(DISTINCT node) AS n_members, count(DISTINCT bait) AS n_partners FROM known JOIN inter ON prey = node WHERE weight > 60 GROUP BY 1")
def interactor_counts(spark, sf):
    return reporting.interactor_counts(views.known(spark, sf).withColumnRenamed("kid", "cid"), views.interactions(spark, sf).filter("weight > 60"))


@query("interactor_count_counts", ["known", "inter"], "SELECT n_partners AS value, count(*) AS n FROM (SELECT kid, count(DISTINCT bait) AS n_partners FROM known JOIN inter ON prey = node WHERE weight > 60 GROUP BY 1) GROUP BY 1")
def interactor_count_counts(spark, sf):
    return reporting.count_of_counts(interactor_counts(spark, sf), "n_partners")


@query("bait_community_weight", ["inter", "bra"], "WITH s AS (SELECT bait, pid AS cid, sum(weight) AS w FROM inter JOIN bra ON node = prey GROUP BY 1, 2) SELECT bait, cid, round(w / (SELECT max(w) FROM s), 6) AS weight FROM s")
def bait_community_weight(spark, sf):
    return rounded(reporting.bait_community_weights(views.interactions(spark, sf), views.brands(spark, sf)))


@query("mapped_interactions", ["inter"], "SELECT bait, prey, weight FROM inter WHERE prey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def mapped_interactions(spark, sf):
    parts = views.table(spark, sf, "part").filter("p_size > 25").select(F.lit("c").alias("cid"), F.col("p_partkey").alias("node"))
    return reporting.mapped_interactions(views.interactions(spark, sf), parts)


@query("bait_groups", ["inter"], "SELECT bait, count(*) AS n, array_to_string(list(prey ORDER BY weight DESC, prey), ' ') AS preys FROM inter GROUP BY 1")
def bait_groups(spark, sf):
    return reporting.by_bait(views.interactions(spark, sf)).select("bait", "n", F.array_join(F.col("preys").cast("array<string>"), " ").alias("preys"))


@query("edges_or_dummies", ["induced", "known", "copart"], """WITH i AS (SELECT a.kid AS cid, src, dst, weight FROM copart JOIN known a ON a.node = src JOIN known b ON b.node = dst AND a.kid = b.kid)
    SELECT * FROM i UNION ALL SELECT kid, min(node), min(node), 0.0 FROM known WHERE kid NOT IN (SELECT cid FROM i) GROUP BY 1""")
def edges_or_dummies(spark, sf):
    own = views.known(spark, sf).withColumnRenamed("kid", "cid")
    return reporting.edges_or_dummies(stored(graph.induced_edges(views.copart(spark, sf), own)), own)


@query("map_overlay", [], "SELECT coalesce(n.k, o.k) AS id, coalesce(n.v, o.v) AS value FROM (SELECT s_suppkey AS k, s_name AS v FROM supplier) o FULL JOIN (SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size > 20) n ON n.k = o.k")
def map_overlay(spark, sf):
    old = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("value"))
    return reporting.overlay(old, views.table(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value")))


@query("linked_members", ["basket"], "SELECT DISTINCT node, coalesce(url, CAST(node AS VARCHAR)) AS link FROM basket LEFT JOIN pages ON page_id = node")
def linked_members(spark, sf):
    return reporting.linked(views.baskets(spark, sf), views.table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"))


@query("pair_score_average", [], "SELECT l_partkey AS a, l_suppkey AS b, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1, 2")
def pair_score_average(spark, sf):
    return rounded(reporting.mean_by_pair(views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_discount").alias("score"))))


@query("sweep_best", [], "SELECT event_type AS metric, user_id AS run, value FROM (SELECT event_type, user_id, max(value) AS value FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) = 1")
def sweep_best(spark, sf):
    runs = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), F.col("user_id").alias("run")).agg(F.max("value").alias("value"))
    return reporting.best_per_metric(runs)


@query("sweep_table", [], "SELECT user_id AS run, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def sweep_table(spark, sf):
    runs = views.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")
    return reporting.sweep_table(runs, ["click", "view"])


@query("ranked_matches", ["ov"], "SELECT row_number() OVER (ORDER BY f1 DESC, kid) AS rank, kid, pid, round(f1, 6) AS f1 FROM (SELECT kid, pid, 2 * c / (nk + np) AS f1 FROM ov QUALIFY row_number() OVER (PARTITION BY kid ORDER BY 2 * c / (nk + np) DESC, pid) = 1)")
def ranked_matches(spark, sf):
    best = overlap.best_matches(overlap.measures(_best_overlaps(spark, sf)), "kid", "f1").select("kid", "pid", "f1")
    return rounded(reporting.ranked(best, F.desc("f1"), F.col("kid")).select(F.col("rank").cast("long").alias("rank"), "kid", "pid", "f1"))


@query("ranked_communities", ["known", "inter"], "SELECT row_number() OVER (ORDER BY n DESC, cid) AS rank, cid, n FROM (SELECT kid AS cid, count(DISTINCT node) AS n FROM known JOIN inter ON prey = node WHERE weight > 60 GROUP BY 1)")
def ranked_communities(spark, sf):
    counts = reporting.interactor_counts(views.known(spark, sf).withColumnRenamed("kid", "cid"), views.interactions(spark, sf).filter("weight > 60")).select("cid", F.col("n_members").alias("n"))
    return reporting.ranked(counts, F.desc("n"), F.col("cid")).select(F.col("rank").cast("long").alias("rank"), "cid", "n")


@query("without_last_edge", ["inter"], "SELECT bait, prey, weight FROM inter QUALIFY row_number() OVER (ORDER BY bait DESC, prey DESC) > 1")
def without_last_edge(spark, sf):
    return reporting.without_last(views.interactions(spark, sf), F.col("bait"), F.col("prey"))


@query("label_filter", [], "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('N', 'R')")
def label_filter(spark, sf):
    return reporting.labelled(views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["N", "R"])


@query("candidate_retrieval", ["predicted", "scores"], "SELECT pid AS seed, score FROM scores WHERE pid IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def candidate_retrieval(spark, sf):
    seeds = views.table(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("seed"))
    return reporting.retrieved(seeds, views.scores(spark, sf).withColumnRenamed("pid", "seed"))


_INTERACTORS = "SELECT kid AS cid, count(DISTINCT node) AS n_members, count(DISTINCT bait) AS n_partners FROM known JOIN inter ON prey = node WHERE weight > 60 GROUP BY 1"
_COMMUNITY_LIST = f"""WITH c AS ({_INTERACTORS}), n AS (SELECT kid AS cid, array_to_string(list_sort(list(DISTINCT coalesce(nullif(name, '-'), CAST(node AS VARCHAR)))), ' ') AS members FROM known LEFT JOIN names ON id = node GROUP BY 1)
    SELECT n.cid, members, coalesce(n_members, 0) AS n_members, coalesce(n_partners, 0) AS n_partners FROM n"""


@query("community_list", ["known", "inter", "names"], f"{_COMMUNITY_LIST} LEFT JOIN c ON c.cid = n.cid")
def community_list(spark, sf, only=False):
    known = views.known(spark, sf).withColumnRenamed("kid", "cid")
    return reporting.community_list(known, views.part_names(spark, sf), views.interactions(spark, sf).filter("weight > 60"), only)


@query("interactor_community_list", ["known", "inter", "names"], f"{_COMMUNITY_LIST} JOIN c ON c.cid = n.cid")
def interactor_community_list(spark, sf):
    return community_list(spark, sf, only=True)


@query(
    "community_pages",
    ["known", "predicted", "scores", "inter", "copart"],
    """WITH m AS (SELECT a.pid AS cid, count(*) AS m FROM copart JOIN predicted a ON a.node = src JOIN predicted b ON b.node = dst AND a.pid = b.pid WHERE weight > 0 GROUP BY 1), n AS (SELECT pid AS cid, count(*) AS nodes FROM predicted GROUP BY 1),
    c AS (SELECT pid AS cid, count(DISTINCT node) AS n_members, count(DISTINCT bait) AS n_partners FROM predicted JOIN inter ON prey = node WHERE inter.weight > 60 GROUP BY 1)
    SELECT n.cid, nodes, coalesce(m, 0) AS edges, round(2 * coalesce(m, 0) / CAST(nodes * (nodes - 1) AS DOUBLE), 6) AS density, 2 * coalesce(m, 0) / CAST(nodes * (nodes - 1) AS DOUBLE) > 0.8 AS dense, round(score, 6) AS score, coalesce(n_members, 0) AS n_members, coalesce(n_partners, 0) AS n_partners
    FROM n LEFT JOIN m USING (cid) LEFT JOIN scores ON pid = cid LEFT JOIN c USING (cid)""",
)
def community_pages(spark, sf):
    own = views.predicted(spark, sf).withColumnRenamed("pid", "cid")
    scores = views.scores(spark, sf).withColumnRenamed("pid", "cid")
    return rounded(reporting.community_pages(graph.induced_edges(views.copart(spark, sf), own), own, scores, views.interactions(spark, sf).filter("weight > 60")))


_MAP = """met AS (SELECT bait, prey, weight FROM inter WHERE weight > 60 AND prey IN (SELECT node FROM bra)),
    own AS (SELECT DISTINCT bait, node, pid AS cid FROM met JOIN bra ON node = prey)"""


@query("interaction_map", ["inter", "bra"], f"""WITH {_MAP} SELECT CAST(bait AS VARCHAR) AS source, CAST(prey AS VARCHAR) AS target, 'interaction' AS kind, weight FROM met
    UNION ALL SELECT DISTINCT CAST(node AS VARCHAR), cid, 'member', CAST(1 AS DOUBLE) FROM own""")
def interaction_map(spark, sf):
    return reporting.interaction_map(views.interactions(spark, sf).filter("weight > 60"), views.brands(spark, sf))


@query("bait_maps", ["inter", "sup", "selfov"], """WITH met AS (SELECT bait, prey, weight FROM inter WHERE weight > 60 AND prey IN (SELECT node FROM sup)), own AS (SELECT DISTINCT bait, node, cid FROM met JOIN sup ON node = prey), t AS (SELECT DISTINCT bait, cid FROM own)
    SELECT bait, CAST(bait AS VARCHAR) AS source, CAST(prey AS VARCHAR) AS target, 'interaction' AS kind, round(weight, 6) AS weight FROM met
    UNION ALL SELECT bait, CAST(node AS VARCHAR), CAST(cid AS VARCHAR), 'member', CAST(1 AS DOUBLE) FROM own
    UNION ALL SELECT a.bait, CAST(cid1 AS VARCHAR), CAST(cid2 AS VARCHAR), 'overlap', round(c / (n1 + n2 - c), 6) FROM selfov JOIN t a ON a.cid = cid1 JOIN t b ON b.cid = cid2 AND a.bait = b.bait""")
def bait_maps(spark, sf):
    return rounded(reporting.bait_maps(views.interactions(spark, sf).filter("weight > 60"), views.supplier_parts(spark, sf)))


_REGISTRY = "SELECT p_brand AS classifier, p_retailprice AS score, p_type || '(' || p_name || ',' || CAST(p_partkey AS VARCHAR) || ')' AS pipeline FROM part"


def _registry(spark, sf):
    text = F.concat("p_type", F.lit("("), "p_name", F.lit(","), F.col("p_partkey").cast("string"), F.lit(")"))
    return views.table(spark, sf, "part").select(F.col("p_brand").alias("classifier"), F.col("p_retailprice").alias("score"), text.alias("pipeline"), F.col("p_partkey").alias("place"))


@query("best_classifier", [], f"SELECT * FROM ({_REGISTRY}) ORDER BY score DESC, classifier LIMIT 1")
def best_classifier(spark, sf):
    return models.best_classifier(_registry(spark, sf))


@query("best_pipeline_per_family", [], f"SELECT split_part(pipeline, '(', 1) AS family, pipeline, score FROM ({_REGISTRY}) QUALIFY row_number() OVER (PARTITION BY split_part(pipeline, '(', 1) ORDER BY score DESC, pipeline) = 1")
def best_pipeline_per_family(spark, sf):
    return models.best_pipeline_per_family(_registry(spark, sf))


@query("runtime_shares", [], "SELECT event_type AS stage, round(sum(value), 6) AS seconds, round(100 * sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY 1")
def runtime_shares(spark, sf):
    return rounded(reporting.runtime_shares(views.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("seconds"))))


@query("score_histogram", ["scores"], "WITH b AS (SELECT min(score) AS lo, (max(score) - min(score)) / 20 AS w FROM scores) SELECT CAST(least(floor((score - lo) / w), 19) AS INT) AS bin, round(lo + CAST(least(floor((score - lo) / w), 19) AS INT) * w, 6) AS low, count(*) AS n FROM scores, b GROUP BY 1, 2")
def score_histogram(spark, sf):
    return rounded(reporting.histogram(views.scores(spark, sf), "score", 20))


# Set operations ------------------------------------------------------------


@query("node_union", [], "SELECT l_partkey AS node FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def node_union(spark, sf):
    left = views.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("node"))
    return left.unionByName(views.table(spark, sf, "part").filter("p_size < 5").select(F.col("p_partkey").alias("node"))).distinct()


@query("node_difference", [], "SELECT p_partkey AS node FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def node_difference(spark, sf):
    return views.table(spark, sf, "part").select(F.col("p_partkey").alias("node")).subtract(views.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("node")))


@query("node_intersection", [], "SELECT p_partkey AS node FROM part WHERE p_size < 5 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def node_intersection(spark, sf):
    return views.table(spark, sf, "part").filter("p_size < 5").select(F.col("p_partkey").alias("node")).intersect(views.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("node")))


# Search, walks and models --------------------------------------------------


def dense_score(f: dict[str, float]) -> float:
    """A fixed scorer: the density."""
    return f["dens"]


def _candidates(spark, sf, method, edges=None):
    """Communities grown from all nodes, up to the size that the spread of basket sizes allows."""
    own = stored(views.copart(spark, sf)) if edges is None else None
    neighbours = graph.adjacency(edges if own is None else own)
    largest = training.iqr_max_size(_basket_sizes(spark, sf)).first().max_size or 3
    grown = search.grow(neighbours.select("node"), neighbours, dense_score, search.Growth(method=method, max_size=int(largest), threshold=0.6, seed=1))
    forget(own)
    return grown


def _texts(candidates):
    return rounded(candidates.select("seed", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "score"))


@query("grow_heaviest")
def grow_heaviest(spark, sf):
    return _texts(_candidates(spark, sf, "heaviest"))


@query("grow_top")
def grow_top(spark, sf):
    return _texts(_candidates(spark, sf, "top"))


@query("grow_metropolis")
def grow_metropolis(spark, sf):
    return _texts(_candidates(spark, sf, "metropolis"))


@query("grow_annealing")
def grow_annealing(spark, sf):
    return _texts(_candidates(spark, sf, "annealing"))


@query("maximal_cliques")
def maximal_cliques(spark, sf):
    found = search.maximal_cliques(views.copart(spark, sf))
    return found.select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"))


@query("merge_overlapping")
def merge_overlapping(spark, sf):
    edges = stored(views.copart(spark, sf))
    grown = merge.distinct_candidates(_candidates(spark, sf, "heaviest", edges).select("members", "score"))
    merged = merge.merge_overlapping(grown, edges, 0.3, dense_score)
    return rounded(merged.select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "score"))


@query("merge_nearest")
def merge_nearest(spark, sf):
    edges = stored(views.copart(spark, sf))
    grown = merge.distinct_candidates(_candidates(spark, sf, "heaviest", edges).select("members", "score"))
    merged = merge.merge_nearest(grown, edges, 0.3, dense_score)
    return rounded(merged.select(F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "score"))


def _walk_plan(spark, sf):
    """``size, n``: negatives of all sizes of baskets, a tenth more than there are baskets."""
    return training.same_sizes(_basket_sizes(spark, sf), 1.1)


@query("random_walks")
def random_walks(spark, sf):
    return training.random_walks(graph.adjacency(views.copart(spark, sf)), _walk_plan(spark, sf), seed=3)


@query("detect_communities")
def detect_communities(spark, sf):
    known = views.known(spark, sf).withColumnRenamed("kid", "cid")
    edges = stored(views.copart(spark, sf))
    found, split, _ = detect.detect(edges, known)
    return rounded(detect.measure(found, known, split))


def _community_model(spark, sf, name):
    """A model of the known communities and of as many walked negatives and a tenth more, and the rows that it was not fitted to."""
    edges = stored(views.copart(spark, sf))
    known = stored(views.known(spark, sf).withColumnRenamed("kid", "cid"))
    rows = detect.taught_rows(edges, stored(graph.adjacency(edges)), known, stored(overlap.sizes(known, "cid", "size")), detect.Job())
    dealt = stored(training.stratified_folds(rows, "label", "cid", 10))
    return models.train(dealt.filter("fold < 7"), FEATURES, name), dealt.filter("fold >= 7")


@query("train_and_test")
def train_and_test(spark, sf):
    fitted, rest = _community_model(spark, sf, "log_reg")
    return rounded(models.evaluate(fitted, rest))
