"""Tables behind reports: names, indexes, annotations, interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sets import ratio
from .overlap import jaccard_pairs
from .ranges import running_sums


def with_names(membership: DataFrame, names: DataFrame) -> DataFrame:
    """``cid, name``: distinct names of the members; an id without a name, or with ``-``, keeps itself."""
    joined = membership.join(names.select(F.col("id").alias("node"), "name"), "node", "left")
    return joined.select("cid", F.coalesce(F.nullif("name", F.lit("-")), F.col("node").cast("string")).alias("name")).distinct()


def relabel_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with names for ids; unnamed ends keep their ids."""
    for end in ("src", "dst"):
        edges = edges.join(names.select(F.col("id").alias(end), F.col("name").alias("_name")), end, "left").withColumn(end, F.coalesce(F.nullif("_name", F.lit("-")), F.col(end).cast("string"))).drop("_name")
    return edges.select("src", "dst", "weight")


def in_known(edges: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """``src, dst`` and whether both ends are known, trained on, or tested on."""
    flags = train.select("node", F.lit(1).alias("tr"), F.lit(0).alias("te")).unionByName(test.select("node", F.lit(0).alias("tr"), F.lit(1).alias("te"))).groupBy("node").agg(F.max("tr").alias("tr"), F.max("te").alias("te"))
    for end, tag in (("src", "a"), ("dst", "b")):
        edges = edges.join(flags.select(F.col("node").alias(end), F.col("tr").alias(f"tr_{tag}"), F.col("te").alias(f"te_{tag}")), end, "left")
    both = lambda a, b: F.coalesce(F.col(a), F.lit(0)) * F.coalesce(F.col(b), F.lit(0)) == 1
    known = F.col("tr_a").isNotNull() & F.col("tr_b").isNotNull()
    return edges.select("src", "dst", known.alias("in_known"), both("tr_a", "tr_b").alias("in_train"), both("te_a", "te_b").alias("in_test"))


def inverted_index(membership: DataFrame, ranks: DataFrame) -> DataFrame:
    """``node, cids``: each node's communities in the order of ``ranks(cid, rank)``."""
    ordered = membership.join(ranks, "cid").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "cid"))).alias("r"))
    return ordered.select("node", F.col("r.cid").alias("cids"))


def by_bucket(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """``bucket, name``: nodes under their annotation score, or ``Unknown``."""
    return nodes.join(annotations, "name", "left").select(F.coalesce(F.col("score").cast("string"), F.lit("Unknown")).alias("bucket"), "name")


def annotation_scores(membership: DataFrame, annotations: DataFrame) -> DataFrame:
    """``cid, char, cand, least, median`` of the members' scores from 0 to 5, unknown ones 0.

    ``char`` is a fifth of the mean; ``cand`` is high when well and barely known members meet.
    """
    s = membership.join(annotations, "node", "left").select("cid", F.coalesce("score", F.lit(0)).alias("s"))
    share = lambda k: F.sum((F.col("s") == k).cast("double"))
    g = s.groupBy("cid").agg((0.2 * F.sum("s") / F.count("*")).alias("char"), *(share(k).alias(f"c{k}") for k in range(6)), F.min("s").alias("least"), F.median("s").alias("median"))
    high, low = F.col("c5") + F.col("c4"), F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3")
    cand = ratio((F.col("c5") + 0.9 * F.col("c4")) * (F.col("c0") + F.col("c1") + 0.9 * F.col("c2") + 0.8 * F.col("c3")), high * low)
    return g.select("cid", "char", cand.alias("cand"), "least", "median")


def interactor_counts(membership: DataFrame, interactions: DataFrame) -> DataFrame:
    """``cid, n_members, n_partners``: members that are preys, and distinct baits of them."""
    met = membership.join(interactions.select(F.col("prey").alias("node"), "bait"), "node")
    return met.groupBy("cid").agg(F.countDistinct("node").alias("n_members"), F.countDistinct("bait").alias("n_partners"))


def count_of_counts(counts: DataFrame, column: str) -> DataFrame:
    """``value, n``: how often each count occurs."""
    return counts.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def bait_community_weights(interactions: DataFrame, membership: DataFrame) -> DataFrame:
    """``bait, cid, weight``: summed interaction weights by community, over the largest sum."""
    sums = interactions.join(membership.select(F.col("node").alias("prey"), "cid"), "prey").groupBy("bait", "cid").agg(F.sum("weight").alias("w"))
    top = sums.agg(F.max("w").alias("top"))
    return sums.crossJoin(top).select("bait", "cid", (F.col("w") / F.col("top")).alias("weight"))  # of one row


def mapped_interactions(interactions: DataFrame, membership: DataFrame) -> DataFrame:
    """Interactions whose prey is in a community."""
    return interactions.join(membership.select(F.col("node").alias("prey")), "prey", "left_semi").select("bait", "prey", "weight")


def by_bait(interactions: DataFrame) -> DataFrame:
    """``bait, n, preys``: preys of each bait, heaviest first."""
    r = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "prey")))
    return interactions.groupBy("bait").agg(F.count("*").alias("n"), r.alias("r")).select("bait", "n", F.col("r.prey").alias("preys"))


def display_density(induced: DataFrame, membership: DataFrame) -> DataFrame:
    """``cid, nodes, edges, density, dense``: edges of weight above zero over all possible ones; dense above 0.8."""
    m = induced.filter("weight > 0").groupBy("cid").agg(F.count("*").alias("m"))
    n = membership.groupBy("cid").agg(F.count("*").alias("nodes")).join(m, "cid", "left").fillna(0, ["m"])
    density = ratio(2 * F.col("m"), F.col("nodes") * (F.col("nodes") - 1))
    return n.select("cid", "nodes", F.col("m").alias("edges"), density.alias("density"), (density > 0.8).alias("dense"))


def edges_or_dummies(induced: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges of each community; one without any has an edge of weight 0 from its first member to itself."""
    first = membership.groupBy("cid").agg(F.min("node").alias("node"))
    none = first.join(induced.select("cid").distinct(), "cid", "left_anti")
    return induced.select("cid", "src", "dst", "weight").unionByName(none.select("cid", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).cast(dict(induced.dtypes)["weight"]).alias("weight")))


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, value`` of both maps; the new one wins."""
    return old.select("id", F.col("value").alias("o")).join(new.select("id", F.col("value").alias("n")), "id", "full").select("id", F.coalesce("n", "o").alias("value"))


def linked(members: DataFrame, urls: DataFrame) -> DataFrame:
    """``node, link``: each distinct member's URL, or its bare name."""
    return members.select("node").distinct().join(urls.select(F.col("id").alias("node"), "url"), "node", "left").select("node", F.coalesce("url", F.col("node").cast("string")).alias("link"))


def mean_by_pair(results: DataFrame) -> DataFrame:
    """``a, b, score``: the mean over several results, without those that lack the pair."""
    return results.groupBy("a", "b").agg(F.avg("score").alias("score"))


def best_per_metric(runs: DataFrame) -> DataFrame:
    """``metric, run, value``: the run with the largest value of each metric, the first on ties."""
    place = F.row_number().over(W.partitionBy("metric").orderBy(F.desc("value"), "run"))
    return runs.withColumn("place", place).filter("place = 1").select("metric", "run", "value")


def runtime_shares(stages: DataFrame) -> DataFrame:
    """``stage, seconds, share``: percent of the whole run."""
    whole = stages.agg(F.sum("seconds").alias("whole"))
    return stages.crossJoin(whole).select("stage", "seconds", (100 * ratio(F.col("seconds"), F.col("whole"))).alias("share"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, low, n``: equal bins from the smallest to the largest value."""
    low, high = values.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, n long")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return values.filter(F.col(column).isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), "n")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with their ``rank`` from 1, in an order that has to be total."""
    return running_sums(rows, list(order), {"rank": F.lit(1)})


def without_last(rows: DataFrame, *order: Column) -> DataFrame:
    """All rows but the last one of an order, which has to be total."""
    whole = rows.agg(F.count("*").alias("_n"))
    return ranked(rows, *order).crossJoin(F.broadcast(whole)).filter("rank < _n").drop("rank", "_n")  # of one row


def labelled(rows: DataFrame, column: str, labels: list) -> DataFrame:
    """Rows with one of a few labels."""
    return rows.filter(F.col(column).isin(labels))


def retrieved(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the seeds; a seed without one is left out."""
    return results.join(seeds.select("seed").distinct(), "seed", "left_semi")


def sweep_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """``run`` and a column for each of a few metrics, of ``runs(run, metric, value)``."""
    return runs.groupBy("run").pivot("metric", metrics).agg(F.max("value"))


def community_list(membership: DataFrame, names: DataFrame, interactions: DataFrame, only: bool = False) -> DataFrame:
    """``cid, members, n_members, n_partners``: sorted names, and the counts of interactors; ``only`` communities that have some."""
    named = with_names(membership, names).groupBy("cid").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("members"))
    return named.join(interactor_counts(membership, interactions), "cid", "inner" if only else "left").fillna(0, ["n_members", "n_partners"])


def community_pages(induced: DataFrame, membership: DataFrame, scores: DataFrame, interactions: DataFrame) -> DataFrame:
    """``cid, nodes, edges, density, dense, score, n_members, n_partners``: what a page of a community shows."""
    shape = display_density(induced, membership).join(scores.select("cid", "score"), "cid", "left")
    return shape.join(interactor_counts(membership, interactions), "cid", "left").fillna(0, ["n_members", "n_partners"])


def interaction_map(interactions: DataFrame, membership: DataFrame) -> DataFrame:
    """``source, target, kind, weight``: interactions whose prey is in a community (``interaction``), and these preys' communities (``member``, of weight 1)."""
    met = mapped_interactions(interactions, membership)
    own = membership.join(met.select(F.col("prey").alias("node")), "node", "left_semi").distinct()
    edge = lambda a, b, kind, w: (F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(kind).alias("kind"), w.cast("double").alias("weight"))
    return met.select(*edge("bait", "prey", "interaction", F.col("weight"))).unionByName(own.select(*edge("node", "cid", "member", F.lit(1))))


def bait_maps(interactions: DataFrame, membership: DataFrame) -> DataFrame:
    """``bait, source, target, kind, weight``: around each bait its preys in communities, these communities, and links between those that share members."""
    met = mapped_interactions(interactions, membership)
    own = met.select("bait", F.col("prey").alias("node")).join(membership, "node").select("bait", "node", "cid").distinct()
    touched = own.select("bait", "cid").distinct()
    first, second = (touched.select("bait", F.col("cid").alias(c)) for c in ("cid1", "cid2"))
    near = jaccard_pairs(membership).join(first, "cid1").join(second, ["bait", "cid2"])
    edge = lambda a, b, kind, w: ("bait", F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(kind).alias("kind"), w.cast("double").alias("weight"))
    return met.select(*edge("bait", "prey", "interaction", F.col("weight"))).unionByName(own.select(*edge("node", "cid", "member", F.lit(1)))).unionByName(near.select(*edge("cid1", "cid2", "overlap", F.col("jaccard"))))
