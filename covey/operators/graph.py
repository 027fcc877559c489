"""Weighted undirected graphs as edge tables, and subgraphs of communities.

An edge table is ``src, dst, weight`` with ``src < dst``; a membership is
``cid, node``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components


def canonical_edges(lines: DataFrame) -> DataFrame:
    """Edges of ``line, src, dst, weight`` without self-loops; of repeated ones the last line wins."""
    ends = lines.filter("src <> dst").select("line", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return ends.groupBy("src", "dst").agg(F.max_by("weight", "line").alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``node, nbr, weight`` in both directions."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), "weight").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), "weight"))


def network_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, and the most and mean neighbours of a node."""
    degrees = adjacency(edges).groupBy("node").agg(F.count("*").alias("d"))
    return degrees.agg(F.count("*").alias("n_nodes"), F.coalesce((F.sum("d") / 2).cast("long"), F.lit(0)).alias("n_edges"), F.max("d").alias("max_neighbors"), F.avg("d").alias("avg_neighbors"))


def restrict(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes(node)``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "weight")


#: Members up to which the pairs of a community are made and looked up among the edges.
SMALL = 64


def induced_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``cid, src, dst, weight`` of all edges inside each community.

    Pairs of members of a community up to ``SMALL`` are looked up among the edges, so the
    work follows the communities; only larger ones are joined to all edges of their members.
    """
    sized = membership.select("cid", "node").withColumn("n", F.count("*").over(W.partitionBy("cid")))
    small, large = sized.filter(F.col("n") <= SMALL), sized.filter(F.col("n") > SMALL)
    ends = lambda own: (own.select("cid", F.col("node").alias("src")), own.select("cid", F.col("node").alias("dst")))
    src, dst = ends(small)
    inside = src.join(dst, "cid").filter("src < dst").join(edges, ["src", "dst"]).select("cid", "src", "dst", "weight")
    if large.isEmpty():
        return inside
    src, dst = ends(large)
    return inside.unionByName(edges.join(src, "src").join(dst, ["cid", "dst"]).select("cid", "src", "dst", "weight"))


def node_degrees(induced: DataFrame, membership: DataFrame) -> DataFrame:
    """``cid, node, d`` for each member with an edge, and with 0 for the others that ``membership`` keeps."""
    ends = induced.select("cid", F.col("src").alias("node")).unionByName(induced.select("cid", F.col("dst").alias("node")))
    return membership.join(ends.groupBy("cid", "node").agg(F.count("*").alias("d")), ["cid", "node"], "left").select("cid", "node", F.coalesce("d", F.lit(0)).alias("d"))


def known_members(membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Members that are nodes of the graph."""
    return membership.join(adjacency(edges).select("node").distinct(), "node", "left_semi").select("cid", "node")


def unique_edges(induced: DataFrame) -> DataFrame:
    """Distinct edges over all communities."""
    return induced.select("src", "dst").distinct()


def edges_sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``cid`` of the communities in ``left(cid, src, dst)`` that share an edge with one in ``right``."""
    return left.join(right.select("src", "dst"), ["src", "dst"], "left_semi").select("cid").distinct()


def connected_communities(induced: DataFrame, membership: DataFrame) -> DataFrame:
    """``cid, parts, connected`` by components of the pairs of a community and a node."""
    ids = membership.select(F.xxhash64("cid", "node").alias("id"), "cid")
    links = induced.select(F.xxhash64("cid", "src").alias("a"), F.xxhash64("cid", "dst").alias("b"))
    named = ids.join(components(links), F.col("id") == F.col("node"), "left").select("cid", F.coalesce("component", "id").alias("component"))
    return named.groupBy("cid").agg(F.countDistinct("component").alias("parts")).withColumn("connected", F.col("parts") == 1)


def clean_communities(communities: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """``cid, members`` of distinct communities with ``least`` members in the graph that hang together."""
    wide = communities.filter(F.size("members") >= least).select("cid", F.explode("members").alias("node"))
    inside = known_members(wide, edges)
    whole = connected_communities(induced_edges(edges, inside), inside).filter("connected").select("cid")
    lists = inside.join(whole, "cid", "left_semi").groupBy("cid").agg(F.array_sort(F.collect_set("node")).alias("members")).filter(F.size("members") >= least)
    return lists.groupBy("members").agg(F.min("cid").alias("cid")).select("cid", "members")


def frontier(members: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``cid, nbr, weight``: nodes next to a community that are not in it, with their heaviest edge to it."""
    reached = members.join(neighbours, "node").groupBy("cid", "nbr").agg(F.max("weight").alias("weight"))
    return reached.join(members.select("cid", F.col("node").alias("nbr")), ["cid", "nbr"], "left_anti").select("cid", "nbr", "weight")


def top_frontier(around: DataFrame, share: float, least: int) -> DataFrame:
    """The heaviest ``ceil(share n)`` of a frontier with more than ``least`` nodes, else all of it."""
    n = F.count("*").over(W.partitionBy("cid"))
    place = F.row_number().over(W.partitionBy("cid").orderBy(F.desc("weight"), "nbr"))
    ranked = around.withColumn("n", n).withColumn("place", place)
    return ranked.filter((F.col("n") <= least) | (F.col("place") <= F.ceil(F.lit(share) * F.col("n")))).select("cid", "nbr", "weight")


def starting_edges(neighbours: DataFrame) -> DataFrame:
    """``node, nbr, weight``: each node's heaviest edge, the first neighbour on ties."""
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "nbr"))
    return neighbours.withColumn("place", place).filter("place = 1").select("node", "nbr", "weight")
