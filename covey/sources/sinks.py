"""Writers of networks, communities and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, metrics, reporting
from .scratch import forget, stored
from .text import FEATURES


def write_adjacency(adjacency: DataFrame, path: str, buckets: int = 64) -> None:
    """Neighbours of each node, in folders by a hash of the node."""
    adjacency.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_communities(communities: DataFrame, path: str, sep: str = " ") -> None:
    """One community a line."""
    communities.select(F.concat_ws(sep, F.col("members").cast("array<string>"))).write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Members and the score with three decimals, best first."""
    ranked = predictions.orderBy(F.desc("score"), F.array_join(F.col("members").cast("array<string>"), " "))
    ranked.select(F.concat_ws(" ", F.col("members").cast("array<string>"), F.format_string("%.3f", "score"))).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """``a``, ``b`` and, where there is one, a score, tab-separated."""
    columns = [F.col(c).cast("string") for c in edges.columns]
    edges.select(F.concat_ws("\t", *columns)).write.mode("overwrite").text(path)


def write_edge_blocks(induced: DataFrame, path: str) -> None:
    """``src dst weight`` lines of each community, and an empty line after it; communities in the order of their ids.

    Lines are sorted, not gathered, so a community may have any number of edges.
    """
    ends = induced.select("cid").distinct().select("cid", F.lit(1).alias("last"), F.lit(None).alias("src"), F.lit(None).alias("dst"), F.lit("").alias("value"))
    lines = induced.select("cid", F.lit(0).alias("last"), "src", "dst", F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value"))
    # A range holds whole communities, as they are cut by the id alone.
    lines.unionByName(ends).repartitionByRange("cid").sortWithinPartitions("cid", "last", "src", "dst").select("value").write.mode("overwrite").text(path)


def write_known(membership: DataFrame, induced: DataFrame, folder: str, stem: str = "res") -> None:
    """Known communities, their edge blocks and their distinct edges, in three places of ``folder``."""
    write_communities(membership.groupBy("cid").agg(F.array_sort(F.collect_list("node")).alias("members")), f"{folder}/{stem}_known.out")
    write_edge_blocks(induced, f"{folder}/{stem}_known_edges.out")
    write_edges(induced.select("src", "dst").distinct(), f"{folder}/{stem}_tot_known_edges_unique.out")


def write_found(found: DataFrame, edges: DataFrame, train: DataFrame, test: DataFrame, folder: str, stem: str = "res") -> None:
    """All outputs of a search below ``folder``, of ``found(members, score)``.

    The ranked predictions, their edge blocks, each edge's largest score, and of
    these edges those between nodes of ``train(node)`` or ``test(node)``, of the
    one and of the other.
    """
    named = stored(found.select(F.xxhash64("members", "score").alias("cid"), "members", "score"))
    induced = stored(graph.induced_edges(edges, named.select("cid", F.explode("members").alias("node"))))
    write_predictions(named, f"{folder}/{stem}_pred.out")
    write_edge_blocks(induced, f"{folder}/{stem}_pred_edges.out")
    best = stored(metrics.edge_max_scores(induced, named.select("cid", "score")))
    text = lambda rows: rows.select("src", "dst", F.format_string("%.3f", "score").alias("score"))
    every = f"{folder}/{stem}_tot_pred_edges_unique_max_comp_prob"
    write_edges(text(best), f"{every}.out")
    marked = best.join(reporting.in_known(best.select("src", "dst"), train, test), ["src", "dst"])
    for column, name in (("in_known", "inKnown"), ("in_train", "inKnown_train"), ("in_test", "inKnown_test")):
        write_edges(text(marked.filter(column)), f"{every}_{name}.out")
    forget(named, induced, best)


def write_best_matches(matches: DataFrame, path: str) -> None:
    """``known ||| predicted ||| F1 ||| score`` of ``matches(known, predicted, f1, score)``, the best first, below a line that names them."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    value = F.concat_ws(" ||| ", joined("known"), joined("predicted"), F.format_string("%.3f", "f1"), F.format_string("%.3f", "score"))
    rows = matches.orderBy(F.desc("f1"), joined("known"), joined("predicted")).select(value.alias("Known nodes ||| Predicted nodes ||| F1 ||| Score"))
    rows.write.mode("overwrite").option("quote", "").csv(path, header=True, sep="\t")


def write_features(features: DataFrame, path: str) -> None:
    """The feature CSV with its header."""
    features.select(*FEATURES, F.col("label").alias("complex")).write.mode("overwrite").csv(path, header=True)


def write_table(table: DataFrame, path: str) -> None:
    """Any result as CSV with a header."""
    table.write.mode("overwrite").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``name = value`` lines of ``metric, value``."""
    metrics.select(F.concat_ws(" = ", "metric", F.col("value").cast("string"))).write.mode("overwrite").text(path)
