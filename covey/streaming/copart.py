"""An extension: edge weights of a co-membership network kept up from a stream of baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basket_edges(baskets: DataFrame) -> DataFrame:
    """``ts, src, dst`` of every pair in ``baskets(ts, members)``; a basket is one small array."""
    pairs = F.flatten(F.transform("members", lambda a: F.transform(F.filter("members", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return baskets.select("ts", F.explode(pairs).alias("e")).select("ts", "e.src", "e.dst")


def windowed_weights(baskets: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``window, src, dst, weight``: how often each pair occurs in each window, for rows that are at most ``late``."""
    edges = basket_edges(baskets.withWatermark("ts", late))
    return edges.groupBy(F.window("ts", window), "src", "dst").agg(F.count("*").alias("weight"))
