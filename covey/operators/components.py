"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored


class Forest:
    """Union-find over the few nodes of one task; keeps the smallest node of a tree as its root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while x != top:
            self.parent[x], x = top, self.parent.get(x, top)
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.parent.setdefault(a, a)
        self.parent[b] = a
        return True

    def stars(self) -> list[tuple[int, int]]:
        """``node, root`` of every node that isn't a root."""
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``edges(a, b)`` with ``a > b``.

    Only minima are aggregated and joined, so a node of any degree is spread over
    tasks: the minimum combines before the shuffle and a skewed join is split.
    """
    if small:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        return edges.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(edges.groupBy("a").agg(F.min("b").alias("b"))).filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)`` but the components' smallest ones, which name them."""
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    known, before = stored(ends), None
    while True:
        now = known.agg(sign.alias("s")).first().s
        if now == before or not now[0]:
            return known.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, last, known = now, known, stored(_stars(_stars(known, small=False), small=True))
        forget(last)
