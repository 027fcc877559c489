"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then assigned to a leaf.
A query walks the tree best bin first: a priority queue holds the branches seen
but not taken, by the inner product with their centres plus what the branch's
radius can add, and the leaves come out in the order they should be visited.
How many leaves to visit is calibrated: for a sample of queries the true
neighbours are found by brute force, and the number of leaves is widened until
the share found reaches the target.

Vectors of different lengths are handled as they are: the order of leaves only
decides where to look, and scores are exact inner products in double precision.

Equal vectors are one point in the search.  Of each only the ``k + 1`` rows with the
smallest ids can be among anyone's ``k`` nearest, one of them being the query's own
row, so these are carried along and the rest need no comparison.

Neighbouring leaves make shards of bounded size (a larger leaf makes several), so
a query travels once to each shard that has leaves for it.  A task holds the
points of one shard and streams the queries past them.

Vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, neither do null ids.  Repeated rows of an id
are candidates of their own and queries of their own: a query leaves out one row
with its id and vector, its own, and no other.  With fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Distinct vectors that the tree is fitted on, at most about.
SAMPLE = 20_000
#: Children of a node, and sampled vectors in a leaf.
BRANCHES, LEAF_SAMPLE = 8, 32
#: Queries that the number of leaves is calibrated on, and the share of true neighbours to find.
CALIBRATION, RECALL = 200, 0.95
#: Points of a shard, about; and queries for which a shard is copied once more.
SHARD_POINTS, SHARD_QUERIES = 10_000, 1_000_000


class Tree:
    """Nodes in arrays: a centre and radius each, and the children or the leaf number."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, np.random.default_rng(seed))
        self.centres = np.array(self.centre)

    def _grow(self, own: np.ndarray, rng: np.random.Generator) -> int:
        node = len(self.centre)
        centre = own.mean(0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((own - centre) ** 2).sum(1).mean())))
        self.children.append([])
        self.leaf.append(-1)
        part = self._kmeans(own, rng) if len(own) > LEAF_SAMPLE else np.zeros(len(own), np.int64)
        if part.max(initial=0) == 0:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(own[part == i], rng) for i in np.unique(part).tolist()]
        return node

    @staticmethod
    def _kmeans(own: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        centres = own[rng.choice(len(own), min(BRANCHES, len(own)), replace=False)]
        part = np.zeros(len(own), np.int64)
        for _ in range(8):
            part = (own @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            for i in range(len(centres)):
                if (part == i).any():
                    centres[i] = own[part == i].mean(0)
        return part

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            own = np.array(self.children[node])
            centres = self.centres[own]
            part = (x[rows] @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            todo += [(int(own[i]), rows[part == i]) for i in range(len(own)) if (part == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int | None = None) -> list[int]:
        """Leaves in best-bin-first order, the first ``most`` of them."""
        reach = self.centres @ query + np.array(self.radius) * np.linalg.norm(query) / np.sqrt(len(query))
        reach = reach.tolist()
        queue, out = [(-reach[0], 0)], []
        while queue and (most is None or len(out) < most):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-reach[child], child))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _assign(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("vector"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], [*batch.schema.names, "leaf"])

    return run


def _visits(tree: Tree, shards: np.ndarray, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to, leaves = [], [], []
            for i, x in enumerate(_matrix(batch.column("vector"), width)):
                visits = np.sort(np.array(tree.visits(x, most)))
                first, last = shards[visits, 0], shards[visits, 1]
                for shard in range(int(first[0]), int(last[-1]) + 1) if len(visits) else ():
                    own = visits[(first <= shard) & (shard <= last)]
                    if len(own):
                        rows.append(i)
                        to.append(shard)
                        leaves.append(own.tolist())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(to, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], [*kept.schema.names, "shard", "leaves"])

    return run


def _nearest(query: np.ndarray, points: np.ndarray, ids: list[list[int]], at: np.ndarray, own: int, k: int) -> list[tuple[int, float, int]]:
    """The ``k`` nearest rows among the points ``at``, by score, then id, with their points; all points that tie with the last one count.

    Of the query's id and vector one row is its own and left out; more such rows are rows like others.
    """
    rough = points[at] @ query
    most = min(len(at), k + 1)  # one point may be the query's own
    floor = np.partition(rough, len(at) - most)[len(at) - most]
    close = at[rough >= floor - 1e-9 * (1 + abs(floor))]
    exact = np.zeros(len(close))
    for j in range(len(query)):  # in one order wherever the point lies, so equal pairs get equal scores
        exact += points[close, j] * query[j]
    found = []
    for i, s in zip(close.tolist(), exact.tolist(), strict=True):
        rows = [(-s, x, i) for x in ids[i]]
        if own in ids[i] and np.array_equal(points[i], query):
            rows.remove((-s, own, i))
        found += rows
    return [(x, -s, i) for s, x, i in heapq.nsmallest(k, found)]


_KINDS = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}


def _search(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, points, ids, order = None, [], None, [], {}
        for batch in batches:
            rows = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "copy", "query")), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                part = batch.slice(at, to - at)
                if keys[at][:2] != shard:
                    shard, held, points = keys[at][:2], [], None
                if not keys[at][2]:
                    held.append(part.select(["vector", "ids", "leaf"]))
                elif held:
                    if points is None:
                        table = pa.Table.from_batches(held)
                        points, ids, leaf = _matrix(table["vector"], width), table["ids"].to_pylist(), table["leaf"].to_numpy()
                        by_leaf = np.argsort(leaf, kind="stable")
                        starts = np.flatnonzero(np.diff(leaf[by_leaf], prepend=-1))
                        order = {int(leaf[by_leaf[a]]): by_leaf[a:b] for a, b in zip(starts, [*starts[1:], len(leaf)], strict=True)}
                    for x, number, name, leaves in zip(_matrix(part.column("vector"), width), *(part.column(c).to_pylist() for c in ("query_row", "query_id", "leaves")), strict=True):
                        inside = [order[n] for n in leaves if n in order]
                        if inside:
                            rows += [(number, name, y, s) for y, s, _ in _nearest(x, points, ids, np.concatenate(inside), name, k)]
                at = to
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _KINDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))

    return run


def _brute(queries: list[tuple[int, np.ndarray]], width: int, k: int):
    """Per batch, the nearest points of a fixed set of queries with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, ids, leaf = _matrix(batch.column("vector"), width), batch.column("ids").to_pylist(), batch.column("leaf").to_pylist()
            at = np.arange(len(points))
            rows = [(own, x, s, leaf[i]) for own, q in queries for x, s, i in _nearest(q, points, ids, at, own, k)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["query_id", "vec_id", "score", "leaf"])

    return run


def shard_ranges(sizes: np.ndarray) -> np.ndarray:
    """First and last shard of each leaf, for the points in each; neighbouring small leaves share one."""
    out, shard, held = np.zeros((len(sizes), 2), np.int64), 0, 0
    for leaf, n in enumerate(sizes.tolist()):
        if held and held + n > SHARD_POINTS:
            shard, held = shard + 1, 0
        blocks = max(1, -(-n // SHARD_POINTS))
        out[leaf] = shard, shard + blocks - 1
        shard, held = (shard, held + n) if blocks == 1 else (shard + blocks, 0)
    return out


def calibrate(tree: Tree, points: DataFrame, queries: DataFrame, width: int, k: int, recall: float) -> int:
    """The least number of leaves with which a sample of queries finds ``recall`` of its true neighbours."""
    sample = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION).toArrow()
    chosen = list(dict(zip(sample["query_id"].to_pylist(), _matrix(sample["vector"], width), strict=True)).items())
    if not chosen:
        return tree.leaves
    near = points.select("ids", "vector", "leaf").mapInArrow(_brute(chosen, width, k), "query_id long, vec_id long, score double, leaf int")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    truth = near.groupBy("query_id", "leaf").count().collect()  # k rows a query at most
    order = {q: {leaf: i for i, leaf in enumerate(tree.visits(x))} for q, x in chosen}
    found = np.zeros(tree.leaves)
    for q, leaf, n in truth:
        found[order[q][leaf]] += n
    share = np.cumsum(found) / max(1, found.sum())
    return int(np.searchsorted(share, recall)) + 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``vectors(vec_id, embedding)`` for each row of ``queries`` with the same columns."""

    def sound(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return own.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))

    known, asked = sound(vectors), sound(queries)
    shape = known.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = shape.width if shape else 1
    known, asked = (df.filter(F.size("vector") == width).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))) for df in (known, asked))
    own = W.partitionBy(F.xxhash64("vector"), "vector").orderBy("vec_id")
    firsts = known.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k + 1)
    distinct = stored(firsts.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    count = distinct.count()
    share = min(1.0, SAMPLE / max(1, count))
    sample = distinct.filter(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < share * 1_000_000).select("vector").toArrow()
    if not sample.num_rows:
        sample = distinct.select("vector").limit(SAMPLE).toArrow()
    tree = Tree(_matrix(sample["vector"], width) if sample.num_rows else np.zeros((1, width)))
    spark = vectors.sparkSession
    points = stored(distinct.select("vector", "ids").mapInArrow(_assign(tree, width), "vector array<double>, ids array<long>, leaf int"))
    asked = asked.select(F.monotonically_increasing_id().alias("query_row"), F.col("vec_id").alias("query_id"), "vector")
    most = calibrate(tree, points, asked, width, k, recall)
    # The tree has no more leaves than its sample has vectors.
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, n in points.groupBy("leaf").count().collect():
        sizes[leaf] = n
    shards = shard_ranges(sizes)
    copies = max(1, -(-asked.count() // SHARD_QUERIES))
    table = F.broadcast(spark.createDataFrame([(i, int(a), int(b - a + 1)) for i, (a, b) in enumerate(shards)], "leaf int, first int, blocks int"))
    placed = points.join(table, "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("vector"), F.col("blocks"))).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(False).alias("query"), "vector", "ids", "leaf"
    )
    visits = asked.mapInArrow(_visits(tree, shards, width, most), "query_row long, query_id long, vector array<double>, shard int, leaves array<int>")
    visits = visits.withColumn("copy", F.pmod(F.xxhash64("query_row"), F.lit(copies)).cast("int")).withColumn("query", F.lit(True))
    both = placed.unionByName(visits, allowMissingColumns=True).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "query")
    found = both.mapInArrow(_search(width, k), "query_row long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product for every twentieth vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.filter("vec_id % 20 = 0"))

