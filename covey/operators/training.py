"""Training data: splits, sizes of negatives, random walks, and rows to leave out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored
from .components import components
from .ranges import percentile, running_sums


#: A component of communities with at least this share of them all is placed by itself; there are few of these.
LARGE = 0.01
#: Cells in which sums of large components are told apart.
CELLS = 10_000


def _chosen(sizes: list[int], wanted: float, small: int) -> list[bool]:
    """Which large components go to the first side, so that it can reach ``wanted`` with some of the ``small`` rest."""
    total = max(1, sum(sizes) + small)
    cells = [max(1, round(s * CELLS / total)) for s in sizes]
    reached = [1]  # bit i: some of the first components fill i cells
    for c in cells:
        reached.append(reached[-1] | reached[-1] << c)
    low, high = round((wanted - small) * CELLS / total), round(wanted * CELLS / total)
    best = min((i for i in range(reached[-1].bit_length()) if reached[-1] >> i & 1), key=lambda i: (max(low - i, i - high, 0), abs(i - (low + high) / 2)))
    taken = []
    for c, before in zip(reversed(cells), reversed(reached[:-1]), strict=True):
        taken.append(not before >> best & 1)
        best -= c if taken[-1] else 0
    return taken[::-1]


def independent_split(induced: DataFrame, membership: DataFrame, share: float = 0.7, seed: int = 0) -> DataFrame:
    """``cid, train``: communities that share an edge, also over others, fall on one side, and ``share`` of all fall on the first.

    The components of edge sharing are whole.  Those with 1 % of all communities
    or more, a hundred at most, are placed first; the others follow in a hash order
    until the share is reached, so it is met to 1 % wherever the large ones allow it.
    """
    own = F.xxhash64(F.lit("c"), "cid")
    # Only edges of several communities link any: each of these to the first one.  A part has the smallest number of its communities and of their edges.
    several = induced.groupBy("src", "dst").agg(F.min("cid").alias("first"), F.count("*").alias("n")).filter("n > 1").select("src", "dst", "first")
    links = induced.join(several, ["src", "dst"]).filter("cid <> first").select(own.alias("a"), F.xxhash64(F.lit("c"), "first").alias("b"))
    least = induced.groupBy("cid").agg(F.min(F.xxhash64(F.lit("e"), "src", "dst")).alias("e"))
    ids = membership.select("cid").distinct().join(least, "cid", "left").select("cid", own.alias("c"), F.least(own, "e").alias("least"))
    named = stored(ids.join(components(links), F.col("c") == F.col("node"), "left").select("cid", "least", F.coalesce("component", "c").alias("component")))
    parts = named.groupBy("component").agg(F.min("least").alias("part"))
    named = stored(named.join(parts, "component").select("cid", "part"))
    sizes_ = stored(named.groupBy("part").agg(F.count("*").alias("n")))
    total = sizes_.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") >= max(1.0, LARGE * total)
    top = sizes_.filter(large).orderBy(F.desc("n"), "part").collect() if total >= 1 / LARGE else []
    rest = sizes_.filter(~large) if top or total >= 1 / LARGE else sizes_
    small = total - sum(r.n for r in top)
    taken = _chosen([r.n for r in top], share * total, small)
    room = share * total - sum(r.n for r, t in zip(top, taken, strict=True) if t)
    dealt = running_sums(rest.withColumn("h", F.xxhash64("part", F.lit(seed))), [F.col("h"), F.col("part")], {"upto": F.col("n")})
    sides = dealt.select("part", (F.col("upto") - F.col("n") / 2 <= room).alias("train"))
    placed = membership.sparkSession.createDataFrame([(r.part, t) for r, t in zip(top, taken, strict=True)], "part long, train boolean")
    return named.join(sides.unionByName(placed), "part").select("cid", "train")


def uniform_sizes(positive: DataFrame, scale: float) -> DataFrame:
    """``size, n``: as many negatives of every size from the smallest to the largest of ``positive(size)``."""
    span = positive.agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n_pos"))
    each = F.ceil(F.ceil(F.col("n_pos") / (F.col("high") - F.col("low") + 1)) * F.lit(scale))
    return span.filter("n_pos > 0").select(F.explode(F.sequence("low", "high")).alias("size"), each.cast("long").alias("n"))


def same_sizes(positive: DataFrame, scale: float) -> DataFrame:
    """``size, n``: each size's number of positives times ``scale``, rounded up."""
    return positive.groupBy("size").agg(F.ceil(F.count("*") * F.lit(scale)).cast("long").alias("n"))


def iqr_max_size(sizes: DataFrame, most: int | None = None) -> DataFrame:
    """One row: the smaller of the largest size and ``ceil(q3 + 4.5 (q3 - q1))``, and of ``most``."""
    q = percentile(sizes, "size", [0.25, 0.75]).crossJoin(F.broadcast(sizes.agg(F.max("size").alias("largest"))))  # of one row each
    fence = F.ceil(F.col("p1") + 4.5 * (F.col("p1") - F.col("p0"))).cast("long")
    return q.select(F.least(fence, F.col("largest").cast("long"), *([F.lit(most).cast("long")] if most else [])).alias("max_size"))


def drop_equal_rows(rows: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that equal no row of ``others`` in all ``columns``."""
    return rows.join(others.select(*columns).distinct(), columns, "left_anti")


#: Steps that walks take between two stored tables.
STEPS = 6
#: Neighbours in a list; a node of more has several, and its walkers look up its degree first.
LIST = 512


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """``at, block, nbrs, weights``: the neighbours of each node in order, ``LIST`` at most in a row.

    Sorted rows are cut where a list begins; a task holds a batch and one open list.
    """
    kind, length = dict(neighbours.dtypes)["node"], LIST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, 0  # rows of the open list, which is this one of its node
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            node = rows["node"].chunk(0)
            first = np.concatenate([[0], np.flatnonzero(pc.not_equal(node[1:], node[:-1]).to_numpy(zero_copy_only=False)) + 1])
            place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
            starts = np.flatnonzero(place % length == 0)
            blocks = place[starts] // length + np.where(starts < (first[1] if len(first) > 1 else len(node)), block, 0)
            yield lists(rows, starts, blocks[:-1])
            held, block = rows.slice(starts[-1]).combine_chunks().to_batches()[0], int(blocks[-1])
        if held is not None:
            yield lists(pa.Table.from_batches([held]), np.array([0, held.num_rows]), np.array([block]))

    def lists(rows: pa.Table, bounds: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
        columns = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows[c].chunk(0).slice(0, bounds[-1])) for c in ("nbr", "weight")]
        return pa.RecordBatch.from_arrays([rows["node"].chunk(0).take(pa.array(bounds[:-1])), pa.array(blocks, pa.int32()), *columns], ["at", "block", "nbrs", "weights"])

    rows = neighbours.select("node", "nbr", F.col("weight").cast("double").alias("weight")).repartition("node").sortWithinPartitions("node", "nbr")
    return rows.mapInArrow(run, f"at {kind}, block int, nbrs array<{kind}>, weights array<double>")


def random_walks(neighbours: DataFrame, plan: DataFrame, seed: int = 0, retries: int = 10) -> DataFrame:
    """``gid, src, dst, weight``: walked edges of negatives; ``plan(size, n)`` says how many of each size.

    All walks take a step together: a walker draws a place among the neighbours of
    its node by a hash of walker, try and step, which is uniform and the same on
    every run, and meets the list that holds this place, so a step is one row a
    walker and a node is one row of a list for each ``LIST`` neighbours.  A walk
    ends with ``size`` nodes or after ``size + 10`` steps.  A walk that
    ends short starts anew beside those that go on, at most ``retries`` times; then
    its last try is kept.
    """
    kind = dict(neighbours.dtypes)["node"]
    around = stored(neighbour_lists(neighbours))
    nodes = around.filter("block = 0").select(F.col("at").alias("node"))
    any_hubs = not around.filter("block = 1").isEmpty()
    hubs = stored(around.groupBy("at").agg(F.sum(F.size("nbrs")).alias("hub"), F.max("block").alias("last")).filter("last > 0").drop("last")) if any_hubs else None
    # Starting nodes by rank in a hash order, without a global sort: both sides are dealt into ranges of the hash space.
    buckets = max(1, nodes.count() // 50)
    dealt = nodes.withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(buckets)))
    span = stored(dealt.groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes")))
    empty = F.expr(f"cast(array() as array<struct<src: {kind}, dst: {kind}, weight: double>>)")

    def begun(walks: DataFrame) -> DataFrame:
        h = F.xxhash64("gid", "try", F.lit(seed))
        first = walks.withColumn("bucket", F.pmod(h, F.lit(buckets))).join(span, "bucket").withColumn("first", F.element_at("nodes", (F.pmod(F.shiftrightunsigned(h, 20), F.size("nodes")) + 1).cast("int")))
        return first.select("gid", "size", "try", F.lit(0).alias("step"), F.col("first").alias("at"), F.array("first").alias("seen"), empty.alias("edges"))

    goes = (F.size("seen") < F.col("size")) & (F.col("step") < F.col("size") + 10)
    drawn = F.xxhash64("gid", "try", "step", F.lit(seed))

    def moved(state: DataFrame) -> DataFrame:
        # Walkers that stay have no block and meet no list.
        if any_hubs:
            state = state.join(hubs, "at", "left").withColumn("block", F.when(goes, F.coalesce(F.floor(F.pmod(drawn, F.col("hub")) / LIST).cast("int"), F.lit(0))))
        else:
            state = state.withColumns({"block": F.when(goes, F.lit(0)), "hub": F.lit(None).cast("long")})
        met = state.join(around, ["at", "block"], "left")
        place = F.pmod(drawn, F.coalesce("hub", F.size("nbrs").cast("long"))) - F.col("block") * LIST
        then = met.withColumn("place", (place + 1).cast("int")).withColumns({"nbr": F.element_at("nbrs", F.col("place")), "weight": F.element_at("weights", F.col("place"))})
        stays = F.col("nbr").isNull()
        edge = F.struct(F.least("at", "nbr").alias("src"), F.greatest("at", "nbr").alias("dst"), "weight")
        return then.select(
            "gid",
            "size",
            "try",
            (F.col("step") + F.when(stays, 0).otherwise(1)).alias("step"),
            F.coalesce("nbr", "at").alias("at"),
            F.when(stays, F.col("seen")).otherwise(F.array_union("seen", F.array("nbr"))).alias("seen"),
            F.when(stays, F.col("edges")).otherwise(F.array_union("edges", F.array(edge))).alias("edges"),
        )

    walks = plan.select(F.col("size").cast("int").alias("size"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("i"))
    state = begun(walks.select(F.xxhash64("size", "i", F.lit(seed)).alias("gid"), "size", F.lit(0).alias("try")))
    short = (F.size("seen") < F.col("size")) & (F.col("try") < retries)
    done, tables = [], []
    while True:
        for _ in range(STEPS):
            state = moved(state)
        state = stored(state)
        tables.append(state)
        done.append(state.filter(~goes & ~short).select("gid", "seen", "edges"))
        if state.filter(goes | short).isEmpty():
            break
        again = state.filter(~goes & short).select("gid", "size", (F.col("try") + 1).alias("try"))
        state = state.filter(goes).unionByName(begun(again))
    ended = stored(reduce(DataFrame.unionByName, done).filter(F.size("seen") >= 3).select("gid", F.explode("edges").alias("e")).select("gid", "e.*"))
    forget(around, span, hubs, *tables)
    return ended


def seeds(edges_nodes: DataFrame, mode: str, k: int | None = None, known: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``node``: all nodes, ``k`` random ones, or those of known communities."""
    if mode == "all_nodes":
        return edges_nodes.select("node").distinct()
    if mode == "n_nodes":
        return edges_nodes.select("node").distinct().orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k or 1)
    if mode == "all_nodes_known_comp":
        return edges_nodes.select("node").distinct().join(known.select("node").distinct(), "node", "left_semi")
    raise ValueError(f"no seed mode {mode}; the cliques of covey.operators.search.maximal_cliques go to grow as they are")


def deal(seeds_: DataFrame, parts: int) -> DataFrame:
    """``node, part``: seeds in ``parts`` shares of about one size."""
    return seeds_.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Adds ``fold``: the rows of each label dealt in turn, in the order of a hash."""
    return rows.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(key))), F.lit(folds)))
