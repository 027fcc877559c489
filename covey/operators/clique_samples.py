"""Clique comparison on samples of subsets: its work does not depend on how many subsets there are.

For each size ``k`` a fixed number of ``k``-subsets is drawn, a community with the
chance of its share of all subsets.  Draws are evenly spaced points on the running
sum of these shares, so a community knows from its own interval how many points
fall to it, and no table of intervals is searched.  A subset of a community are the
``k`` members with the smallest hashes of member and draw.  Each drawn subset counts
once.  All draws are hashes: results repeat under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sets
from ..sources.scratch import stored
from .metrics import known_only, weighted_clique_precision_recall
from .overlap import sizes
from .ranges import running_sums

#: Shares of subsets are whole numbers of this many, so that their sums are exact.
SHARES = 1 << 40


def _log_subsets(n: str, k: str) -> Column:
    """The logarithm of the number of ``k``-subsets of ``n``."""
    return F.expr(f"aggregate(sequence(1, cast({k} as int)), 0D, (a, i) -> a + ln(({n} - {k} + i) / i))")


def clique_samples(membership: DataFrame, key: str, most: int, samples: int = 10_000, seed: int = 0) -> DataFrame:
    """``k, subset, weight``: distinct sampled subsets of each size from 2 to ``most``; ``weight`` is ``n`` over the number of subsets of a community of ``n``.

    A subset drawn from communities of several sizes has the smallest of their weights.
    """
    members = membership.groupBy(key).agg(F.array_sort(F.collect_set("node")).alias("members")).withColumn("n", F.size("members")).filter("n >= 2")
    each = members.select(F.xxhash64(key).alias("id"), "n", F.explode(F.expr(f"filter(sequence(1, greatest(1, least(n, {most}))), k -> k > 1)")).alias("k"))
    each = stored(each.withColumn("ln", _log_subsets("n", "k")))
    whole = each.groupBy("k").agg(F.max("ln").alias("top"))
    whole = each.join(F.broadcast(whole), "k").groupBy("k").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("ln") - F.col("top"))).alias("total"))  # a row for each size
    shared = each.join(F.broadcast(whole), "k").withColumn("share", F.floor(F.exp(F.col("ln") - F.col("top")) / F.col("total") * SHARES).cast("long"))
    upto = running_sums(shared.filter("share > 0").select("k", "id", "share"), [F.col("k"), F.col("id")], {"upto": F.col("share")})
    # Points lie at (i + r) SHARES / samples; the number below x is ceil(x samples / SHARES - r).
    r = (seed * 0.6180339887498949 + 0.5) % 1
    below = lambda x: F.ceil(x * samples / SHARES - r)
    drawn = upto.select("k", "id", below(F.col("upto") - F.col("share")).alias("low"), below(F.col("upto")).alias("high")).filter("high > low")
    drawn = drawn.withColumn("draw", F.explode(F.expr("sequence(low, high - 1)"))).join(members.withColumn("id", F.xxhash64(key)), "id")
    ranked = F.expr(f"transform(array_sort(transform(members, m -> struct(xxhash64(m, k, draw, {seed}L) as h, m as m))), x -> x.m)")
    subset = F.array_sort(F.slice(ranked, F.lit(1), F.col("k")))
    weight = F.exp(F.log("n") - _log_subsets("n", "k"))
    return drawn.select("k", subset.alias("subset"), weight.alias("weight")).groupBy("k", "subset").agg(F.min("weight").alias("weight"))


def held_by_any(samples: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """``k, subset, weight, held``: whether a community holds all of a subset; only the communities of its rarest member are looked at."""
    degree = membership.groupBy("node").agg(F.count("*").alias("degree"))
    ends = samples.select("k", "subset", F.explode("subset").alias("node")).join(degree, "node", "left")
    rarest = ends.groupBy("k", "subset").agg(F.min(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node")).alias("at"))
    lists = membership.groupBy(key).agg(F.collect_set("node").alias("members"))
    near = rarest.filter("at.degree > 0").select("k", "subset", F.col("at.node").alias("node")).join(membership, "node").join(lists, key)
    found = near.filter(F.size(F.array_except("subset", "members")) == 0).select("k", "subset").distinct().withColumn("held", F.lit(True))
    return samples.join(found, ["k", "subset"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def sampled_clique_curve(
    known: DataFrame, predicted: DataFrame, samples: int = 10_000, max_clique: int | None = None, weighted: bool = True, seed: int = 0, pseudocount: float = 1e-5, excluded: DataFrame | None = None
) -> DataFrame:
    """``k, tp, fp, known_tp, fn, precision, recall, f1, cumulative_precision, cumulative_recall, n_communities`` for sizes from 2 on.

    ``known(kid, node)``, ``predicted(pid, node)``.  Predictions are cut to members
    of known communities, and sizes go up to the largest of what is left, or to
    ``max_clique``.  A subset of a prediction is right if a known community holds
    it, one inside a community of ``excluded(kid, node)`` is left out; recall asks
    the same of subsets of known communities.  A subset counts its weight, or 1.
    Beyond the largest known community all is 0 but for the pseudocount.
    """
    known, predicted = stored(known.select("kid", "node").distinct()), stored(known_only(predicted.select("pid", "node").distinct(), known, 1))
    n = stored(sizes(predicted, "pid", "n"))
    largest, known_largest = (df.agg(F.max("n")).first()[0] or 0 for df in (n, sizes(known, "kid", "n")))
    last = min(largest, max_clique or largest)
    top = min(last, known_largest)
    right = held_by_any(clique_samples(predicted, "pid", top, samples, seed), known, "kid")
    if excluded is not None:
        out = held_by_any(right.filter(~F.col("held")).select("k", "subset", "weight"), excluded, "kid").filter("held").select("k", "subset")
        right = right.join(out, ["k", "subset"], "left_anti")
    there = held_by_any(clique_samples(known, "kid", top, samples, seed), predicted, "pid")
    value = F.col("weight") if weighted else F.lit(1.0)
    part = lambda held: F.coalesce(F.sum(F.when(F.col("held") == held, value)), F.lit(0.0)) + pseudocount
    side = lambda rows, hit, miss: rows.groupBy("k").agg(part(True).alias(hit), part(False).alias(miss))
    counts = n.filter("n >= 2").select(F.explode(F.expr(f"sequence(2, cast(least(n, {top}) as int))")).alias("k")).groupBy("k").agg(F.count("*").alias("n_communities")) if top >= 2 else None
    spark = known.sparkSession
    sizes_ = spark.range(2, last + 1).select(F.col("id").cast("int").alias("k"))
    curve = sizes_.join(side(right, "tp", "fp"), "k", "left").join(side(there, "known_tp", "fn"), "k", "left")
    curve = curve.join(counts, "k", "left") if counts is not None else curve.withColumn("n_communities", F.lit(None).cast("long"))
    return _finished(curve, top, samples, pseudocount)


def exact_clique_curve(known: DataFrame, predicted: DataFrame, max_clique: int | None = None, pseudocount: float = 1e-5) -> DataFrame:
    """The same columns from all weighted subsets, for communities small enough to list them."""
    known = stored(known.select("kid", "node").distinct())
    own = stored(known_only(predicted.select("pid", "node").distinct(), known, 1))
    n = stored(sizes(own, "pid", "n"))
    largest, known_largest = (df.agg(F.max("n")).first()[0] or 0 for df in (n, sizes(known, "kid", "n")))
    last = min(largest, max_clique or largest)
    top = min(last, known_largest)
    curve = known.sparkSession.range(2, last + 1).select(F.col("id").cast("int").alias("k"))
    rows = None
    for k in range(2, top + 1):
        row = weighted_clique_precision_recall(known, own, k, pseudocount).select(F.lit(k).alias("k"), "tp", "fp", "known_tp", "fn")
        rows = row if rows is None else rows.unionByName(row)
    if rows is None:
        rows = known.sparkSession.createDataFrame([], "k int, tp double, fp double, known_tp double, fn double")
    counts = n.select(F.explode(F.expr(f"sequence(1, cast(least(n, {top}) as int))")).alias("k")).groupBy("k").agg(F.count("*").alias("n_communities"))
    return _finished(curve.join(rows, "k", "left").join(counts, "k", "left"), top, 10_000, pseudocount)


def _finished(curve: DataFrame, top: int, samples: int, pseudocount: float) -> DataFrame:
    """Ratios, and running ones over the sizes, of which there are few."""
    nothing = F.lit(pseudocount / (samples + 2 * pseudocount))
    counted = F.col("k") <= top
    upto = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    over = lambda a, b: F.when(counted, F.col(a) / (F.col(a) + F.col(b))).otherwise(nothing)
    running = lambda a, b: F.when(counted, F.sum(a).over(upto) / (F.sum(a).over(upto) + F.sum(b).over(upto))).otherwise(nothing)
    out = curve.select(
        *(c if c == "k" else F.when(counted, F.col(c)).otherwise(0.0).alias(c) for c in ("k", "tp", "fp", "known_tp", "fn")),
        over("tp", "fp").alias("precision"),
        over("known_tp", "fn").alias("recall"),
        running("tp", "fp").alias("cumulative_precision"),
        running("known_tp", "fn").alias("cumulative_recall"),
        F.when(counted, F.coalesce("n_communities", F.lit(0))).otherwise(0).cast("long").alias("n_communities"),
    )
    return out.withColumn("f1", F.when(counted, sets.harmonic_mean(F.col("precision"), F.col("recall"))).otherwise(nothing))
