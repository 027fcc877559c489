"""Ranks and running sums over whole tables, range by range, so that no task sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over all rows up to and with each one, in ``order``, which has to be total.

    The ranges are written once, so their bounds, which Spark samples, are the
    same for the sums within ranges and for those of whole ranges.
    """
    kept = df.withColumns({f"_{name}": value for name, value in sums.items()})
    parts = stored(kept.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(*(F.sum(f"_{name}").alias(f"_{name}") for name in sums))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}_0") for name in sums))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = parts.withColumns({name: F.sum(f"_{name}").over(within) for name in sums}).join(F.broadcast(offsets), "_part")
    return out.withColumns({name: F.col(name) + F.col(f"_{name}_0") for name in sums}).drop("_part", *(f"_{name}" for name in sums), *(f"_{name}_0" for name in sums))


def percentile(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row, ``p0, p1, ...``: the interpolated percentiles of a column at ``shares``; nulls don't count.

    Values are counted first, and only the counts, which are stored, are ranked.
    """
    counts = stored(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    ranked = running_sums(counts, [F.col("v")], {"upto": F.col("n")})
    ranked = ranked.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # of one row
    first, last = F.col("upto") - F.col("n"), F.col("upto") - 1  # places from 0

    def at(place: Column) -> Column:
        return F.max(F.when((place >= first) & (place <= last), F.col("v")))

    ends = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("total") - 1)
        ends += [at(F.floor(place)).alias(f"low{i}"), at(F.ceil(place)).alias(f"high{i}"), F.max(place - F.floor(place)).alias(f"part{i}")]
    row = ranked.agg(*ends)
    return row.select(*((F.col(f"low{i}") * (1 - F.col(f"part{i}")) + F.col(f"high{i}") * F.col(f"part{i}")).alias(f"p{i}") for i in range(len(shares))))
