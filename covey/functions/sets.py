"""Set measures as column expressions over sizes or over arrays of distinct members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    """``a / b`` in double precision; ``otherwise`` where ``b`` is zero."""
    return F.when(b == 0, F.lit(otherwise)).otherwise(a.cast("double") / b.cast("double"))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    """Shared members over all members; 1 for two empty sets."""
    return ratio(shared, a + b - shared, 1.0)


def jaccard_arrays(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct members."""
    return jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def containments(shared: Column, a: Column, b: Column) -> Column:
    """A struct of the shared part of each set and their product; all 1 for two empty sets."""
    both = (a == 0) & (b == 0)
    of_a, of_b = F.when(both, 1.0).otherwise(ratio(shared, a)), F.when(both, 1.0).otherwise(ratio(shared, b))
    return F.struct(of_a.alias("a"), of_b.alias("b"), (of_a * of_b).alias("ab"))


def largest_containment(shared: Column, a: Column, b: Column) -> Column:
    """The larger of both shared parts."""
    return F.greatest(ratio(shared, a), ratio(shared, b))


def affinity(shared: Column, a: Column, b: Column) -> Column:
    """Neighbourhood affinity: squared overlap over the product of sizes."""
    return ratio(shared * shared, a * b)


def f1(shared: Column, a: Column, b: Column) -> Column:
    """Twice the overlap over the sum of sizes."""
    return ratio(2 * shared, a + b)


def contained(shared: Column, a: Column, b: Column, share: float) -> Column:
    """Whether the overlap is more than ``share`` of either set."""
    return (ratio(shared, a) > share) & (ratio(shared, b) > share)


def harmonic_mean(a: Column, b: Column) -> Column:
    """Harmonic mean; 0 unless both are positive."""
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b)).otherwise(F.lit(0.0))


def geometric_mean(a: Column, b: Column) -> Column:
    """Square root of the product."""
    return F.sqrt(a * b)


def combinations(n: Column, k: int) -> Column:
    """Number of subsets of ``k`` of ``n`` things, as a double."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda acc, i: acc * F.greatest(n - k + i, F.lit(0)) / i)


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    """Density of a normal distribution."""
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * F.sqrt(2 * F.pi()))
