"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval for k of n, within [0, 1]; (0, 0) for n = 0."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p = k / m
    scale = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def log_factorial(n: Column) -> Column:
    """By Stirling's series at n + 8, where it errs by some 1e-12."""
    x = n.cast("double") + 8
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return series - sum((F.log(n.cast("double") + k) for k in range(1, 9)), F.lit(0.0))


def exact_sign_p(b: Column, c: Column) -> Column:
    """Two-sided binomial probability at 1/2 of discordant counts b and c (McNemar's exact test); 1 without any.

    The largest term comes first and each next one from it; terms beyond 40 standard deviations are below any double,
    so the work grows with the root of the counts."""
    n, least = (b + c).cast("bigint"), F.least(b, c).cast("bigint")
    top = F.exp(log_factorial(n) - log_factorial(least) - log_factorial(n - least) - n * math.log(2.0))
    steps = F.least(least, (20 * F.sqrt(n) + 100).cast("bigint"))
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def next_term(s: Column, j: Column) -> Column:
        term = s.term * (least - j + 1) / (n - least + j)
        return F.struct(term.alias("term"), (s.sum + term).alias("sum"))

    below = F.when(steps > 0, F.sequence(F.lit(1).cast("bigint"), steps)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * top * F.aggregate(below, state, next_term, lambda s: s.sum))).otherwise(1.0)


def upper_median(values: Column) -> Column:
    """Of an array: the upper of the two middle values for even sizes."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def nearest_rank(values: Column, q: float) -> Column:
    """Of an array: the value at index int(q * n), at most the last."""
    return F.get(F.sort_array(values), F.least(F.floor(F.size(values) * F.lit(q)).cast("int"), F.size(values) - 1))


def sigma_from_range(spread: Column, n: Column) -> Column:
    """A standard deviation from the range of n values."""
    # fixed values: expected ranges of samples of 2, 3, 4 and more normal values
    return spread / F.when(n <= 2, 1.128).when(n == 3, 1.693).when(n == 4, 2.059).otherwise(2.3)
