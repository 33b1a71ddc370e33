"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch errs by about n / ACCURACY ranks; bounds stand four times that far from the quantile.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY
#: Groups of at most this many values need no bounds.
SMALL = 100_000


def quantiles(rows: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, n, cut): the exact interpolated quantile of each share, k its place in shares, n the group's values.
    NULLs don't count; a group without a value has no row. by makes a few groups.

    A sketch gives bounds about each quantile. What lies outside of them is only counted, before the shuffle; single
    values are kept between them alone, so no task sees all the values of a group."""
    by = list(by)
    values = rows.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null")
    near = lambda d: F.percentile_approx("_x", [min(max(s + d, 0.0), 1.0) for s in shares], ACCURACY)
    sketch = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), near(-MARGIN).alias("low"), near(MARGIN).alias("high"))
    bounds = sketch.select(*by, "n", F.posexplode(F.arrays_zip("low", "high")).alias("k", "_b"))
    large = F.col("n") > SMALL
    bounds = bounds.select(*by, "n", "k", F.when(large, F.col("_b.low")).otherwise(float("-inf")).alias("_low"), F.when(large, F.col("_b.high")).otherwise(float("inf")).alias("_high"))
    side = F.when(F.col("_x") < F.col("_low"), 0).when(F.col("_x") <= F.col("_high"), 1).otherwise(2)
    marked = values.join(F.broadcast(bounds), by or F.lit(True)).withColumn("_side", side)
    counts = marked.groupBy(*by, "k", "n", "_side", F.when(F.col("_side") == 1, F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "k").orderBy("_side", "_v"))
    place = F.get(F.lit([float(s) for s in shares]), F.col("k")) * (F.col("n") - 1)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_side", "_v")))
    ends = counts.withColumn("_upto", upto).withColumn("_place", place).groupBy(*by, "k", "n", "_place").agg(at(F.floor("_place")).alias("a"), at(F.ceil("_place")).alias("b"))
    between = (F.ceil("_place") - F.col("_place")) * F.col("a._v") + (F.col("_place") - F.floor("_place")) * F.col("b._v")
    cut = F.when(F.col("a._v") == F.col("b._v"), F.col("a._v")).otherwise(between)
    found = (F.col("a._side") == 1) & (F.col("b._side") == 1)
    return ends.select(*by, "k", "n", F.when(found, cut).otherwise(F.raise_error(F.lit("a quantile lies outside of its sketch's bounds")).cast("double")).alias("cut"))
