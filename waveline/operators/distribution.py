"""Distributions of a score per group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, group: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per group and equal-width bin; bins 0 and ``bins + 1`` lie outside."""
    v = F.col(value).cast("double")
    return (
        df.where(v.isNotNull())
        .groupBy(*group, F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def density(
    df: DataFrame, group: Sequence[str], value: str, low: float, high: float, points: int
) -> DataFrame:
    """Gaussian kernel density per group on a fixed grid.

    The bandwidth is 0.9 min(sd, IQR / 1.34) n^-0.2. Equal values are counted
    first, so the work is distinct values x grid points, not rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    v, n = F.col(value).cast("double"), F.col("_n")
    quartiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)), n)
    sums = counts.groupBy(*group).agg(
        F.sum("_n").alias("_size"),
        (F.sum(v * n) / F.sum(n)).alias("_mean"),
        quartiles.alias("_q"),
    )
    spread = counts.join(sums, list(group)).groupBy(*group).agg(
        F.first("_size").alias("_size"),
        F.first(F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))).alias("_iqr"),
        F.sum(n * F.pow(v - F.col("_mean"), 2)).alias("_ss"),
    )
    sd = F.sqrt(F.try_divide(F.col("_ss"), F.col("_size") - 1))
    robust = F.col("_iqr") / 1.34
    # As usual for this rule: a zero IQR falls back to the sd, a zero sd to 1.
    width = F.when((robust > 0) & (robust < sd), robust).when(sd > 0, sd).otherwise(1.0)
    widths = spread.select(*group, "_size", (0.9 * width * F.pow("_size", F.lit(-0.2))).alias("bandwidth"))
    step = (high - low) / (points - 1)
    grid = counts.join(widths, list(group)).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = low + F.col("_g") * step
    z = (x - v) / F.col("bandwidth")
    kernel = n * F.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * F.col("bandwidth") * F.col("_size"))
    return grid.groupBy(*group, x.alias("x")).agg(F.sum(kernel).alias("density"))


def share_within(df: DataFrame, group: str, category: str) -> DataFrame:
    """Share of each category within its group."""
    counts = df.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("share", F.col("n").cast("double") / total)
