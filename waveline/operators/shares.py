"""Counts, complete grids, shares and differences between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveline.operators.ordered import nulls_last


def group_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def complete_grid(counts: DataFrame, keys: Sequence[str], value: str = "n", fill: int = 0) -> DataFrame:
    """A row for every combination of the observed key values.

    ``counts`` is an aggregated table of factor levels. Each further key's list
    of levels is a scalar that unfolds beside the grid so far, in the tasks
    that hold the grid.
    """
    grid = counts.select(keys[0]).distinct()
    for k in keys[1:]:
        levels = counts.agg(F.collect_set(F.struct(k))).scalar()
        grid = grid.withColumn(k, F.explode(levels)).withColumn(k, F.col(k)[k])
    c = counts.alias("c")
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    return grid.alias("g").join(c, same, "left").select(
        *[F.col(f"g.{k}").alias(k) for k in keys], F.coalesce(f"c.{value}", F.lit(fill)).alias(value)
    )


def with_share(counts: DataFrame, within: Sequence[str], value: str = "n", name: str = "pct") -> DataFrame:
    """Share of the group total; null for a group without any rows."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return counts.withColumn(name, F.try_divide(F.col(value).cast("double"), total))


def step_difference(
    df: DataFrame, within: Sequence[str], along: str, value: str, name: str = "diff"
) -> DataFrame:
    """Difference to the previous member of the group; undefined ones are dropped."""
    w = Window.partitionBy(*within).orderBy(*nulls_last([along]))
    out = df.withColumn(name, F.col(value) - F.lag(value).over(w))
    return out.select(*within, name).dropna()
