"""Aligning visits to a baseline, a target day and a second table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveline.operators.collapse import with_group_value
from waveline.operators.combine import merge_all
from waveline.operators.ordered import nulls_last


def baseline(df: DataFrame, entity: str, day: str, columns: Mapping[str, str], at: int = 0) -> DataFrame:
    """Values of the baseline visits, renamed by ``columns`` (old to new)."""
    return df.where(F.col(day) == at).select(entity, *[F.col(c).alias(new) for c, new in columns.items()])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column the two tables share.

    No side is broadcast by hint: Spark compares the smaller one with its
    limit, and AQE splits a hot key otherwise.
    """
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared, "left")


def nearest_visit(df: DataFrame, entity: str, day: str, target: int, order: Sequence[str]) -> DataFrame:
    """The visit closest to a target day per entity, first in order on ties."""
    w = Window.partitionBy(entity).orderBy(F.abs(F.col(day) - target).asc_nulls_last(), *nulls_last(order))
    known = df.where(F.col(day).isNotNull())
    return known.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def visits_at_least_distance(df: DataFrame, entity: str, day: str, target: int) -> DataFrame:
    """All visits at the smallest distance to a target day, ties included."""
    distance: Column = F.abs(F.col(day) - target)
    # A null day makes the minimum null and drops the entity.
    least = F.when(F.count(day) == F.count(F.lit(1)), F.min(distance))
    return with_group_value(df, [entity], _least=least).where(distance == F.col("_least")).drop("_least")


def actual_or_predicted(actual: DataFrame, predicted: DataFrame, entity: str, value: str) -> DataFrame:
    """Actual values where known, predictions elsewhere.

    An entity with several actual rows keeps them all, however many: see
    ``merge_all``. Rows without an entity match each other.
    """
    a = actual.select(entity, F.col(value).alias("_actual"))
    p = predicted.select(entity, F.col(value).alias("_predicted"))
    return merge_all(a, p).select(entity, F.coalesce("_actual", "_predicted").alias(value))
