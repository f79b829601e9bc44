"""One row per entity and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveline.functions.scores import poisoned_mean
from waveline.operators.ordered import nulls_last, sort_key


def with_group_value(df: DataFrame, keys: Sequence[str], **values) -> DataFrame:
    """Bring group aggregates back to the rows.

    Aggregating first and joining back lets map-side combine shrink a hot
    group and lets AQE split its rows in the join; a window could do neither.
    """
    groups = df.groupBy(*keys).agg(*[v.alias(k) for k, v in values.items()])
    groups = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept).join(groups, same, "left").drop(*[f"_g_{k}" for k in keys])


def period_mean(df: DataFrame, entity: str, period: str, score: str, name: str) -> DataFrame:
    """Rows with the mean score of their entity and period, rounded up.

    A null score makes the whole period null.
    """
    return with_group_value(df, [entity, period], **{name: F.ceil(poisoned_mean(score)).cast("int")})


def lowest_row(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str]) -> DataFrame:
    """The row with the smallest score per group, first in order on ties.

    A group whose scores are all null has no such row and vanishes.
    """
    w = Window.partitionBy(*keys).orderBy(score, *nulls_last(order))
    known = df.where(F.col(score).isNotNull())
    return known.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def collapse_periods(
    df: DataFrame, entity: str, period: str, score: str, order: Sequence[str]
) -> DataFrame:
    """One row per entity and period: the first in order, with the mean score.

    Once every row of a period carries the mean, the smallest is the first
    row. So mean and row come from one aggregation, combined before the
    shuffle, instead of two windows. Periods with a null score vanish.
    """
    rest = [c for c in df.columns if c not in (entity, period, score)]
    periods = df.groupBy(entity, period).agg(
        F.ceil(poisoned_mean(score)).cast("int").alias(score),
        F.min_by(F.struct(*rest), sort_key(order)).alias("_row"),
    )
    return periods.where(F.col(score).isNotNull()).select(
        *[F.col(c) if c in (entity, period, score) else F.col("_row")[c].alias(c) for c in df.columns]
    )


def with_period_ordinal(df: DataFrame, entity: str, period: str, name: str = "TreatmentWeek") -> DataFrame:
    """Number the periods of an entity from 0.

    Use it on collapsed rows: an entity then has at most one row per
    period, so the window group is bounded by the length of the study.
    """
    w = Window.partitionBy(entity).orderBy(F.col(period).asc_nulls_last())
    return df.withColumn(name, F.row_number().over(w) - 1)
