"""Standard scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def z_scores(df: DataFrame, columns: Sequence[str], names: str = "{col}") -> DataFrame:
    """Centre by the mean and divide by the sample standard deviation.

    The moments come from one aggregate, read as a scalar subquery: nothing is
    joined and nothing passes through the driver. A constant column is null.
    """
    moments = df.agg(
        F.struct(
            *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns]
        ).alias("moments")
    )
    row = moments.scalar()
    return df.withColumns(
        {
            names.format(col=c): F.try_divide(F.col(c) - row[c]["mean"], row[c]["sd"])
            for c in columns
        }
    )
