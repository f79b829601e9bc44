"""Random splits that a retried task repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.functions.columns import uniform


def split_rows(df: DataFrame, key: str, share: float, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows drawn with the given probability, and their complement.

    The draw hangs on the key alone, so both parts can be read separately and
    never overlap. Sizes are approximate.
    """
    drawn = uniform(F.col(key), seed) < share
    return df.where(drawn), df.where(~drawn)


def fold_of(key: str, folds: int, seed: int = 2) -> Column:
    """Fold number from 0 of a row."""
    return F.floor(uniform(F.col(key), seed) * folds).cast("int")
