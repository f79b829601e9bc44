"""Column selection by name, range and type."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in column order."""
    names = df.columns
    i, j = names.index(first), names.index(last)
    if i > j:
        raise ValueError(f"{first} comes after {last}")
    return names[i : j + 1]


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*col_range(df, first, last))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def prefix_range(df: DataFrame, first: str, last: str, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in col_range(df, first, last)})


def across(
    df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column], names: str = "{col}"
) -> DataFrame:
    """Apply one function to many columns in a single projection."""
    return df.withColumns({names.format(col=c): fn(F.col(c)) for c in columns})


def uniform(key: Column, seed: int = 2) -> Column:
    """A number in [0, 1) drawn from a key and a seed.

    It depends on neither partitioning nor row order, so a retried task draws
    the same number again. MD5 is spelled alike in other engines.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
