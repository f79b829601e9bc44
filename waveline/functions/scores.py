"""Scores, changes and flags of one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_sum(columns: Sequence[Column | str]) -> Column:
    """Sum across columns of a row; null if any of them is null."""
    return reduce(add, [_col(c) for c in columns])


def composite(negative: Sequence[str], positive: Sequence[str]) -> Column:
    """Bipolar index: sum of one item group less the sum of another."""
    return row_sum(negative) - row_sum(positive)


def round_half_even(value: Column | str, digits: int) -> Column:
    """Round to the nearer decimal, to the even digit if both are as near.

    Distances are taken between doubles. ``bround`` would round the shortest
    decimal text of the number, which decides some ties differently.
    """
    x, scale = _col(value), float(10**digits)
    size = F.abs(x)
    whole = F.floor(size * scale)
    below, above = whole / scale, F.ceil(size * scale) / scale
    to_below, to_above = size - below, above - size
    up = (to_above < to_below) | ((to_above == to_below) & (whole % 2 == 1))
    nearest = F.when(up, above).otherwise(below)
    return F.when(x < 0, 0.0 - nearest).when(x >= 0, nearest)


def relative_change(value: Column | str, base: Column | str, digits: int = 2) -> Column:
    """Change from a base as a rounded share of it; null for a base of zero."""
    return round_half_even(F.try_divide(_col(value) - _col(base), _col(base)), digits)


def change_flag(change: Column | str, limit: int = 2) -> Column:
    """1 for a change beyond the limit either way, else 0; null stays null."""
    c = _col(change)
    return F.when(F.abs(c) > limit, 1).when(c <= limit, 0)


def many_flags(flags: Sequence[Column | str], limit: int = 3) -> Column:
    """True when more than ``limit`` flags are set."""
    return row_sum(flags) > limit


def row_spread(columns: Sequence[str]) -> Column:
    """Largest less smallest value of a row; null if any of them is null."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(complete, F.greatest(*columns) - F.least(*columns))


def rising(now: Column | str, before: Column | str, after: Column | str) -> Column:
    """Above the value before and below the value after."""
    return (_col(now) > _col(before)) & (_col(now) < _col(after))


def threshold_class(probability: Column | str, cut: float = 0.8) -> Column:
    """``P`` above the cut, otherwise ``NP``, also for a missing probability."""
    return F.when(_col(probability) > cut, "P").otherwise("NP")


def two_way(value: Column | str, match: str, yes: str, no: str) -> Column:
    """Recode a text to one of two; null stays null."""
    c = _col(value)
    return F.when(c == match, yes).when(c != match, no)


def closeness(day: Column | str, target: int = 126) -> Column:
    """Weight of a visit: 1 on the target day, falling with the distance."""
    return 1 - F.abs(_col(day) - target) / target


def poisoned_mean(value: Column | str) -> Column:
    """Group mean that is null as soon as one value is null."""
    c = _col(value)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))
