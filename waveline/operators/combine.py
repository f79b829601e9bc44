"""Combining study files and removing repeats."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveline.operators.ordered import nulls_last
from waveline.sources.store import stored

COPIES_PER_TASK = 100_000
#: Rows that a task writes out from counts, about.
ROWS_PER_TASK = 10_000_000
#: Different rows of one key that a task of a plain full join may hold.
HOT_ROWS = 100_000


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column that one file lacks is null there.

    This equals ``merge_all`` whenever some common column separates the files,
    and needs no shuffle.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _key_sizes(a: DataFrame, b: DataFrame, common: Sequence[str]) -> DataFrame:
    """Per key its different rows ``_l`` and ``_r`` on the sides, and ``_m`` and ``_n`` with their copies."""
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    left = a.select(*common, one.alias("_l"), none.alias("_r"), "_m", none.alias("_n"))
    right = b.select(*common, none.alias("_l"), one.alias("_r"), none.alias("_m"), "_n")
    return left.unionByName(right).groupBy(*common).agg(*[F.sum(c).alias(c) for c in ("_l", "_r", "_m", "_n")])


def _product(left: str, right: str) -> Column:
    """Rows that a key has in a full join, as a double, for sums past 64 bits."""
    return F.greatest(F.col(left), F.lit(1)).cast("double") * F.greatest(F.col(right), F.lit(1))


def _tagged(side: DataFrame, hot: DataFrame, common: Sequence[str]) -> DataFrame:
    """Rows of a side with the counts of their key, null where it is not hot."""
    joined = side.alias("s").join(hot.alias("h"), _same("s", "h", common), "left")
    return joined.select(*[F.col(f"s.{c}") for c in side.columns], "h._l", "h._r")


def _hot_pairs(a: DataFrame, b: DataFrame, common: Sequence[str], hot_rows: int) -> DataFrame:
    """Inner join of hot keys, cut into cells of about ``hot_rows`` rows of each side.

    A row stands in one piece of its own side and is copied to each piece of the
    other, so every pair meets in just one cell.
    """
    pieces = {side: F.ceil(F.col(n) / hot_rows).cast("int") for side, n in (("_i", "_l"), ("_j", "_r"))}

    def cells(side: DataFrame, own: str, other: str) -> DataFrame:
        columns = [c for c in side.columns if c not in ("_l", "_r")]
        place = F.pmod(F.xxhash64(*columns), pieces[own]).cast("int")
        return side.select(*columns, place.alias(own), F.explode(F.sequence(F.lit(0), pieces[other] - 1)).alias(other))

    both = (F.col("_l") > 0) & (F.col("_r") > 0)
    left, right = cells(a.where(both), "_i", "_j"), cells(b.where(both), "_j", "_i")
    return left.alias("a").join(right.alias("b"), _same("a", "b", [*common, "_i", "_j"]), "inner")


def merge_all(left: DataFrame, right: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Full outer join on every common column, null matching null.

    ``m`` equal rows on one side and ``n`` on the other give ``m * n`` rows.
    Copies are counted before the join, so a large group of equal rows is
    shuffled as one row, and they are written out again by many tasks.

    Spark does not split a full join, so keys with more than ``hot_rows``
    different rows on a side go their own way: those on both sides are joined in
    cells, and those on one side only need no join at all.
    """
    common = [c for c in left.columns if c in right.columns]
    extra_left = [c for c in left.columns if c not in common]
    extra_right = [c for c in right.columns if c not in common]
    # Both are read several times: for the counts, the plain join and the cells.
    a = stored(left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_m")))
    b = stored(right.groupBy(*right.columns).agg(F.count(F.lit(1)).alias("_n")))

    def result(joined: DataFrame) -> DataFrame:
        in_left = F.col("a._m").isNotNull()
        return joined.select(
            *[F.when(in_left, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in common],
            *[F.col(f"a.{c}") for c in extra_left],
            *[F.col(f"b.{c}") for c in extra_right],
            (F.coalesce("a._m", F.lit(1)) * F.coalesce("b._n", F.lit(1))).alias("_copies"),
        )

    keys = _key_sizes(a, b, common)
    most, pairs, rows = keys.agg(F.max(F.greatest("_l", "_r")), F.sum(_product("_l", "_r")), F.sum(_product("_m", "_n"))).first()
    if (most or 0) <= hot_rows:
        joined = result(a.alias("a").join(b.alias("b"), _same("a", "b", common), "full"))
    else:
        hot = stored(keys.where(F.greatest("_l", "_r") > hot_rows).drop("_m", "_n"))
        a, b = _tagged(a, hot, common), _tagged(b, hot, common)
        plain = F.col("_l").isNull()
        cool = a.where(plain).alias("a").join(b.where(plain).alias("b"), _same("a", "b", common), "full")
        lone_left = a.where("_r = 0").withColumnRenamed("_m", "_copies").drop("_l", "_r")
        lone_right = b.where("_l = 0").withColumnRenamed("_n", "_copies").drop("_l", "_r")
        joined = result(cool).unionByName(result(_hot_pairs(a, b, common, hot_rows)))
        joined = stack([joined, lone_left, lone_right])
    # Where rows stand for many, a few tasks of the join would write out all of the result.
    return repeat_rows(joined, "_copies", math.ceil(rows / ROWS_PER_TASK) if (rows or 0) > 2 * pairs else None)


def repeat_rows(df: DataFrame, copies: str, tasks: int | None = None) -> DataFrame:
    """Write every row as often as its count says, large counts in pieces.

    ``tasks`` deals the pieces out evenly to so many tasks.
    """
    columns = [c for c in df.columns if c != copies]
    pieces = df.withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(COPIES_PER_TASK).cast("long")))
    ).withColumn("_here", F.least(F.lit(COPIES_PER_TASK), F.col(copies) - F.col("_from")).cast("int"))
    if tasks:
        pieces = pieces.repartition(tasks)
    # A piece is a bounded number of rows, so one task may hold several.
    return pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_here")))).select(columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps only the first row of a key within each task before the
    shuffle, so a key with many copies costs one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*nulls_last(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
