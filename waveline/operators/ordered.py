"""Ordered scans over a whole table: lag, lead, fill and row numbers.

A window without ``partitionBy`` puts the table on one task, and a window per
entity puts a hot entity on one task. Here the rows are cut into blocks of
about equal size along the full sort order, wherever an entity begins or ends.
Windows run inside a block; what must cross a block border is one row per
block, which is aggregated before any shuffle and broadcast (its size is
the number of blocks).
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveline.sources.store import stored

BLOCK = "_block"
#: A task sorts the rows of one block, several hundred columns wide at times.
ROWS_PER_BLOCK = 100_000
#: Fewer rows are not worth a task of their own.
LEAST_ROWS_PER_BLOCK = 10_000
BLOCKS_PER_CORE = 3
SAMPLE_PER_BLOCK = 30


def sort_key(columns: Sequence[str]) -> Column:
    """A struct that sorts like the columns, ascending with nulls last."""
    fields = []
    for c in columns:
        fields += [F.col(c).isNull().alias(f"{c}_na"), F.col(c).alias(c)]
    return F.struct(*fields)


def nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def _key_type(df: DataFrame, columns: Sequence[str]) -> T.StructType:
    fields = []
    for c in columns:
        fields += [T.StructField(f"{c}_na", T.BooleanType()), T.StructField(c, df.schema[c].dataType)]
    return T.StructType(fields)


def _block_count(df: DataFrame, rows: int) -> int:
    by_size = math.ceil(rows / ROWS_PER_BLOCK)
    # Several blocks a core, as their sizes are about equal only.
    by_cores = BLOCKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return max(1, by_size, min(by_cores, rows // LEAST_ROWS_PER_BLOCK))


def _borders(df: DataFrame, columns: Sequence[str], rows: int, n: int) -> list[str]:
    """First sort key of blocks 1 .. n-1, as JSON, from a sample of the keys.

    The borders only set the balance. Results do not depend on them. About
    ``SAMPLE_PER_BLOCK`` keys per block come to the driver.
    """
    if n <= 1 or rows == 0:
        return []
    fraction = min(1.0, SAMPLE_PER_BLOCK * n / rows)
    sample = df.select(sort_key(columns).alias("k")).sample(fraction, seed=7)
    keys = [r.k for r in sample.distinct().orderBy("k").select(F.to_json("k", {"ignoreNullFields": "false"}).alias("k")).collect()]
    picks = sorted({len(keys) * i // n for i in range(1, n)} - {0})
    return [keys[i] for i in picks if i < len(keys)]


def _block_of(key: Column, borders: Sequence[str], key_type: T.StructType) -> Column:
    """Number of borders at or below a key, by binary search in a constant array."""
    if not borders:
        return F.lit(0)
    table = F.from_json(F.lit("[" + ",".join(borders) + "]"), T.ArrayType(key_type))
    top = 1 << (len(borders).bit_length() - 1)
    steps = [top >> i for i in range(top.bit_length())]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.get(table, pos + step - 1) <= key, pos + step).otherwise(pos),
    )


@dataclass(frozen=True)
class OrderedBlocks:
    """A table cut into blocks along a sort order.

    The input is read several times, so pass a stored table. The sort order
    must be total (end it with a unique key) for the results to be repeatable.

    Each block is a task of its own, so a task does not grow with the table.
    ``rows`` are the rows before they were shuffled to blocks, from which border
    rows and counts are combined; ``placed`` tells that ``df`` is shuffled.
    """

    df: DataFrame
    order: tuple[str, ...]
    blocks: int
    rows: DataFrame
    placed: bool = False

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str], blocks: int | None = None) -> OrderedBlocks:
        rows = df.count()
        n = blocks or _block_count(df, rows)
        borders = _borders(df, order, rows, n)
        block = _block_of(sort_key(order), borders, _key_type(df, order))
        rows = df.withColumn(BLOCK, block)
        return cls(rows, tuple(order), len(borders) + 1, rows)

    def frame(self) -> DataFrame:
        return self.df.drop(BLOCK)

    def then(self, df: DataFrame) -> OrderedBlocks:
        """The same blocks after a row-wise step that keeps the block column."""
        return replace(self, df=df, rows=df)

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedBlocks:
        """Add columns that are made of the input's columns."""
        return replace(self, df=self.df.withColumns(columns), rows=self.rows.withColumns(columns))

    def _placed(self) -> DataFrame:
        """The rows, each block in a task of its own."""
        return self.df if self.placed else self.df.repartitionById(self.blocks, F.col(BLOCK))

    def _scanned(self, df: DataFrame, *made: str) -> OrderedBlocks:
        """The blocks after a scan; a column it writes anew is no longer that of the input."""
        rows = df if set(made) & set(self.rows.columns) else self.rows
        return replace(self, df=df, rows=rows, placed=True)

    def _in_block(self, *extra: str):
        return Window.partitionBy(BLOCK, *extra).orderBy(*nulls_last(self.order))

    def neighbours(self, columns: Sequence[str], before: str = "_before", after: str = "_after") -> OrderedBlocks:
        """Add the previous and the next row of the table as two structs.

        A struct is null only where there is no such row, so a null value in
        a neighbour is not taken for a missing neighbour.
        """
        row = F.struct(*columns)
        w = self._in_block()
        out = self._placed().withColumns({before: F.lag(row).over(w), after: F.lead(row).over(w)})
        if self.blocks == 1:
            return self._scanned(out, before, after)
        key = sort_key(self.order)
        known = self.rows if set(columns) <= set(self.rows.columns) else self.df
        edges = known.groupBy(BLOCK).agg(
            F.max_by(row, key).alias("_last"), F.min_by(row, key).alias("_first")
        )
        across_blocks = Window.orderBy(BLOCK)
        carry = edges.select(
            BLOCK,
            F.lag("_last").over(across_blocks).alias("_carry_before"),
            F.lead("_first").over(across_blocks).alias("_carry_after"),
        )
        # One row per block.
        out = out.join(F.broadcast(carry), BLOCK, "left").withColumns(
            {before: F.coalesce(before, "_carry_before"), after: F.coalesce(after, "_carry_after")}
        )
        return self._scanned(out.drop("_carry_before", "_carry_after"), before, after)

    def fill(self, directions: Mapping[str, str], entity: str | None = None) -> OrderedBlocks:
        """Replace nulls by the nearest known value.

        ``directions`` maps a column to ``down`` (last known value) or ``up``
        (next known value). With ``entity`` values do not cross entities.

        The rows are shuffled and filled within blocks once and written out;
        the border rows, two per block, then come from a filtered read.
        """
        keys = [BLOCK] + ([entity] if entity else [])
        forward = self._in_block(*keys[1:])
        # An unbounded *following* frame is quadratic in Spark, so "up" is a
        # running frame over the reversed order.
        reverse = [F.col(c).desc_nulls_first() for c in self.order]
        backward = Window.partitionBy(*keys).orderBy(*reverse)
        running = {
            "down": forward.rowsBetween(Window.unboundedPreceding, 0),
            "up": backward.rowsBetween(Window.unboundedPreceding, 0),
        }
        filled = {c: F.last(c, ignorenulls=True).over(running[d]) for c, d in directions.items()}
        if self.blocks == 1:
            return self.then(self._placed().withColumns(filled))
        in_block = self._in_block()
        filled["_top"] = F.lag(F.lit(True), 1, False).over(in_block) == F.lit(False)
        filled["_bottom"] = F.lead(F.lit(True), 1, False).over(in_block) == F.lit(False)
        rows = stored(self._placed().withColumns(filled))

        out = rows
        for direction, border in (("down", "_bottom"), ("up", "_top")):
            columns = [c for c, d in directions.items() if d == direction]
            if columns:
                carry = self._carried(rows.where(border), columns, direction, entity)
                out = out.join(F.broadcast(carry), keys, "left")
                out = out.withColumns({c: F.coalesce(c, f"_carry_{c}") for c in columns})
                out = out.drop(*[f"_carry_{c}" for c in columns])
        return replace(self.then(out.drop("_top", "_bottom")), placed=False)

    @staticmethod
    def _carried(edges: DataFrame, columns: Sequence[str], direction: str, entity: str | None) -> DataFrame:
        """What each block receives from the blocks before (or after) it."""
        step = F.col(BLOCK).asc() if direction == "down" else F.col(BLOCK).desc()
        blocks = Window.orderBy(step)
        so_far = (Window.partitionBy(entity) if entity else Window).orderBy(step)
        so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
        # One border row per block.
        return edges.select(
            F.lead(BLOCK).over(blocks).alias(BLOCK),
            *([entity] if entity else []),
            *[F.last(c, ignorenulls=True).over(so_far).alias(f"_carry_{c}") for c in columns],
        )

    def ordinal(self, name: str, entity: str | None = None, start: int = 0) -> OrderedBlocks:
        """Number the rows of the table, or of each entity, in sort order."""
        keys = [BLOCK] + ([entity] if entity else [])
        number = F.row_number().over(self._in_block(*keys[1:])).cast("long") - 1 + start
        out = self._placed().withColumn(name, number)
        if self.blocks == 1:
            return self._scanned(out, name)
        counts = self.rows.groupBy(*keys).count()
        blocks = Window.partitionBy(entity) if entity else Window
        earlier = blocks.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        # Without an entity: one row per block. With one: only entities that
        # began in an earlier block, at most one per block.
        carry = counts.select(*keys, F.sum("count").over(earlier).alias("_offset")).where("_offset > 0")
        joined = out.join(F.broadcast(carry), keys, "left")
        joined = joined.withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
        return self._scanned(joined.drop("_offset"), name)


def lag_lead(
    blocks: OrderedBlocks,
    columns: Sequence[str],
    entity: str,
    scope: str = "table",
    lag: str = "Lag{col}",
    lead: str = "Lead{col}",
    missing: int | None = None,
) -> OrderedBlocks:
    """Add lag-1 and lead-1 columns.

    ``scope="table"`` takes the neighbouring row of the sorted table, so the
    first visit of an entity sees the last visit of the entity before it.
    ``scope="entity"`` keeps to rows of the same entity. ``missing`` replaces
    nulls, both missing neighbours and null values.
    """
    if scope not in ("table", "entity"):
        raise ValueError(f"unknown scope {scope!r}")
    near = blocks.neighbours(list(dict.fromkeys([entity, *columns])))
    out = {}
    for side, names in (("_before", lag), ("_after", lead)):
        same = F.col(side)[entity].eqNullSafe(F.col(entity))
        for c in columns:
            value = F.col(side)[c]
            if scope == "entity":
                value = F.when(same, value)
            out[names.format(col=c)] = value if missing is None else F.coalesce(value, F.lit(missing))
    return near.then(near.df.withColumns(out).drop("_before", "_after"))
