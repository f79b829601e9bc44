"""Ordered blocks agree with one-partition windows for any number of blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waveline.operators import ordered
from waveline.operators.ordered import BLOCK, OrderedBlocks, lag_lead, nulls_last

ORDER = ["p", "d", "a"]


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(3)
    rows = []
    for a in range(400):
        # One patient holds a third of the rows; some patients have one visit.
        p = 7 if rng.random() < 0.33 else rng.choice([*range(1, 60), None])
        x = None if rng.random() < 0.6 else rng.randint(1, 7)
        y = None if p in (7, 8, 9) else rng.choice([None, 5])
        rows.append((p, rng.choice([*range(-2, 9), None]), a, x, y))
    return spark.createDataFrame(rows, "p int, d int, a int, x int, y int").cache()


def rows_of(df, *columns):
    return sorted([tuple(r) for r in df.select("a", *columns).collect()])


def windows(scope):
    base = Window.partitionBy("p") if scope == "entity" else Window
    return base.orderBy(*nulls_last(ORDER))


@pytest.mark.parametrize("blocks", [1, 2, 7, 50])
@pytest.mark.parametrize("scope", ["table", "entity"])
def test_lag_and_lead(visits, blocks, scope):
    ours = lag_lead(OrderedBlocks.of(visits, ORDER, blocks), ["x"], "p", scope).frame()
    w = windows(scope)
    plain = visits.withColumns({"Lagx": F.lag("x").over(w), "Leadx": F.lead("x").over(w)})
    key = lambda r: [(v is None, v) for v in r]
    mine = sorted([tuple(r) for r in ours.select("a", "Lagx", "Leadx").collect()], key=key)
    assert mine == sorted([tuple(r) for r in plain.select("a", "Lagx", "Leadx").collect()], key=key)


@pytest.mark.parametrize("blocks", [1, 3, 40])
@pytest.mark.parametrize("scope", ["table", "entity"])
def test_fill(visits, blocks, scope):
    known = visits.where("p is not null")
    entity = "p" if scope == "entity" else None
    ours = OrderedBlocks.of(known, ORDER, blocks).fill({"x": "down", "y": "up"}, entity).frame()
    w = windows(scope)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    on = w.rowsBetween(0, Window.unboundedFollowing)
    plain = known.withColumns({"x": F.last("x", True).over(back), "y": F.first("y", True).over(on)})
    key = lambda r: [(v is None, v) for v in r]
    mine = sorted([tuple(r) for r in ours.select("a", "x", "y").collect()], key=key)
    assert mine == sorted([tuple(r) for r in plain.select("a", "x", "y").collect()], key=key)


@pytest.mark.parametrize("blocks", [1, 4, 30])
def test_ordinals(visits, blocks):
    known = visits.where("p is not null")
    made = OrderedBlocks.of(known, ORDER, blocks)
    own = made.ordinal("n", "p").frame()
    assert rows_of(own, "n") == rows_of(known.withColumn("n", F.row_number().over(windows("entity")) - 1), "n")
    overall = made.ordinal("n", start=1).frame()
    assert rows_of(overall, "n") == rows_of(known.withColumn("n", F.row_number().over(windows("table"))), "n")


def test_lag_then_lead_restores_the_value(visits):
    made = lag_lead(OrderedBlocks.of(visits, ORDER, 6), ["a"], "p", "table")
    twice = made.then(made.df.drop("Leada").withColumnRenamed("Laga", "b"))
    back = lag_lead(twice, ["b"], "p", "table").frame()
    assert back.where("Leadb is not null and Leadb <> a").count() == 0
    assert back.where("Leadb is null").count() == 1


def test_missing_values_are_told_from_missing_rows(spark):
    df = spark.createDataFrame([(1, 0, 1, None), (1, 7, 2, 4), (2, 0, 3, 5)], "p int, d int, a int, x int")
    out = lag_lead(OrderedBlocks.of(df, ORDER, 3), ["x"], "p", "table", missing=0).frame()
    assert rows_of(out, "Lagx", "Leadx") == [(1, 0, 4), (2, 0, 5), (3, 4, 0)]


def test_hot_patient_is_spread_over_blocks(visits):
    made = OrderedBlocks.of(visits, ORDER, 30)
    assert made.df.where("p = 7").select("_block").distinct().count() > 5


def test_unknown_scope_is_refused(visits):
    with pytest.raises(ValueError):
        lag_lead(OrderedBlocks.of(visits, ORDER, 2), ["x"], "p", "study")


def test_a_task_holds_one_block_however_many_there_are(visits):
    assert ordered._block_count(visits, 54_000_000) >= 540
    known = visits.where("p is not null")
    made = OrderedBlocks.of(known, ORDER, 40).ordinal("n", "p").neighbours(["p", "x"])
    tasks = made.df.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct(BLOCK).alias("blocks")).collect()
    assert len(tasks) == made.blocks and {t.blocks for t in tasks} == {1}


def test_a_column_written_anew_is_what_later_scans_see(visits):
    known = visits.where("p is not null").withColumn("n", F.lit(-1).cast("long"))
    out = OrderedBlocks.of(known, ORDER, 5).ordinal("n", start=1).neighbours(["n"]).frame()
    assert out.where("_before.n <> n - 1 or _after.n <> n + 1").count() == 0
