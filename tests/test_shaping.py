"""Hand-made frames: repeats, nulls, ties, missing baselines, band edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from waveline.functions.bands import grade, improvement, severity
from waveline.functions.columns import across, col_range, drop_range, numeric_columns, prefix_range, uniform
from waveline.functions.scores import (
    change_flag,
    many_flags,
    relative_change,
    rising,
    row_spread,
    row_sum,
    threshold_class,
    two_way,
)
from waveline.operators import combine
from waveline.operators.align import actual_or_predicted, natural_left_join, nearest_visit, visits_at_least_distance
from waveline.operators.collapse import collapse_periods, lowest_row, period_mean, with_period_ordinal
from waveline.operators.combine import first_per_key, merge_all, repeat_rows, stack
from waveline.operators.shares import complete_grid, group_counts, step_difference, with_share
from waveline.operators.split import split_rows
from waveline.plans.prepare import combine_studies
from waveline.sources.panel_csv import read_panel, with_week, write_panel
from waveline.session import METHOD_LIMIT
from waveline.sources.store import StoredTable, compiled_methods, scratch_path


def collected(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_merge_collapses_equal_rows_and_multiplies_repeats(spark):
    a = spark.createDataFrame([("A", 1, 5), ("A", 1, 5), ("A", 2, None), ("B", 3, 1)], "s string, p int, x int")
    b = spark.createDataFrame(
        [("A", 1, 5, "u"), ("A", 1, 5, "u"), ("A", 1, 5, "w"), ("A", 2, None, "v"), ("C", 9, 9, "z")],
        "s string, p int, x int, extra string",
    )
    expected = [("A", 1, 5, "u")] * 4 + [("A", 1, 5, "w")] * 2
    expected += [("A", 2, None, "v"), ("B", 3, 1, None), ("C", 9, 9, "z")]
    assert collected(merge_all(a, b)) == sorted(expected, key=repr)


def test_a_merge_of_many_copies_is_written_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(combine, "COPIES_PER_TASK", 100)
    monkeypatch.setattr(combine, "ROWS_PER_TASK", 2_000)
    a = spark.range(300).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("p"))
    b = spark.range(100).select(F.lit(1).alias("k"), F.lit(None).cast("int").alias("q"))
    merged = merge_all(a, b)
    tasks = [r["count"] for r in merged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 30_000 and len(tasks) == 15 and max(tasks) < 6_000
    assert collected(merged.groupBy("k", "p", "q").count()) == [(1, 0, None, 15_000), (1, 1, None, 15_000)]


def test_wide_steps_are_stored_in_methods_that_the_jvm_compiles(spark, monkeypatch):
    name, limit = METHOD_LIMIT
    spark.conf.set(name, "65535")
    seen, write = [], type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda *a: (seen.append(spark.conf.get(name)), write(*a))[1])
    try:
        StoredTable.write(spark.range(3))
        with pytest.raises(ValueError), compiled_methods(spark):
            raise ValueError
        assert seen == [limit] and spark.conf.get(name) == "65535"
    finally:
        spark.conf.set(name, limit)


@pytest.mark.parametrize("hot_rows", [1, 7, 10_000])
def test_merge_of_hot_keys_equals_the_plain_join(spark, hot_rows):
    left = [(1, i, "x") for i in range(40)] + [(2, i, "x") for i in range(9)] + [(3, 0, "x"), (3, 0, "x"), (None, 5, None), (None, 6, None)]
    right = [(1, i % 25, "y") for i in range(30)] + [(4, i, "y") for i in range(11)] + [(3, 1, "y"), (None, 7, "n"), (5, 0, None)]
    a, b = spark.createDataFrame(left, "k int, p int, u string"), spark.createDataFrame(right, "k int, q int, v string")
    expected = [(k, p, u, q, v) for k, p, u in left for j, q, v in right if k == j]
    expected += [(*r, None, None) for r in left if r[0] not in {x[0] for x in right}]
    expected += [(k, None, None, q, v) for k, q, v in right if k not in {x[0] for x in left}]
    assert collected(merge_all(a, b, hot_rows=hot_rows)) == sorted(expected, key=repr)


def test_a_key_of_many_rows_is_joined_by_many_tasks(spark):
    a = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    b = spark.range(5).select(F.lit(1).alias("k"), F.col("id").alias("q"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = merge_all(a, b, hot_rows=2_000)
        tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(tasks) == 500_000 and len(tasks) > 4 and max(tasks) < 200_000
    assert pairs.distinct().count() == 500_000


def test_large_repeat_counts_are_whole(spark, monkeypatch):
    import waveline.operators.combine as combine

    monkeypatch.setattr(combine, "COPIES_PER_TASK", 3)
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10)], "k string, n long")
    counts = {r.k: r["count"] for r in repeat_rows(df, "n").groupBy("k").count().collect()}
    assert counts == {"a": 1, "b": 3, "c": 10}


def test_stack_equals_merge_when_a_column_separates_the_files(spark):
    a = spark.createDataFrame([("A", 1, 0, "Passed"), ("A", 2, 7, "Flagged")], "Study string, PatientID int, VisitDay int, LeadStatus string")
    e = spark.createDataFrame([("E", 3, 0)], "Study string, PatientID int, VisitDay int")
    assert collected(combine_studies([a, e])) == collected(combine_studies([a, e], "merge").select("Study", "PatientID", "VisitDay", "LeadStatus", "Week"))
    assert collected(stack([a, e]).where("Study = 'E'")) == [("E", 3, 0, None)]
    with pytest.raises(ValueError):
        combine_studies([a, e], "other")


def test_first_per_key_takes_the_first_in_order_nulls_last(spark):
    df = spark.createDataFrame([(1, 0, None, "x"), (1, 0, 4, "y"), (1, 0, 2, "z"), (2, 0, None, "w")], "p int, d int, r int, v string")
    assert collected(first_per_key(df, ["p", "d"], ["r"])) == [(1, 0, 2, "z"), (2, 0, None, "w")]


def test_week_of_negative_and_border_days(spark):
    df = with_week(spark.createDataFrame([(-7,), (-1,), (0,), (6,), (7,), (None,)], "VisitDay int"))
    assert [r.Week for r in df.collect()] == [0, 0, 1, 1, 2, None]


def test_null_score_poisons_its_week_and_drops_it(spark):
    rows = [(1, 1, 0, 10), (1, 1, 3, 13), (1, 2, 8, 9), (1, 2, 9, None), (2, 1, 3, 7), (2, 1, 1, 8)]
    df = spark.createDataFrame(rows, "PatientID int, Week int, VisitDay int, S int")
    means = collected(period_mean(df, "PatientID", "Week", "S", "m").select("PatientID", "Week", "VisitDay", "m"))
    assert means == [(1, 1, 0, 12), (1, 1, 3, 12), (1, 2, 8, None), (1, 2, 9, None), (2, 1, 1, 8), (2, 1, 3, 8)]
    collapsed = collapse_periods(df, "PatientID", "Week", "S", ["VisitDay"])
    assert collected(collapsed) == [(1, 1, 0, 12), (2, 1, 1, 8)]
    assert collected(lowest_row(df, ["PatientID", "Week"], "S", ["VisitDay"])) == [(1, 1, 0, 10), (1, 2, 8, 9), (2, 1, 3, 7)]
    assert collected(with_period_ordinal(collapsed, "PatientID", "Week").select("TreatmentWeek")) == [(0,), (0,)]


def test_patient_without_baseline_gets_null(spark):
    left = spark.createDataFrame([(1, 0), (2, 3)], "PatientID int, VisitDay int")
    right = spark.createDataFrame([(1, 80)], "PatientID int, Base int")
    assert collected(natural_left_join(left, right)) == [(1, 0, 80), (2, 3, None)]
    with pytest.raises(ValueError):
        natural_left_join(left, spark.createDataFrame([(1,)], "other int"))


def test_nearest_visit_ties(spark):
    rows = [(1, 119, 1), (1, 133, 2), (2, 130, 3), (2, 130, 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "PatientID int, VisitDay int, A int")
    assert collected(nearest_visit(df, "PatientID", "VisitDay", 126, ["VisitDay", "A"])) == [(1, 119, 1), (2, 130, 3)]
    kept = visits_at_least_distance(df, "PatientID", "VisitDay", 126)
    assert collected(kept.select("A")) == [(1,), (2,), (3,), (4,)]


def test_actual_rows_fan_out_and_win(spark):
    actual = spark.createDataFrame([(1, 50), (1, 60), (2, None)], "PatientID int, S int")
    predicted = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "PatientID int, S int")
    assert collected(actual_or_predicted(actual, predicted, "PatientID", "S")) == [(1, 50), (1, 60), (2, 2), (3, 3)]


def test_band_edges(spark):
    scores = [44, 45, 57, 58, 74, 75, 94, 95, 115, 116, 144, 145, None]
    df = spark.createDataFrame([(s,) for s in scores], "s int")
    rows = df.select(severity(F.col("s")).alias("a"), grade(F.col("s")).alias("b")).collect()
    assert [r.b for r in rows] == [1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, None]
    assert [r.a for r in rows] == ["Mild"] * 5 + ["Moderate"] * 2 + ["Marked"] * 2 + ["Severe"] * 3 + [None]


@pytest.mark.parametrize(
    "week, change, level",
    [
        (0, 0.0, "Baseline"), (0, 0.11, "Worsen"), (1, 0.1, "None"), (1, -0.18, "None"), (1, -0.19, "Minimal"),
        (1, -0.39, "Minimal"), (1, -0.4, "Much"), (2, -0.22, "None"), (2, -0.23, "Minimal"), (2, -0.45, "Much"),
        (4, -0.25, "None"), (4, -0.26, "Minimal"), (4, -0.51, "Much"), (6, -0.27, "None"), (6, -0.28, "Minimal"),
        (6, -0.53, "Much"), (6, None, "Baseline"), (3, -0.9, "Baseline"),
    ],
)
def test_improvement_cuts(spark, week, change, level):
    df = spark.createDataFrame([(week, change)], "w int, c double")
    assert df.select(improvement(F.col("w"), F.col("c"))).first()[0] == level


def test_relative_change_rounds_to_even_and_survives_zero(spark):
    df = spark.createDataFrame([(9, 8), (31, 40), (0, 0), (None, 4), (40, 40)], "x int, b int")
    assert [r[0] for r in df.select(relative_change("x", "b")).collect()] == [0.12, -0.22, None, None, 0.0]


def test_flags_and_sums(spark):
    df = spark.createDataFrame([(c,) for c in (-3, -2, 0, 2, 3, None)], "c int")
    assert [r[0] for r in df.select(change_flag("c")).collect()] == [1, 0, 0, 0, 1, None]
    wide = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 1, 0), (1, None, 1, 1)], "a int, b int, c int, d int")
    row = wide.select(row_sum(list("abcd")), many_flags(list("abcd")), row_spread(list("abcd"))).collect()
    assert [tuple(r) for r in row] == [(4, True, 0), (3, False, 1), (None, None, None)]
    assert wide.limit(1).select(rising(F.lit(2), F.lit(1), F.lit(3))).first()[0]
    p = spark.createDataFrame([(0.8,), (0.81,), (None,)], "p double")
    assert [r[0] for r in p.select(threshold_class("p")).collect()] == ["NP", "P", "NP"]
    s = spark.createDataFrame([("Passed",), ("x",), (None,)], "s string")
    assert [r[0] for r in s.select(two_way("s", "Passed", "P", "NP")).collect()] == ["P", "NP", None]


def test_grid_shares_and_differences(spark):
    rows = [("A", "C", "x"), ("A", "C", "y"), ("A", "T", "x"), ("B", "C", "x")]
    counts = group_counts(spark.createDataFrame(rows, "s string, g string, l string"), ["s", "g", "l"])
    grid = complete_grid(counts, ["s", "g", "l"])
    assert grid.count() == 8
    shares = with_share(grid, ["s", "g"])
    sums = {(r.s, r.g): r.t for r in shares.groupBy("s", "g").agg(F.sum("pct").alias("t")).collect()}
    assert sums == {("A", "C"): 1.0, ("A", "T"): 1.0, ("B", "C"): 1.0, ("B", "T"): None}
    assert collected(step_difference(shares, ["s", "l"], "g", "pct")) == [("A", "x", 0.5), ("A", "y", -0.5)]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2, 3.0)], "id long, t string, P1 int, G16 double")
    assert col_range(df, "t", "G16") == ["t", "P1", "G16"]
    assert drop_range(df, "P1", "G16").columns == ["id", "t"]
    assert numeric_columns(df) == ["id", "P1", "G16"]
    assert prefix_range(df, "P1", "G16", "Base").columns == ["id", "t", "BaseP1", "BaseG16"]
    assert across(df, ["P1"], lambda c: c + 1, "New{col}").first().NewP1 == 3
    with pytest.raises(ValueError):
        col_range(df, "G16", "P1")


def test_split_is_repeatable_and_whole(spark):
    df = spark.range(4000)
    a, b = split_rows(df, "id", 0.7)
    again = split_rows(df.repartition(13), "id", 0.7)[0]
    assert collected(a) == collected(again)
    assert a.count() + b.count() == 4000 and a.intersect(b).count() == 0
    assert abs(a.count() / 4000 - 0.7) < 0.03
    draws = df.select(uniform(F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= draws[0] and draws[1] < 1 and abs(draws[2] - 0.5) < 0.03


def test_csv_round_trip_keeps_missing_values(spark):
    df = spark.createDataFrame([(2, None), (1, "b")], "k int, v string")
    path = scratch_path(spark)
    write_panel(df, path, row_names=["k"])
    schema = "X long, k int, v string"
    from pyspark.sql.types import _parse_datatype_string

    back = read_panel(spark, path, _parse_datatype_string(schema))
    assert collected(back) == [(1, 1, "b"), (2, 2, None)]


def test_csv_scan_goes_by_name(spark, tmp_path):
    from waveline.sources.panel_csv import PANEL_SCHEMA, read_panel

    names = [f.name for f in PANEL_SCHEMA if f.name not in ("LeadStatus", "Week")]
    (tmp_path / "e.csv").write_text(",".join(["Other", *reversed(names)]) + "\n" + ",".join(["x", *["3"] * (len(names) - 1), "E"]) + "\n" + ",".join(["y", *["NA"] * len(names)]) + "\n")
    found = read_panel(spark, str(tmp_path / "e.csv"))
    assert found.columns == PANEL_SCHEMA.names
    rows = {r.Study: r for r in found.collect()}
    assert rows["E"].PatientID == 3
    assert rows["E"].LeadStatus is None and rows["E"].Week is None
    assert rows[None].P1 is None
