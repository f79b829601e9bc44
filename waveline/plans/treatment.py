"""Treatment effect: weekly scores, severity, improvement and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveline.functions.bands import CHART_LINES, improvement, severity
from waveline.functions.columns import drop_range
from waveline.functions.scores import poisoned_mean, relative_change
from waveline.operators.collapse import collapse_periods, with_period_ordinal
from waveline.operators.shares import complete_grid, group_counts, step_difference, with_share
from waveline.sources.panel_csv import SCORE

CELL = ["Study", "TxGroup", "TreatmentWeek"]
GRID = [*CELL, "ImprovementLevel"]


def weekly(visits: DataFrame) -> DataFrame:
    """One row per patient and week, numbered per patient, without items.

    The items are dropped before the grouping, so they are not read at all.
    """
    slim = drop_range(visits.drop("LeadStatus"), "P1", "G16")
    return with_period_ordinal(
        collapse_periods(slim, "PatientID", "Week", SCORE, ["VisitDay"]), "PatientID", "Week"
    )


def treatment_data(visits: DataFrame) -> DataFrame:
    """Weeks 0, 1, 2, 4 and 6 with baseline, severity, change and improvement."""
    rows = weekly(visits)
    # After the collapse a patient has at most one day-0 row, so the baseline
    # join is a window over the partitions that the ordinal already made.
    at_zero = F.max(F.when(F.col("VisitDay") == 0, F.col(SCORE)))
    rows = rows.withColumn("BaselinePANSS", at_zero.over(Window.partitionBy("PatientID")))
    rows = rows.where((F.col("TreatmentWeek") <= 2) | F.col("TreatmentWeek").isin(4, 6))
    return rows.withColumns(
        {"CGI": severity(F.col(SCORE)), "PctChange": relative_change(SCORE, "BaselinePANSS")}
    ).withColumn("ImprovementLevel", improvement(F.col("TreatmentWeek"), F.col("PctChange")))


def mean_scores(data: DataFrame, name: str = "avgPANSS") -> DataFrame:
    """Mean score per study, treatment group and week."""
    return data.groupBy(*CELL).agg(poisoned_mean(SCORE).alias(name))


def mean_scores_with_lines(data: DataFrame) -> DataFrame:
    """Mean scores with the number of severity lines at or below them."""
    lines = F.array(*[F.lit(cut) for cut in CHART_LINES])
    below = F.size(F.filter(lines, lambda cut: cut <= F.col(SCORE)))
    labels = F.array(*[F.lit(label) for label in CHART_LINES.values()])
    return mean_scores(data, SCORE).withColumn("lines_below", below).withColumn(
        "line_label", F.when(below > 0, F.get(labels, below - 1))
    )


def improvement_shares(data: DataFrame) -> DataFrame:
    """Share of each improvement level per study, treatment group and week.

    The counts are combined before the shuffle; everything after them works
    on one row per combination of levels.
    """
    counts = group_counts(data, GRID)
    return with_share(complete_grid(counts, GRID), CELL)


def improvement_differences(data: DataFrame) -> DataFrame:
    """Treatment share less control share per study, week and level."""
    return step_difference(
        improvement_shares(data), ["Study", "TreatmentWeek", "ImprovementLevel"], "TxGroup", "pct"
    )
