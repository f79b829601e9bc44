"""Bands and levels from cut tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity bands of the total score. A band starts at its cut.
SEVERITY_CUTS = [75, 95, 116]
SEVERITY_LABELS = ["Mild", "Moderate", "Marked", "Severe"]
GRADE_CUTS = [45, 58, 75, 95, 116, 145]
GRADES = [1, 2, 3, 4, 5, 6, 7]

# Improvement cuts per treatment week. A change above the first
# cut is "None", above the second "Minimal", otherwise "Much".
IMPROVEMENT_CUTS = {
    1: (-0.19, -0.4),
    2: (-0.23, -0.45),
    4: (-0.26, -0.51),
    6: (-0.28, -0.53),
}
WORSEN_ABOVE = 0.1

# Display order of the levels, and cut lines of the score chart.
LEVEL_ORDER = ["None", "Much", "Minimal", "Worsen", "Baseline"]
DIFFERENCE_LEVEL_ORDER = ["Much", "Minimal", "None", "Worsen", "Baseline"]
CHART_LINES = {58: "Mild", 75: "Moderate", 95: "Marked", 116: "Severe"}


def band(value: Column, cuts: Sequence[float], labels: Sequence) -> Column:
    """Label of the band a value falls in; null stays null."""
    out = F.when(value < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        out = out.when(value < cut, label)
    return out.when(value >= cuts[-1], labels[-1])


def severity(score: Column) -> Column:
    return band(score, SEVERITY_CUTS, SEVERITY_LABELS)


def grade(score: Column) -> Column:
    return band(score, GRADE_CUTS, GRADES)


def improvement(
    week: Column,
    change: Column,
    cuts: Mapping[int, tuple[float, float]] = IMPROVEMENT_CUTS,
    worsen_above: float = WORSEN_ABOVE,
    default: str = "Baseline",
) -> Column:
    """Level from a week and a relative change.

    A null change matches no rule and gets the default, as do weeks without
    cuts. Worsening is tested before the week.
    """
    out = F.when(change > worsen_above, "Worsen")
    for w, (upper, lower) in cuts.items():
        out = out.when((week == w) & change.isNotNull(), band(-change, [-upper, -lower], ["None", "Minimal", "Much"]))
    return out.otherwise(default)


def level_position(value: Column, order: Sequence[str]) -> Column:
    """Place of a level in a given display order, from 1."""
    ranks = F.create_map(*[F.lit(x) for i, level in enumerate(order, 1) for x in (level, i)])
    return F.try_element_at(ranks, value)
