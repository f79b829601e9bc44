"""From study files to the cleaned panel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from waveline.operators.combine import first_per_key, merge_all, stack
from waveline.sources.panel_csv import TIES, with_week


def combine_studies(frames: Sequence[DataFrame], mode: str = "stack") -> DataFrame:
    """One table of all studies with the running week.

    ``stack`` is right when a column such as the study name separates the
    files; ``merge`` joins rows that agree in every common column.
    """
    if mode == "stack":
        combined = stack(frames)
    elif mode == "merge":
        combined = reduce(merge_all, frames)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return with_week(combined)


def one_visit_per_day(panel: DataFrame, entity: str = "PatientID", day: str = "VisitDay") -> DataFrame:
    """Keep the first of several assessments of a patient on one day."""
    order = [c for c in TIES if c in panel.columns]
    return first_per_key(panel, [entity, day], order)
