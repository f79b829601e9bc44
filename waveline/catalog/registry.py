"""Registration of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waveline.plans.prepare import one_visit_per_day
from waveline.sources.store import StoredTable
from waveline.sources.testdata import raw_panel

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if there is one, its SQL twin."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_TABLES: dict[tuple[str, str, str], StoredTable] = {}


def _key(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, sf_dir, name


def shared_table(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: str | None = None,
) -> DataFrame:
    """A table that several queries read, written once per application."""
    key = _key(spark, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = StoredTable.write(build(), partition_by)
    return _TABLES[key].read(spark)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assessments; same-day repeats are kept."""
    return shared_table(spark, sf_dir, "panel", lambda: raw_panel(spark, sf_dir), "Study")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assessment per patient and day.

    They are taken from the stored panel where another query has written it;
    for visits alone its rows need not be written and read first. Days of one
    patient go to many tasks, or the join by patient would settle who does them.
    """

    def build() -> DataFrame:
        if _key(spark, sf_dir, "panel") in _TABLES:
            return one_visit_per_day(panel(spark, sf_dir))
        return one_visit_per_day(raw_panel(spark, sf_dir).repartition("PatientID", "VisitDay"))

    return shared_table(spark, sf_dir, "visits", build, "Study")
