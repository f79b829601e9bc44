"""Forecast of the score at a target day."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.functions.columns import prefix_range
from waveline.functions.scores import row_sum
from waveline.operators import lasso
from waveline.operators.align import actual_or_predicted, natural_left_join, nearest_visit
from waveline.operators.design import Design, factor_levels
from waveline.operators.ordered import OrderedBlocks, lag_lead
from waveline.operators.split import fold_of, split_rows
from waveline.sources.panel_csv import G_ITEMS, ITEMS, N_ITEMS, P_ITEMS, SCORE
from waveline.sources.store import stored

VISIT_KEY = ["PatientID", "VisitDay"]
TARGET_DAY = 126
TARGET_WEEK = 18


def baseline_items(visits: DataFrame) -> DataFrame:
    """Items and total of the day-0 visit, prefixed with ``Baseline``."""
    base = visits.where("VisitDay = 0").select("PatientID", *ITEMS)
    base = base.withColumn(f"Baseline{SCORE}", row_sum(ITEMS))
    return prefix_range(base, "P1", "G16", "Baseline")


def forecast_features(visits: DataFrame, scope: str = "table") -> DataFrame:
    """Visits with lag, lead and baseline scores and the visit number.

    Lags are filled up, leads and baselines down. In table scope all three
    cross from one patient to the next, see ``lag_lead``. ``visits`` has one
    row per patient and day.
    """
    scores = [*ITEMS, SCORE]
    base = baseline_items(visits)
    # The baseline is joined first: every ordered step then runs on one
    # partitioning of the rows.
    joined = stored(natural_left_join(visits.drop("SiteID", "RaterID"), base))
    blocks = lag_lead(OrderedBlocks.of(joined, VISIT_KEY), scores, "PatientID", scope)
    directions = {f"Lag{c}": "up" for c in scores}
    directions |= {f"Lead{c}": "down" for c in scores}
    directions |= {f"Baseline{c}": "down" for c in scores}
    blocks = blocks.fill(directions, None if scope == "table" else "PatientID")
    return blocks.ordinal("TreatmentWeek", "PatientID").frame()


# Items of the model (the last general item is left out), the
# share of training rows and the number of folds.
MODEL_ITEMS = [*P_ITEMS, *N_ITEMS, *G_ITEMS[:15]]
TRAIN_SHARE = 0.7
FOLDS = 10
MODEL_STUDY = "Study = 'E'"


def grid_penalties(count: int = 100, high: float = 10.0, low: float = -2.0) -> list[float]:
    """Powers of ten in equal steps of the exponent."""
    return [10 ** (high + (low - high) * i / (count - 1)) for i in range(count)]


def forecast_terms(items: Sequence[str] = MODEL_ITEMS) -> list:
    """Shared terms of the score model; the patient effect is added by the fit.

    The lead columns look ahead of the visit, as in the analysis this follows.
    """
    totals = [f"Baseline{SCORE}", f"Lag{SCORE}", f"Lead{SCORE}"]
    sides = [f"{side}{c}" for side in ("Lag", "Lead", "Baseline") for c in items]
    return ["Country", "TreatmentWeek", "TxGroup", ("TreatmentWeek", "TxGroup"), *totals, *sides]


@dataclass(frozen=True)
class ForecastModel:
    moments: lasso.EntityMoments
    points: list[lasso.PathPoint]
    best: lasso.PathPoint
    alpha: float


def split(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the study that is modelled."""
    return split_rows(features.where(MODEL_STUDY), "AssessmentID", TRAIN_SHARE)


def forecast_moments(features: DataFrame) -> lasso.EntityMoments:
    """The training rows, reduced to moments."""
    rows = features.where(MODEL_STUDY)
    design = Design.of(forecast_terms(), levels=factor_levels(rows, ["Country", "TxGroup"]))
    train = split(features)[0].withColumn("_fold", fold_of("AssessmentID", FOLDS, seed=5))
    # The contrast base is the first patient of all studies.
    base = features.agg(F.min("PatientID")).first()[0]
    return lasso.entity_moments(train, design, SCORE, "PatientID", base, "_fold", FOLDS)


def fit_forecast(features: DataFrame, alpha: float = 1.0, count: int = 100) -> ForecastModel:
    """Cross-validated lasso (``alpha=1``) or ridge (``alpha=0``) at all ``count`` penalties."""
    m = forecast_moments(features)
    top = 1.0 if alpha > 0 else 1000.0
    penalties = [p * top for p in lasso.default_penalties(m, count)]
    points = lasso.path(m, penalties, alpha)
    return ForecastModel(m, points, lasso.best_point(points), alpha)


def path_table(features: DataFrame, model: ForecastModel) -> DataFrame:
    """Penalty, share of variance explained and cross-validated error."""
    rows = [(i, p.penalty, float(p.explained), float(p.cv_mse), p.settled) for i, p in enumerate(model.points)]
    return features.sparkSession.createDataFrame(rows, "step int, penalty double, explained double, cv_mse double, settled boolean")


def predicted(rows: DataFrame, model: ForecastModel, keep: Sequence[str], name: str = "predicted") -> DataFrame:
    return lasso.predict(rows, model.moments, model.best, keep, name, model.alpha)


def holdout_rmse(features: DataFrame, model: ForecastModel) -> DataFrame:
    test = split(features)[1]
    return lasso.rmse(predicted(test, model, ["AssessmentID", SCORE]), "predicted", SCORE)


def target_rows(features: DataFrame) -> DataFrame:
    """The visit nearest to the target day, moved to that day."""
    near = nearest_visit(features.where(MODEL_STUDY), "PatientID", "VisitDay", TARGET_DAY, ["VisitDay"])
    return near.withColumn("VisitDay", F.lit(TARGET_DAY))


def target_forecast(features: DataFrame, model: ForecastModel) -> DataFrame:
    """Score per patient at the target: the actual one of that week, else the forecast.

    A patient with several visits in the week keeps them all.
    """
    actual = features.where(MODEL_STUDY).where(F.col("Week") == TARGET_WEEK).select("PatientID", SCORE)
    forecast = predicted(target_rows(features), model, ["PatientID"], SCORE)
    return actual_or_predicted(actual, forecast, "PatientID", SCORE).orderBy("PatientID")
