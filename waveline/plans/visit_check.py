"""Classification of assessments as passed or not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.functions.columns import uniform
from waveline.functions.scores import (
    change_flag,
    composite,
    many_flags,
    rising,
    row_spread,
    threshold_class,
    two_way,
)
from waveline.operators import logistic
from waveline.operators.design import Design, crossed, factor_levels, numeric_shift
from waveline.operators.logistic import PenalisedPath
from waveline.operators.ordered import OrderedBlocks
from waveline.operators.split import fold_of, split_rows
from waveline.sources.panel_csv import ITEMS, N_ITEMS, P_ITEMS, VISIT_ORDER

# Limits of the flags.
LEVEL_LIMITS = {
    "FlagDelusion": ("P1", 3),
    "FlagHallucination": ("P3", 3),
    "FlagGrandiosity": ("P5", 3),
    "FlagMannerisms": ("G5", 2),
}
SPREAD_LIMIT = 2
JUMP_LIMIT = 5


def table_spread(df: DataFrame, columns: list[str]) -> Column:
    """Largest less smallest value of all rows together, as a scalar subquery."""
    complete = F.count(F.lit(1)) == F.count(F.when(row_spread(columns).isNotNull(), 1))
    spread = F.max(F.greatest(*columns)) - F.min(F.least(*columns))
    return df.agg(F.when(complete, spread).alias("spread")).scalar()


def with_neighbour_scores(blocks: OrderedBlocks, scope: str = "table") -> OrderedBlocks:
    """Lag, lead, change and change flag of every item and of the composite.

    Lags, leads and changes without a neighbour are 0. The change is taken
    before that, so a first visit has change 0 and not its own value.
    """
    blocks = blocks.with_columns({"CompositeScore": composite(N_ITEMS, P_ITEMS)})
    near = blocks.neighbours(["PatientID", *ITEMS, "CompositeScore"])

    def neighbour(side: str, c: str) -> Column:
        value = F.col(side)[c]
        if scope == "table":
            return value
        return F.when(F.col(side)["PatientID"].eqNullSafe(F.col("PatientID")), value)

    zero = F.lit(0)
    out = {}
    for c in [*ITEMS, "CompositeScore"]:
        out[f"Lag{c}"] = F.coalesce(neighbour("_before", c), zero)
        out[f"Lead{c}"] = F.coalesce(neighbour("_after", c), zero)
    for c in ITEMS:
        out[f"Change{c}"] = F.coalesce(F.col(c) - neighbour("_before", c), zero)
    df = near.df.withColumns(out).drop("_before", "_after")
    return near.then(df.withColumns({f"FlagChange{c}": change_flag(f"Change{c}") for c in ITEMS}))


def with_flags(df: DataFrame, spread: str = "table", whole: DataFrame | None = None) -> DataFrame:
    """Flags of one assessment.

    ``spread="table"`` compares the item range of the whole table with the
    limit, ``"row"`` that of each assessment. ``whole`` has the items of the
    same assessments where ``df`` is dear to work out for the range alone.
    """
    whole = df if whole is None else whole
    span = (lambda items: table_spread(whole, items)) if spread == "table" else row_spread
    out = {
        "FlagInconsistentP": span(P_ITEMS) > SPREAD_LIMIT,
        "FlagInconsistentN": span(N_ITEMS) > SPREAD_LIMIT,
        "FlagInconsistentComposite": F.col("CompositeScore") - F.col("LagCompositeScore") > JUMP_LIMIT,
        "FlagUnusualOutcome": rising("CompositeScore", "LagCompositeScore", "LeadCompositeScore"),
        "FlagInconsistentMeasure": many_flags([f"FlagChange{c}" for c in ITEMS]),
    }
    out |= {name: F.col(item) >= limit for name, (item, limit) in LEVEL_LIMITS.items()}
    return df.withColumns(out)


def check_features(panel: DataFrame, scope: str = "table", spread: str = "table") -> DataFrame:
    """Assessments with neighbour scores, flags, label and visit number.

    Same-day repeats are kept. ``panel`` should be a stored table.
    """
    blocks = OrderedBlocks.of(panel, VISIT_ORDER).ordinal("TreatmentWeek", "PatientID")
    df = with_flags(with_neighbour_scores(blocks, scope).frame(), spread, panel)
    label = two_way("LeadStatus", "Passed", "P", "NP")
    return df.withColumn("LeadStatus", label).drop("SiteID", "RaterID")


# Items of the interaction, flags of the model, and the cuts.
CROSSED_ITEMS = ["P1", "P3", "P5", "G5", "LagP1", "LagP3", "LagP5", "LagG5"]
MODEL_FLAGS = [
    "FlagInconsistentComposite",
    "FlagDelusion",
    "FlagHallucination",
    "FlagGrandiosity",
    "FlagMannerisms",
    "FlagUnusualOutcome",
    "FlagInconsistentMeasure",
]
CHANGE_FLAG_ITEMS = [*P_ITEMS, *N_ITEMS]
PASS_CUT = 0.8
LIKELIER = 0.5
TEST_SHARE = 0.5
LABEL_STUDIES = "Study <> 'E'"
TARGET_STUDY = "Study = 'E'"


def check_terms() -> list:
    flags = [f"FlagChange{c}" for c in CHANGE_FLAG_ITEMS]
    return [*crossed("TxGroup", "TreatmentWeek"), *crossed(*CROSSED_ITEMS), *MODEL_FLAGS, *flags]


def check_design(rows: DataFrame) -> Design:
    """Design of the pass model, with centred items (see ``Design.shift``)."""
    return Design.of(
        check_terms(),
        levels=factor_levels(rows, ["TxGroup"]),
        shift=numeric_shift(rows, ["TreatmentWeek", *CROSSED_ITEMS]),
    )


def labelled_rows(checks: DataFrame) -> DataFrame:
    """Assessments of the labelled studies with a 0/1 response."""
    return checks.where(LABEL_STUDIES).withColumn("passed", (F.col("LeadStatus") == "P").cast("int"))


def accuracy(scored: DataFrame, predicted: str, actual: str) -> DataFrame:
    return scored.agg(F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))


def accuracies(checks: DataFrame, seed: int = 2) -> DataFrame:
    """Share of right classes on train and test rows, and of a random draw.

    The fit reads the stored feature table once per step. The random class
    is drawn per row of the train part.
    """
    rows = labelled_rows(checks)
    test, train = split_rows(rows, "AssessmentID", TEST_SHARE, seed)
    model = logistic.fit(train, check_design(rows), "passed")
    keep = ["AssessmentID", "LeadStatus"]
    out = None
    for name, part in (("train", train), ("test", test)):
        scored = logistic.predict(part, model, keep)
        scored = scored.withColumn("class", threshold_class("probability", PASS_CUT))
        row = accuracy(scored, "class", "LeadStatus").select(F.lit(name).alias("part"), "accuracy")
        out = row if out is None else out.unionByName(row)
    draw = random_classes(train, "AssessmentID", seed + 1)
    return out.unionByName(accuracy(draw, "class", "LeadStatus").select(F.lit("random").alias("part"), "accuracy"))


def random_classes(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A class per row from a uniform draw, as a baseline."""
    return rows.withColumn("class", threshold_class(uniform(F.col(key), seed), PASS_CUT))


def pass_probabilities(checks: DataFrame) -> DataFrame:
    """Pass probability of each assessment of the target study.

    The model is fitted to all labelled rows.
    """
    rows = labelled_rows(checks)
    model = logistic.fit(rows, check_design(rows), "passed")
    scored = logistic.predict(checks.where(TARGET_STUDY), model, ["AssessmentID"])
    return scored.withColumnRenamed("probability", "LeadStatus")


def given_probability(intercept: float, weights: dict[str, float]) -> Column:
    """Probability from known coefficients, without leaving the JVM."""
    eta = sum((F.col(c) * w for c, w in weights.items()), F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-eta))


# Folds of the penalised fits.
PENALTY_FOLDS = 10


def penalised_check(checks: DataFrame, alpha: float, count: int = 100, seed: int = 2) -> PenalisedPath:
    """Cross-validated logistic regression with an L1 (1) or L2 (0) penalty.

    Folds come from the row key, so a repeated run sees the same folds.
    """
    rows = labelled_rows(checks)
    train = split_rows(rows, "AssessmentID", TEST_SHARE, seed)[1]
    train = train.withColumn("_fold", fold_of("AssessmentID", PENALTY_FOLDS, seed + 4))
    return logistic.penalised_path(train, check_design(rows), "passed", alpha, "_fold", count=count)


def penalised_probabilities(rows: DataFrame, path: PenalisedPath) -> DataFrame:
    """Pass probability of each assessment under the best penalised model."""
    return logistic.predict(rows, path.best_fit(), ["AssessmentID"])


def penalised_classes(checks: DataFrame, path: PenalisedPath, seed: int = 2) -> DataFrame:
    """The test rows with the likelier class under the best penalised model."""
    test = split_rows(labelled_rows(checks), "AssessmentID", TEST_SHARE, seed)[0]
    scored = logistic.predict(test, path.best_fit(), ["AssessmentID", "LeadStatus"])
    return scored.withColumn("class", threshold_class("probability", LIKELIER))
