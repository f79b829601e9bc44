"""Treatment effect models, trends and degree sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.operators import ols
from waveline.operators.design import Design, crossed, factor_levels, numeric_shift
from waveline.operators.moments import collect_matrices, cross_products, summed_matrices
from waveline.operators.split import split_rows
from waveline.sources.panel_csv import ITEMS, SCORE

EFFECT_TERMS = {
    "study_group_baseline": crossed("Study", "TxGroup", "BaselinePANSS"),
    "study_group": crossed("Study", "TxGroup"),
    "baseline_group": crossed("BaselinePANSS", "TxGroup"),
}


def effect_design(data: DataFrame, model: str, levels: dict | None = None) -> Design:
    levels = levels or factor_levels(data, ["Study", "TxGroup"])
    terms = EFFECT_TERMS[model]
    named = {c for t in terms for c in t}
    return Design.of(terms, levels={c: v for c, v in levels.items() if c in named})


def effect_models(data: DataFrame) -> dict[str, ols.LinearFit]:
    """The three nested regressions of the score, one pass each.

    ``data`` should be a stored table.
    """
    levels = factor_levels(data, ["Study", "TxGroup"])
    return {m: ols.fit(data, effect_design(data, m, levels), SCORE) for m in EFFECT_TERMS}


def effect_comparison(data: DataFrame) -> DataFrame:
    """Analysis of variance from the smallest model to the largest."""
    fits = effect_models(data)
    order = ["baseline_group", "study_group", "study_group_baseline"]
    return ols.compare(data.sparkSession, {m: fits[m] for m in order})


def with_powers(df: DataFrame, column: str, degree: int) -> DataFrame:
    return df.withColumns({f"{column}_{d}": F.pow(column, F.lit(d)) for d in range(1, degree + 1)})


def polynomial_trend(df: DataFrame, by: str, x: str, y: str, degree: int) -> DataFrame:
    """Polynomial coefficients per group, from one pass over all groups.

    The column is divided by its largest value before taking powers, and the
    coefficients are scaled back.
    """
    top = float(df.agg(F.max(F.abs(x))).first()[0] or 1.0)
    scaled = with_powers(df.select(by, y, (F.col(x) / top).alias(x)), x, degree)
    design = Design.of([f"{x}_{d}" for d in range(1, degree + 1)])
    rows = []
    for group, fitted in ols.fit_by(scaled, design, y, by).items():
        for power, c in enumerate(fitted.coefficients()):
            rows.append((group, power, None if c[1] is None else c[1] / top**power))
    return df.sparkSession.createDataFrame(rows, f"{by} string, power int, estimate double")


def pure_power_trend(df: DataFrame, by: str, x: str, y: str, powers: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """One straight-line fit on each power of a column, per group."""
    full = with_powers(df.select(by, y, x), x, max(powers))
    names = [f"{x}_{p}" for p in powers]
    # One pass has the products of all powers; each line reads its own.
    products = collect_matrices(cross_products(full, Design.of(names), y, by))
    rows = []
    for i, p in enumerate(powers):
        pick = [0, 1 + i, 1 + len(powers)]
        for g, m in sorted(products.items()):
            c = ols.solve(m[pick][:, pick], ["(Intercept)", names[i]]).coefficients()
            rows.append((g, p, c[0][1], c[1][1]))
    return df.sparkSession.createDataFrame(rows, f"{by} string, power int, intercept double, slope double")


BASE_TOTAL = f"Baseline{SCORE}"
BASE_ITEMS = [f"Baseline{c}" for c in ITEMS]


#: Share of a column that must be its own, in squares, to be sure that it is.
SURE_PIVOT = 1e-6


def _polynomial_moments(rows: DataFrame, x: str, y: str, degrees: int, crossed_terms: Design, sides: Design) -> dict[str, np.ndarray]:
    """Per part, sums of T_s(x) e e' for s = 0 .. 2 * degrees, with e = [crossed terms, sides, response].

    A product of two Chebyshev polynomials is the mean of two others, so these
    blocks hold every product of columns T_p(x) e of all degrees.
    """

    def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        pdf = sides.complete(crossed_terms.complete(pdf, x, y), x, y)
        e = np.column_stack([crossed_terms.matrix(pdf), sides.matrix(pdf), pdf[y].to_numpy(dtype=float)])
        t = chebvander(pdf[x].to_numpy(dtype=float), 2 * degrees)
        parts = pdf["_part"].to_numpy()
        return {p: np.vstack([(e[parts == p] * t[parts == p, s, None]).T @ e[parts == p] for s in range(2 * degrees + 1)]) for p in pd.unique(parts)}

    sums = collect_matrices(summed_matrices(rows, blocks))
    return {p: m.reshape(2 * degrees + 1, m.shape[1], m.shape[1]) for p, m in sums.items()}


def degree_sweep(
    features: DataFrame,
    degrees: int = 10,
    share: float = 0.5,
    bases: Sequence[str] = (BASE_TOTAL,),
    factors: Sequence[str] = (),
) -> DataFrame:
    """Train and test RMSE of polynomial models in the visit number.

    The powers and the treatment are crossed with each of ``bases``;
    ``factors`` are added as they are. Powers up to a degree span the same
    columns as the Chebyshev polynomials up to it, which are far better
    conditioned. One pass over the rows serves all degrees. Errors are null where
    no row is left over, or where sums of products cannot tell whether a column
    adds anything (about as many columns as rows).
    """
    x, y = "TreatmentWeek", SCORE
    rows = features.select("AssessmentID", x, "TxGroup", *bases, *factors, y)
    low, high, mean = rows.agg(F.min(x), F.max(x), F.avg(y)).first()
    if low is None:
        return features.sparkSession.createDataFrame([], "degree int, train_rmse double, test_rmse double")
    rows = rows.withColumns({x: (2 * F.col(x) - (low + high)) / float(high - low or 1), y: F.col(y) - mean})
    levels = factor_levels(rows, ["TxGroup", *factors])
    shift = numeric_shift(rows, bases)
    crossed_terms = Design.of([*bases, "TxGroup"], levels={"TxGroup": levels["TxGroup"]}, shift=shift)
    sides = Design.of([*(("TxGroup", b) for b in bases), *factors], levels=levels, shift=shift, intercept=False)
    train, test = split_rows(rows, "AssessmentID", share)
    both = train.withColumn("_part", F.lit("train")).unionByName(test.withColumn("_part", F.lit("test")))
    moments = _polynomial_moments(both, x, y, degrees, crossed_terms, sides)

    # Column (p, i) of the largest design is T_p(x) times e_i; the response comes last.
    wide, last = len(crossed_terms.names), len(crossed_terms.names) + len(sides.names)
    place = [(0, i) for i in range(last)] + [(p, i) for p in range(1, degrees + 1) for i in range(wide)] + [(0, last)]
    power, index = np.array(place).T
    at = index[:, None], index[None, :]
    products = {k: (m[power[:, None] + power, *at] + m[np.abs(power[:, None] - power), *at]) / 2 for k, m in moments.items()}
    out = []
    for degree in range(1, degrees + 1):
        pick = np.flatnonzero(power <= degree)
        small = {k: m[np.ix_(pick, pick)] for k, m in products.items()}
        fitted = ols.solve(small["train"], [str(i) for i in pick[:-1]])
        centred = ols.centred(small["train"])[1:-1, 1:-1]
        if len(ols.independent_columns(centred, SURE_PIVOT)) + 1 < len(fitted.kept) or fitted.residual_df <= 0:
            out.append((degree, None, None))
            continue
        weights = np.zeros(len(pick))
        weights[fitted.kept] = -fitted.beta
        weights[-1] = 1.0
        # Residual sum of squares as a quadratic form of the products.
        errors = {k: (max(float(weights @ m @ weights), 0.0) / m[0, 0]) ** 0.5 for k, m in small.items()}
        out.append((degree, float(errors["train"]), float(errors.get("test", float("nan")))))
    return features.sparkSession.createDataFrame(out, "degree int, train_rmse double, test_rmse double")


def degree_sweeps(features: DataFrame, degrees: int = 10, share: float = 0.5) -> DataFrame:
    """The sweep with country, baseline items and total, and the one with the total alone."""
    wide = degree_sweep(features, degrees, share, [BASE_TOTAL, *BASE_ITEMS], ["Country"])
    small = degree_sweep(features, degrees, share)
    return wide.select(F.lit("items").alias("model"), "*").unionByName(small.select(F.lit("total").alias("model"), "*"))
