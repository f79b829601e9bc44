"""Least squares on triangular factors or moment matrices, coefficient tables and model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from waveline.functions.tails import f_upper, t_quantile, t_two_sided
from waveline.operators import tall_qr
from waveline.operators.design import Design


def independent_columns(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that are not a combination of the ones before them."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    rest = gram / np.outer(scale, scale)
    keep = []
    for j in range(len(rest)):
        if rest[j, j] > tolerance:
            keep.append(j)
            column = rest[:, j] / math.sqrt(rest[j, j])
            rest = rest - np.outer(column, column)
    return keep


@dataclass(frozen=True)
class LinearFit:
    names: list[str]
    kept: list[int]
    beta: np.ndarray
    errors: np.ndarray
    rss: float
    tss: float
    rows: int

    @property
    def residual_df(self) -> int:
        return self.rows - len(self.kept)

    def coefficients(self, confidence: float = 0.95) -> list[tuple]:
        """(term, estimate, se, t, p, low, high); aliased terms are null."""
        place = {j: i for i, j in enumerate(self.kept)}
        q = t_quantile(0.5 + confidence / 2, self.residual_df)
        out = []
        for j, name in enumerate(self.names):
            if j not in place:
                out.append((name, *[None] * 6))
                continue
            b, se = float(self.beta[place[j]]), float(self.errors[place[j]])
            t = b / se if se > 0 else math.inf
            out.append((name, b, se, t, t_two_sided(t, self.residual_df), b - q * se, b + q * se))
        return out

    def summary(self) -> tuple:
        """(rows, df, sigma, r2, adjusted r2, F, F df, p)."""
        df, model_df = self.residual_df, len(self.kept) - 1
        r2 = 1 - self.rss / self.tss
        sigma2 = self.rss / df
        f = (self.tss - self.rss) / model_df / sigma2 if model_df else 0.0
        adjusted = 1 - (1 - r2) * (self.rows - 1) / df
        return self.rows, df, math.sqrt(sigma2), r2, adjusted, f, model_df, f_upper(f, model_df, df)


def centred(products: np.ndarray) -> np.ndarray:
    """Products of the columns about their means."""
    n = products[0, 0]
    return products - np.outer(products[0], products[0]) / n


def solve(products: np.ndarray, names: Sequence[str]) -> LinearFit:
    """Fit from Z'Z with the intercept first and the response last.

    Columns are centred on the matrix before solving, which keeps the digits
    that a large intercept would cost.
    """
    n = products[0, 0]
    mean = products[0] / n
    about = centred(products)
    x, y = about[1:-1, 1:-1], about[1:-1, -1]
    kept = independent_columns(x)
    scale = np.sqrt(np.diag(x)[kept])
    inverse = np.linalg.inv(x[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
    slope = inverse @ y[kept]
    tss = float(about[-1, -1])
    rss = float(tss - 2 * slope @ y[kept] + slope @ x[np.ix_(kept, kept)] @ slope)
    m = mean[1:-1][kept]
    beta = np.concatenate([[mean[-1] - m @ slope], slope])
    rows = int(round(n))
    left = rows - len(kept) - 1
    # A fit with no rows left over has no error estimate.
    sigma2 = rss / left if left > 0 else math.nan
    errors = np.sqrt(sigma2 * np.concatenate([[1 / n + m @ inverse @ m], np.diag(inverse)]))
    return LinearFit(list(names), [0, *[k + 1 for k in kept]], beta, errors, rss, tss, rows)


def solve_factor(factor: np.ndarray, names: Sequence[str]) -> LinearFit:
    """Fit from the triangular factor of Z, with the intercept first and the response last."""
    x, y = factor[:, :-1], factor[:, -1]
    kept = tall_qr.independent_columns(x)
    q, r = np.linalg.qr(x[:, kept])
    beta = np.linalg.solve(r, q.T @ y)
    residual = y - x[:, kept] @ beta
    rss, rows = float(residual @ residual), int(round(factor[0, 0] ** 2))
    # The first row holds the share of the intercept.
    tss = float(factor[1:, -1] @ factor[1:, -1])
    left = rows - len(kept)
    sigma2 = rss / left if left > 0 else math.nan
    errors = np.sqrt(sigma2 * np.sum(np.linalg.inv(r) ** 2, axis=1))
    return LinearFit(list(names), kept, beta, errors, rss, tss, rows)


def fit(df: DataFrame, design: Design, response: str) -> LinearFit:
    """Ordinary least squares in one pass over the data."""
    return fit_by(df, design, response, None)[""]


def fit_by(df: DataFrame, design: Design, response: str, by: str | None) -> dict[str, LinearFit]:
    """One fit per value of a grouping column, in one pass."""
    factors = tall_qr.triangular_factors(df, design, response, by)
    return {g: solve_factor(r, design.names) for g, r in sorted(factors.items())}


def coefficient_table(spark: SparkSession, fits: dict[str, LinearFit]) -> DataFrame:
    rows = [(model, *c) for model, f in fits.items() for c in f.coefficients()]
    return spark.createDataFrame(
        rows, "model string, term string, estimate double, std_error double, t double, p double, low double, high double"
    )


def summary_table(spark: SparkSession, fits: dict[str, LinearFit]) -> DataFrame:
    rows = [(model, *f.summary()) for model, f in fits.items()]
    return spark.createDataFrame(
        rows,
        "model string, rows long, res_df long, sigma double, r2 double, adj_r2 double, f double, f_df long, p double",
    )


def compare(spark: SparkSession, fits: dict[str, LinearFit]) -> DataFrame:
    """Analysis of variance of several fits in the given order.

    The error scale comes from the fit with the fewest residual degrees of
    freedom. All fits must be on the same rows.
    """
    if len({f.rows for f in fits.values()}) > 1:
        raise ValueError("the models were fitted to different numbers of rows")
    largest = min(fits.values(), key=lambda f: f.residual_df)
    scale = largest.rss / largest.residual_df
    rows, before = [], None
    for model, f in fits.items():
        step = (None, None, None, None)
        if before is not None:
            df, gain = before.residual_df - f.residual_df, before.rss - f.rss
            ratio = gain / df / scale if df else None
            p = f_upper(ratio, abs(df), largest.residual_df) if ratio is not None else None
            step = (df, gain, ratio, p)
        rows.append((model, f.residual_df, f.rss, *step))
        before = f
    return spark.createDataFrame(
        rows, "model string, res_df long, rss double, df long, sum_sq double, f double, p double"
    )
