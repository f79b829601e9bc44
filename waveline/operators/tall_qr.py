"""Triangular factors of tall designs.

Products of columns square the condition of a fit. A triangular factor R with
R'R = Z'Z does not: every task reduces its rows to a factor, batch by batch, and
factors are merged the same way, in tasks first and at last on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.operators.design import Design

#: Factors that reach the driver, per group, at most.
LAST_FACTORS = 64
_FACTOR = "group string, bucket int, row array<double>"


def stacked(above: np.ndarray | None, below: np.ndarray) -> np.ndarray:
    """The factor of rows on top of each other."""
    return np.linalg.qr(below if above is None else np.vstack([above, below]), mode="r")


def _table(factors: dict[str, np.ndarray], bucket: int) -> pd.DataFrame:
    rows = [(group, bucket, list(row)) for group, factor in factors.items() for row in factor]
    return pd.DataFrame(rows, columns=["group", "bucket", "row"])


def triangular_factors(df: DataFrame, design: Design, response: str, by: str | None = None) -> dict[str, np.ndarray]:
    """The factor of [design, response] per value of ``by``; rows with a missing value are left out."""
    columns = list(dict.fromkeys([*design.columns, response, *([by] if by else [])]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            pdf = design.complete(pdf, response)
            if not len(pdf):
                continue
            z = np.column_stack([design.matrix(pdf), pdf[response].to_numpy(dtype=float)])
            keys = pdf[by].astype(str).to_numpy() if by else np.full(len(pdf), "")
            for key in pd.unique(keys):
                held[key] = stacked(held.get(key), z[keys == key])
        yield _table(held, TaskContext.get().partitionId() % LAST_FACTORS)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return _table({pdf["group"].iloc[0]: stacked(None, np.stack(pdf["row"]))}, int(pdf["bucket"].iloc[0]))

    factors = df.select(columns).mapInPandas(partial, _FACTOR).groupBy("group", "bucket").applyInPandas(merged, _FACTOR)
    out: dict[str, np.ndarray] = {}
    # LAST_FACTORS small triangles a group.
    for row in factors.groupBy("group").agg(F.flatten(F.collect_list("row")).alias("rows")).collect():
        out[row.group] = stacked(None, np.array(row.rows).reshape(-1, len(design.names) + 1))
    return out


def independent_columns(factor: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that are not a combination of the ones before them, judged by lengths and not by squares."""
    length = np.linalg.norm(factor, axis=0)
    rest, keep = factor / np.where(length > 0, length, 1.0), []
    for j in range(rest.shape[1]):
        left = float(np.linalg.norm(rest[:, j]))
        if left > tolerance:
            keep.append(j)
            unit = rest[:, j] / left
            rest = rest - np.outer(unit, unit @ rest)
    return keep
