"""Sums of squares and products in one pass.

Each task adds up its batches into one small matrix per group; Spark sums the
matrices row by row. Only p x p numbers per group reach the driver, however
many rows there are and however they are spread over groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveline.operators.design import Design

SUMS = T.StructType(
    [
        T.StructField("group", T.StringType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("row", T.ArrayType(T.DoubleType())),
    ]
)

#: Rows of a batch that are made wide together, so that a task's memory hangs on the columns only.
ROWS_AT_ONCE = 1_024
#: Narrow designs take more rows together, up to so many numbers.
CELLS_AT_ONCE = 256 * ROWS_AT_ONCE

Blocks = Callable[[pd.DataFrame], dict[str, np.ndarray]]


def pieces(batches: Iterator[pd.DataFrame], rows: int = ROWS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """Batches in pieces of at most so many rows; an empty batch is a piece."""
    for pdf in batches:
        for first in range(0, max(len(pdf), 1), rows):
            yield pdf.iloc[first : first + rows]


def summed_matrices(df: DataFrame, blocks: Blocks, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Sum the matrices that ``blocks`` makes of each batch, per group.

    The result has one row per group and matrix row.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for pdf in pieces(batches, at_once):
            for group, matrix in blocks(pdf).items():
                if group in totals:
                    totals[group] += matrix
                else:
                    totals[group] = matrix.astype(float)
        for group, matrix in totals.items():
            yield pd.DataFrame({"group": group, "i": np.arange(len(matrix), dtype=np.int32), "row": list(matrix)})

    rows = df.mapInPandas(partial, SUMS)
    total = Summarizer.sum(array_to_vector("row"))
    return rows.groupBy("group", "i").agg(vector_to_array(total).alias("row"))


def collect_matrices(sums: DataFrame) -> dict[str, np.ndarray]:
    """The matrices per group on the driver; they are small by construction."""
    table = sums.toArrow().combine_chunks()
    if table.num_rows == 0:
        return {}
    groups = np.array(table["group"].to_pylist())
    rows = table["row"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    order = np.argsort(table["i"].to_numpy(), kind="stable")
    return {str(g): rows[order[groups[order] == g]] for g in np.unique(groups)}


def cross_products(df: DataFrame, design: Design, response: str, by: str | None = None) -> DataFrame:
    """Rows of Z'Z for Z = [design, response], per value of ``by``.

    Rows with a missing value are left out.
    """
    columns = list(dict.fromkeys([*design.columns, response, *([by] if by else [])]))

    def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        pdf = design.complete(pdf, response)
        z = np.column_stack([design.matrix(pdf), pdf[response].to_numpy(dtype=float)])
        if by is None:
            return {"": z.T @ z}
        keys = pdf[by].astype(str).to_numpy()
        return {k: z[keys == k].T @ z[keys == k] for k in pd.unique(keys)}

    return summed_matrices(df.select(columns), blocks, max(ROWS_AT_ONCE, CELLS_AT_ONCE // (len(design.names) + 1)))


def product_table(sums: DataFrame, names: list[str]) -> DataFrame:
    """The sums as rows of (term, other, value)."""
    labels = F.array(*[F.lit(n) for n in names])
    return sums.select("group", F.get(labels, F.col("i")).alias("term"), F.posexplode("row").alias("j", "value")).select(
        "group", "term", F.get(labels, F.col("j")).alias("other"), "value"
    )
