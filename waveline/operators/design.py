"""Design matrices with treatment contrasts and interactions.

Rows travel to the Python workers as the few columns the terms name, and the
wide matrix (hundreds of products) exists only there, one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LEVELS = 5_000

Term = tuple[str, ...]


def crossed(*names: str) -> list[Term]:
    """All main effects and interactions of the named columns."""
    return [t for size in range(1, len(names) + 1) for t in combinations(names, size)]


def factor_levels(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted levels of each factor; the first one is the contrast base.

    Each level is a column of the design, whose products the driver holds, so
    more than ``max_levels`` are refused; nothing is left out.
    """
    out = {}
    for c in columns:
        found = df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_levels + 1).collect()
        if len(found) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels; fit it as an entity effect")
        out[c] = sorted(row[0] for row in found)
    return out


@dataclass(frozen=True)
class Design:
    """Terms of a linear predictor, without a formula language.

    ``levels`` names the factors. ``shift`` maps a numeric column to a centre
    and a scale that are applied before products are formed: a full factorial
    spans the same space either way, but products of centred columns are far
    better conditioned.
    """

    terms: tuple[Term, ...]
    levels: Mapping[str, Sequence] = field(default_factory=dict)
    shift: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    intercept: bool = True

    @classmethod
    def of(cls, terms: Sequence[Term | str], **options) -> Design:
        flat = [(t,) if isinstance(t, str) else tuple(t) for t in terms]
        unique = list(dict.fromkeys(flat))
        # Main effects come first, then interactions by their order.
        return cls(tuple(sorted(unique, key=len)), **options)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.terms for c in t))

    @property
    def names(self) -> list[str]:
        out = ["(Intercept)"] if self.intercept else []
        for term in self.terms:
            labels = [""]
            for c in term:
                own = [f"{c}{level}" for level in list(self.levels[c])[1:]] if c in self.levels else [c]
                labels = [f"{a}:{b}" if a else b for b in own for a in labels]
            out += labels
        return out

    def _basis(self, pdf: pd.DataFrame, c: str) -> np.ndarray:
        if c in self.levels:
            codes = pd.Categorical(pdf[c], categories=list(self.levels[c])).codes
            return (codes[:, None] == np.arange(1, len(self.levels[c]))[None, :]).astype(float)
        values = pdf[c].to_numpy(dtype=float)
        centre, scale = self.shift.get(c, (0.0, 1.0))
        return ((values - centre) / scale)[:, None]

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        """The design of one batch; every product extends a shorter one."""
        n = len(pdf)
        basis = {c: self._basis(pdf, c) for c in self.columns}
        known: dict[Term, np.ndarray] = {}
        # No inner function that names itself: such a cycle would keep the
        # products of many batches until the collector runs.
        for term in self.terms:
            for size in range(1, len(term) + 1):
                if term[:size] not in known:
                    right, left = basis[term[size - 1]], known.get(term[: size - 1])
                    known[term[:size]] = right if left is None else (right[:, :, None] * left[:, None, :]).reshape(n, -1)

        parts = [np.ones((n, 1))] if self.intercept else []
        return np.hstack(parts + [known[t] for t in self.terms])

    def complete(self, pdf: pd.DataFrame, *others: str) -> pd.DataFrame:
        """Rows without a missing value and with known factor levels."""
        keep = pdf[[*self.columns, *others]].notna().all(axis=1)
        for c, known in self.levels.items():
            if c in pdf.columns:
                keep &= pdf[c].isin(list(known))
        return pdf[keep]


def design_rows(df: DataFrame, design: Design, keep: Sequence[str], name: str = "x") -> DataFrame:
    """Rows with their design vector, keyed by the columns to keep."""
    columns = list(dict.fromkeys([*keep, *design.columns]))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = design.complete(pdf)
            out = pdf[list(keep)].copy()
            out[name] = list(design.matrix(pdf))
            yield out

    return df.select(columns).mapInPandas(build, schema)


def numeric_shift(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of each column, for ``Design.shift``."""
    row = df.agg(*[F.struct(F.avg(c), F.coalesce(F.stddev_pop(c), F.lit(0.0))).alias(c) for c in columns]).first()
    return {c: (row[c][0], row[c][1] or 1.0) for c in columns if row[c][0] is not None}
