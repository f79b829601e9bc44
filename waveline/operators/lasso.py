"""Lasso and ridge paths with one effect per entity.

The design has a few hundred shared columns and one indicator per entity
(patient), of which there may be any number. Indicators do not overlap, so
for given shared coefficients each entity's effect has a closed form. What is
left is a problem in the shared columns alone. It needs the products of the
shared columns (one small matrix per fold) and, per entity and fold, the sums
of its rows. Both come from the data once. While the table of entity sums is
small, each fold walks the whole path in a task of its own; a larger table
stays where it is, and all penalties and folds share each pass over it.

With N rows, the objective is

    RSS / 2N + lambda * (alpha * sum s|b| + (1 - alpha) / 2 * sum (s b)^2)

where s is the standard deviation (1/N) of a column in the training rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveline.operators.design import Design
from waveline.operators.moments import collect_matrices, cross_products, pieces, summed_matrices
from waveline.operators.path_rounds import curvature, fit_paths, slopes
from waveline.operators.path_steps import PathFit, answer, entity_effects_at, fit_path, scales, start
from waveline.sources.store import stored

ALL_ROWS = -1
#: A table of entity sums of at most so many numbers may go to one task per fold.
NUMBERS_IN_TASK = 8_000_000
#: The fits of a larger table start from those of entities with about so many numbers.
NUMBERS_TO_START = 4_000_000
#: Entities whose sums are unpacked together.
ENTITIES_AT_ONCE = 1_000


def rmse(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Root of the mean squared difference of two columns."""
    return rows.agg(F.sqrt(F.avg(F.pow(F.col(predicted) - F.col(actual), F.lit(2.0)))).alias("rmse"))


@dataclass(frozen=True)
class EntityMoments:
    """What the data is reduced to before any fitting."""

    design: Design
    entity: str
    base: object
    folds: int
    products: dict[int, np.ndarray]
    sums: DataFrame
    #: The moments of about one in so many entities, each with all its rows.
    subset: Callable[[int], EntityMoments | None] | None = None

    def training(self, left_out: int) -> np.ndarray:
        total = sum(self.products.values())
        return total if left_out == ALL_ROWS else total - self.products.get(left_out, 0.0)


def _products(rows: DataFrame, design: Design, response: str, fold: str) -> dict[int, np.ndarray]:
    return {int(k): v for k, v in collect_matrices(cross_products(rows, design, response, fold)).items()}


def entity_moments(
    rows: DataFrame, design: Design, response: str, entity: str, base: object, fold: str, folds: int
) -> EntityMoments:
    """Products per fold, and sums per entity and fold as a stored table.

    Batches are added up per entity and fold before the shuffle, so a hot
    entity costs a row per task. ``base`` is the entity without an indicator.
    """
    products = _products(rows, design, response, fold)
    columns = list(dict.fromkeys([entity, fold, response, *design.columns]))
    key = rows.schema[entity].dataType

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = design.complete(pdf, response, entity, fold)
            if len(pdf) == 0:
                continue
            z = np.column_stack([design.matrix(pdf), pdf[response].to_numpy(dtype=float)])
            place = pdf.groupby([entity, fold], sort=False).ngroup().to_numpy()
            order = np.argsort(place, kind="stable")
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            heads = pdf.iloc[order[starts]]
            yield pd.DataFrame(
                {
                    "entity": heads[entity].to_numpy(),
                    "fold": heads[fold].to_numpy(),
                    "sums": list(np.add.reduceat(z[order], starts, axis=0)),
                }
            )

    schema = T.StructType(
        [
            T.StructField("entity", key),
            T.StructField("fold", T.IntegerType()),
            T.StructField("sums", T.ArrayType(T.DoubleType())),
        ]
    )
    total = vector_to_array(Summarizer.sum(array_to_vector("sums")))
    per_fold = rows.select(columns).mapInPandas(partial, schema).groupBy("entity", "fold").agg(total.alias("sums"))
    # At most one element per fold and entity.
    grouped = per_fold.groupBy("entity").agg(F.collect_list(F.struct("fold", "sums")).alias("parts"))
    table = grouped.select(
        "entity",
        F.col("parts.fold").alias("folds"),
        F.flatten("parts.sums").alias("sums"),
        F.coalesce(F.col("entity") == F.lit(base), F.lit(False)).alias("is_base"),
    )
    # The steps are bound by arithmetic and not by bytes, so the table keeps
    # one file per shuffle partition.
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = stored(table.repartition(partitions, "entity"))

    def subset(buckets: int) -> EntityMoments | None:
        def chosen(column: str) -> Column:
            return F.pmod(F.xxhash64(column), F.lit(buckets)) == 0

        some = _products(rows.where(chosen(entity)), design, response, fold)
        return EntityMoments(design, entity, base, folds, some, sums.where(chosen("entity"))) if some else None

    return EntityMoments(design, entity, base, folds, products, sums, subset)


@dataclass(frozen=True)
class _Numbers:
    """What tasks need of the moments, without the table."""

    design: Design
    folds: int
    products: dict[int, np.ndarray]
    training = EntityMoments.training

    @classmethod
    def of(cls, m: EntityMoments) -> _Numbers:
        return cls(m.design, m.folds, m.products)


def _unpack(pdf: pd.DataFrame, folds: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums as (entity, fold, column), and their total over folds."""
    lengths = pdf["folds"].map(len).to_numpy()
    cube = np.zeros((len(pdf), folds, width))
    if len(pdf):
        row = np.repeat(np.arange(len(pdf)), lengths)
        cube[row, np.concatenate(pdf["folds"].to_list())] = np.concatenate(pdf["sums"].to_list()).reshape(-1, width)
    return cube, cube.sum(axis=1)


def largest_penalty(m: EntityMoments) -> float:
    """The smallest penalty at which every effect is zero."""
    products = m.training(ALL_ROWS)
    n, mean = products[0, 0], products[0, -1] / products[0, 0]
    s = scales(products)
    pull = np.abs(products[:-1, -1] - mean * products[:-1, 0])
    shared = float(np.max(np.divide(pull, n * s, out=np.zeros_like(pull), where=s > 0)))
    width, folds = len(products), m.folds

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (piece for batch in batches for piece in _pieces(batch)):
            _, total = _unpack(pdf, folds, width)
            share = total[:, 0] / n
            spread = n * np.sqrt(np.maximum(share * (1 - share), 1e-300))
            size = np.abs(total[:, -1] - mean * total[:, 0]) / spread
            yield pd.DataFrame({"top": np.where(pdf["is_base"], 0.0, size)})

    entities = m.sums.select("folds", "sums", "is_base").mapInPandas(top, "top double").agg(F.max("top")).first()[0]
    return max(shared, entities or 0.0)


def default_penalties(m: EntityMoments, count: int = 100) -> list[float]:
    """Log-spaced penalties down from the largest useful one."""
    top = largest_penalty(m)
    columns = len(m.design.names) - 1 + m.sums.count()
    ratio = 1e-4 if m.training(ALL_ROWS)[0, 0] > columns else 1e-2
    return [float(v) for v in np.geomspace(top, top * ratio, count)]


@dataclass(frozen=True)
class PathPoint:
    """``violation`` is the largest one of an optimality condition, in standard deviations of the response, over all folds."""

    penalty: float
    theta: np.ndarray
    explained: float
    cv_mse: float | None
    settled: bool
    violation: float


def _unpacked(m: EntityMoments | _Numbers, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums per entity and fold, their totals, and which entity has no indicator."""
    return *_unpack(pdf, m.folds, len(m.design.names) + 1), pdf["is_base"].to_numpy(dtype=bool)


def _split(cube: np.ndarray, total: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sums of the training rows and of those left out."""
    held = None if left_out == ALL_ROWS else cube[:, left_out]
    return total if held is None else total - held, held


def _paths_in_tasks(m: EntityMoments, left_out: Sequence[int], penalties: Sequence[float], alpha: float) -> dict[int, list[PathFit]]:
    """Each fold walks its path in a task of its own."""
    small = _Numbers.of(m)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = int(pdf["left_out"].iloc[0])
        cube, total, base = _unpacked(small, pdf)
        train, held = _split(cube, total, fold)
        rows = float(small.training(fold)[0, 0])
        steps = fit_path(small.training(fold), small.products.get(fold), penalties, alpha)
        try:
            ask = next(steps)
            while True:
                ask = steps.send(answer(ask, train, held, base, rows, alpha))
        except StopIteration as end:
            fits = end.value
        return pd.DataFrame([(fold, i, list(f.theta), f.train_rss, f.test_rss, f.violation, f.settled) for i, f in enumerate(fits)], columns=names)

    schema = "left_out int, step int, theta array<double>, train_rss double, test_rss double, violation double, settled boolean"
    names = [field.split()[0] for field in schema.split(", ")]
    each = m.sums.withColumn("left_out", F.explode(F.array(*[F.lit(f) for f in left_out])))
    out: dict[int, list[PathFit]] = {f: [] for f in left_out}
    # One row a fold and penalty.
    for r in each.groupBy("left_out").applyInPandas(walk, schema).orderBy("left_out", "step").collect():
        out[r.left_out].append(PathFit(penalties[r.step], np.array(r.theta), r.train_rss, r.test_rss, r.violation, r.settled))
    return out


def _pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in pieces whose unpacked sums stay small."""
    for first in range(0, len(pdf), ENTITIES_AT_ONCE):
        yield pdf.iloc[first : first + ENTITIES_AT_ONCE]


def _starts(m: EntityMoments, left_out: Sequence[int], penalties: Sequence[float], alpha: float, entities: int) -> dict[int, list[np.ndarray]]:
    """Where the fits start: at those of some whole entities, which one task a fold can hold."""
    empty = {f: [start(m.training(f))] * len(penalties) for f in left_out}
    buckets = math.ceil(entities * m.folds * len(m.training(ALL_ROWS)) / NUMBERS_TO_START)
    some = m if buckets == 1 else m.subset(buckets) if m.subset else None
    if some is None or any(some.training(f)[0, 0] <= 0 for f in left_out):
        return empty
    found = _paths_in_tasks(some, left_out, penalties, alpha)
    return {f: [fit.theta for fit in found[f]] if len(found[f]) == len(penalties) else empty[f] for f in left_out}


def _paths_in_passes(m: EntityMoments, left_out: Sequence[int], penalties: Sequence[float], alpha: float) -> dict[int, list[PathFit]]:
    """All fits go side by side; a pass over the entities answers what all of them ask.

    The fits of some entities are no result, only the points to start from.
    """
    small = _Numbers.of(m)
    table = m.sums.select("folds", "sums", "is_base")
    width = len(m.design.names)

    def added(found: dict, key: str, matrix: np.ndarray) -> None:
        found[key] = found[key] + matrix if key in found else matrix

    def ask_slopes(asks: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
        def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
            found: dict[str, np.ndarray] = {}
            for piece in _pieces(pdf):
                cube, total, base = _unpacked(small, piece)
                for fold, (sizes, thetas) in asks.items():
                    train, held = _split(cube, total, fold)
                    added(found, str(fold), slopes(sizes, thetas, train, held, base, float(small.training(fold)[0, 0]), alpha))
            return found

        sums = collect_matrices(summed_matrices(table, blocks))
        return {f: sums.get(str(f), np.zeros((len(sizes), 5 + width))) for f, (sizes, _) in asks.items()}

    def ask_curvatures(asks: list[tuple[int, float, np.ndarray]]) -> list[np.ndarray]:
        def blocks(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
            found: dict[str, np.ndarray] = {}
            for piece in _pieces(pdf):
                cube, total, base = _unpacked(small, piece)
                sides: dict[int, np.ndarray] = {}
                for i, (fold, penalty, theta) in enumerate(asks):
                    if fold not in sides:
                        sides = {fold: _split(cube, total, fold)[0]}
                    added(found, str(i), curvature(penalty, theta, sides[fold], base, float(small.training(fold)[0, 0]), alpha))
            return found

        sums = collect_matrices(summed_matrices(table, blocks))
        return [sums.get(str(i), np.zeros((width, width))) for i in range(len(asks))]

    training = {f: m.training(f) for f in left_out}
    held = {f: m.products.get(f) for f in left_out}
    starts = _starts(m, left_out, penalties, alpha, m.sums.count())
    return fit_paths(training, held, penalties, alpha, starts, ALL_ROWS, ask_slopes, ask_curvatures)


def path(
    m: EntityMoments,
    penalties: Sequence[float],
    alpha: float = 1.0,
    cross_validate: bool = True,
    numbers_in_task: int = NUMBERS_IN_TASK,
) -> list[PathPoint]:
    """Fits at all ``penalties``, largest first, with the error on left-out folds.

    A table of more than ``numbers_in_task`` entity sums is never moved as a
    whole; the fits are the same.
    """
    left_out = [ALL_ROWS, *sorted(m.products)] if cross_validate else [ALL_ROWS]
    everything = m.training(ALL_ROWS)
    n = everything[0, 0]
    variance = everything[-1, -1] - everything[0, -1] ** 2 / n
    ordered = [float(p) for p in sorted(penalties, reverse=True)]
    entities = m.sums.count()
    small = 0 < entities * m.folds * len(everything) <= numbers_in_task
    fits = (_paths_in_tasks if small else _paths_in_passes)(m, left_out, ordered, alpha)
    out = []
    for i, penalty in enumerate(ordered):
        own = fits[ALL_ROWS][i]
        each = [fits[f][i] for f in left_out]
        error = sum(f.test_rss for f in each[1:]) / n if cross_validate else None
        out.append(PathPoint(penalty, own.theta, 1 - own.train_rss / variance, error, all(f.settled for f in each), max(f.violation for f in each)))
    return out


def best_point(points: Sequence[PathPoint]) -> PathPoint:
    """The penalty with the least cross-validated error."""
    return min(points, key=lambda p: p.cv_mse)


def entity_effects(m: EntityMoments, point: PathPoint, alpha: float = 1.0) -> DataFrame:
    """The effect of every entity at one point of the path."""
    rows, width, folds = float(m.training(ALL_ROWS)[0, 0]), len(point.theta) + 1, m.folds
    theta, penalty = point.theta, point.penalty
    schema = T.StructType([T.StructField(m.entity, m.sums.schema["entity"].dataType), T.StructField("effect", T.DoubleType())])

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (piece for batch in batches for piece in _pieces(batch)):
            _, total = _unpack(pdf, folds, width)
            effect = entity_effects_at(total, theta, rows, penalty, alpha, pdf["is_base"].to_numpy(dtype=bool))[0]
            yield pd.DataFrame({m_entity: pdf["entity"], "effect": effect})

    m_entity = m.entity
    return m.sums.mapInPandas(effects, schema)


def predict(
    rows: DataFrame, m: EntityMoments, point: PathPoint, keep: Sequence[str], name: str, alpha: float = 1.0
) -> DataFrame:
    """The columns to keep with the prediction; unseen entities get no effect."""
    design, theta = m.design, point.theta
    columns = list(dict.fromkeys([*keep, m.entity, *design.columns]))
    passed = list(dict.fromkeys([*keep, m.entity]))
    schema = T.StructType([rows.schema[c] for c in passed] + [T.StructField("_shared", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(batches):
            known = design.complete(pdf)
            value = pd.Series(np.nan, index=pdf.index)
            value.loc[known.index] = design.matrix(known) @ theta
            yield pdf[passed].assign(_shared=value)

    shared = rows.select(columns).mapInPandas(score, schema)
    joined = shared.join(entity_effects(m, point, alpha), m.entity, "left")
    return joined.select(*keep, (F.col("_shared") + F.coalesce("effect", F.lit(0.0))).alias(name))
