"""K-means with many starts, all of them served by one pass per step.

Equal points are counted first, so a pass costs distinct points, not rows. A
pass assigns every point under every run (each k and start) and returns one
sum per centre; the driver only ever holds centres.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHT = "n_rows"
POINTS_PER_STEP = 1_024


def counted_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct points with the number of rows at each; nulls are left out."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias(WEIGHT))


@dataclass(frozen=True)
class Run:
    k: int
    start: int
    centres: np.ndarray
    withinss: float
    steps: int


def _starts(points: DataFrame, columns: Sequence[str], keys: list[tuple[int, int]], seed: int) -> dict[tuple[int, int], np.ndarray]:
    """First centres of every run: the k points with the smallest draws of that run.

    A draw hangs on the point and the run alone, so any point can be a start
    and the starts are the same for any partitioning. A task returns its k
    smallest of each run; what the driver sees is the centres.
    """
    runs = np.array([(k, start) for k, start in keys], np.uint64)
    mixed = (runs[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (runs[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = pdf["drawn"].to_numpy().view(np.uint64)
            for run, (k, _) in enumerate(keys):
                x = (drawn ^ mixed[run]) * np.uint64(0xFF51AFD7ED558CCD)
                x = ((x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(1)
                best = np.argsort(x, kind="stable")[:k]
                yield pdf.iloc[best].assign(run=run, draw=x[best].astype(np.int64))

    drawn = points.select(*columns, F.xxhash64(F.lit(seed), *columns).alias("drawn"))
    schema = T.StructType([*drawn.schema, T.StructField("run", T.IntegerType()), T.StructField("draw", T.LongType())])
    rank = F.row_number().over(Window.partitionBy("run").orderBy("draw", *columns))
    size = F.get(F.array(*[F.lit(k) for k, _ in keys]), F.col("run"))
    chosen = drawn.mapInPandas(smallest, schema).withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("run", "rank").collect()
    out: dict[tuple[int, int], list] = {key: [] for key in keys}
    for row in chosen:
        out[keys[row["run"]]].append([float(row[c]) for c in columns])
    for (k, _), centres in out.items():
        if len(centres) < k:
            raise ValueError(f"{k} clusters need at least {k} distinct points, found {len(centres)}")
    return {key: np.array(centres) for key, centres in out.items()}


def _pass(points: DataFrame, columns: Sequence[str], runs: list[np.ndarray]) -> np.ndarray:
    """Per centre of all runs: weight, weighted sums and sum of squares."""
    d = len(columns)
    sizes = [len(c) for c in runs]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = sum(sizes)
    centres = np.vstack(runs)
    by_k = {k: [i for i, s in enumerate(sizes) if s == k] for k in set(sizes)}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((total, d + 2))
        for pdf in batches:
            for at in range(0, len(pdf), POINTS_PER_STEP):
                piece = pdf.iloc[at : at + POINTS_PER_STEP]
                x = piece[list(columns)].to_numpy(dtype=float)
                w = piece[WEIGHT].to_numpy(dtype=float)
                distance = np.zeros((len(x), total))
                for j in range(d):
                    distance += (x[:, j, None] - centres[None, :, j]) ** 2
                for k, members in by_k.items():
                    at_run = offsets[members]
                    near = distance[:, at_run[:, None] + np.arange(k)[None, :]]
                    label = near.argmin(axis=2)
                    best = np.take_along_axis(near, label[:, :, None], axis=2)[:, :, 0]
                    place = (label + at_run[None, :]).ravel()
                    repeated = np.repeat(np.arange(len(x)), len(members))
                    ww = w[repeated]
                    sums[:, 0] += np.bincount(place, ww, total)
                    for j in range(d):
                        sums[:, 1 + j] += np.bincount(place, ww * x[repeated, j], total)
                    sums[:, -1] += np.bincount(place, ww * best.ravel(), total)
        yield pd.DataFrame({"centre": np.arange(total), "sums": list(sums)})

    rows = points.select(*columns, WEIGHT).mapInPandas(partial, "centre long, sums array<double>")
    total_sums = vector_to_array(Summarizer.sum(array_to_vector("sums")))
    collected = rows.groupBy("centre").agg(total_sums.alias("sums")).collect()
    out = np.zeros((total, d + 2))
    for r in collected:
        out[r.centre] = r.sums
    return out


def fit_runs(
    points: DataFrame,
    columns: Sequence[str],
    ks: Sequence[int],
    starts: int,
    max_steps: int,
    seed: int = 2,
) -> list[Run]:
    """Lloyd's steps for every k and start until no centre moves.

    ``points`` comes from ``counted_points`` and should be a stored table.
    """
    keys = [(k, s) for k in ks for s in range(starts)]
    centres = _starts(points, columns, keys, seed)
    withinss = dict.fromkeys(keys, np.inf)
    steps = dict.fromkeys(keys, 0)
    active = list(keys)
    for _ in range(max_steps + 1):
        sums = _pass(points, columns, [centres[key] for key in active])
        at, moving = 0, []
        for key in active:
            own = sums[at : at + key[0]]
            at += key[0]
            withinss[key] = float(own[:, -1].sum())
            filled = own[:, 0] > 0
            moved = centres[key].copy()
            moved[filled] = own[filled, 1:-1] / own[filled, :1]
            if steps[key] < max_steps and not np.allclose(moved, centres[key], rtol=0, atol=1e-12):
                centres[key] = moved
                steps[key] += 1
                moving.append(key)
        active = moving
        if not active:
            break
    return [Run(k, s, centres[k, s], withinss[k, s], steps[k, s]) for k, s in keys]


def best_runs(runs: Sequence[Run]) -> dict[int, Run]:
    """The start with the least within-cluster sum of squares, per k.

    Clusters are numbered by their centres, so the labels are repeatable.
    """
    out = {}
    for k in sorted({r.k for r in runs}):
        best = min((r for r in runs if r.k == k), key=lambda r: (r.withinss, r.start))
        order = np.lexsort(best.centres.T[::-1])
        out[k] = Run(k, best.start, best.centres[order], best.withinss, best.steps)
    return out


def nearest_centre(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre, from 1; the first one on ties."""
    distances = F.array(
        *[sum((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, centre)) for centre in centres]
    )
    return F.array_position(distances, F.array_min(distances)).cast("int")


def inertia(df: DataFrame, columns: Sequence[str], centres: Sequence[Sequence[float]], cluster: str) -> DataFrame:
    """Rows and within-cluster sum of squares per cluster, for given centres."""
    own = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in centres])
    centre = F.get(own, F.col(cluster) - 1)
    square = sum((F.col(c) - F.get(centre, F.lit(j))) * (F.col(c) - F.get(centre, F.lit(j))) for j, c in enumerate(columns))
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("withinss"))
