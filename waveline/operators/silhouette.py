"""Exact silhouettes without a table of pairs.

A point needs only the sum of its distances to each cluster. Distinct points
are cut into blocks; a task takes two blocks, works out their distances in
memory and returns one row of sums per point of both. No pair is ever a row,
no pair of blocks is worked on twice, and a task never holds more than two
blocks, however many points there are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.operators.kmeans import WEIGHT

POINTS_PER_BLOCK = 2_048


def distance_sums(points: DataFrame, columns: Sequence[str], labels: Mapping[str, int]) -> DataFrame:
    """Sum of distances from each point to every cluster of every labelling.

    ``labels`` maps a label column to its number of clusters (labels count
    from 1). The column ``sums`` has one entry per cluster, labelling after
    labelling. ``points`` are distinct points with their row counts.
    """
    blocks = max(1, math.ceil(points.count() / POINTS_PER_BLOCK))
    width = sum(labels.values())
    names, label_names = list(columns), list(labels)

    def weights(side: pd.DataFrame) -> np.ndarray:
        out, at = np.zeros((len(side), width)), 0
        for label in label_names:
            place = at + side[label].to_numpy(dtype=int) - 1
            out[np.arange(len(side)), place] = side[WEIGHT].to_numpy(dtype=float)
            at += labels[label]
        return out

    def sums(pair: tuple[int, int], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns=lambda c: c.removeprefix("other_"))
        x, z = left[names].to_numpy(dtype=float), right[names].to_numpy(dtype=float)
        square = np.zeros((len(x), len(z)))
        for j in range(len(names)):
            square += (x[:, j, None] - z[None, :, j]) ** 2
        distance = np.sqrt(square)
        out = [left[names].assign(sums=list(distance @ weights(right)))]
        if pair[0] != pair[1]:
            out.append(right[names].assign(sums=list(distance.T @ weights(left))))
        return pd.concat(out, ignore_index=True)

    # Both keys have one type, or the two sides would be hashed differently.
    own = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    # A pair of blocks meets once, the smaller number on the left, and serves both.
    later, earlier = F.sequence(own, F.lit(blocks - 1)), F.sequence(F.lit(0), own)
    rows = points.select(*names, *label_names, WEIGHT)
    left = rows.select(*names, *label_names, WEIGHT, own.alias("_left"), F.explode(later).alias("_right"))
    # The right side gets columns of its own. If both sides shared theirs, the
    # optimizer could prune one side by the needs of the other.
    right = rows.select(
        *[F.col(c).alias(f"other_{c}") for c in [*names, *label_names, WEIGHT]],
        own.alias("_right"),
        F.explode(earlier).alias("_left"),
    )
    schema = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in names) + ", sums array<double>"
    parts = (
        left.groupBy("_left", "_right").cogroup(right.groupBy("_left", "_right")).applyInPandas(sums, schema)
    )
    total = vector_to_array(Summarizer.sum(array_to_vector("sums")))
    return parts.groupBy(*names).agg(total.alias("sums"))


def silhouettes(points: DataFrame, columns: Sequence[str], labels: Mapping[str, int]) -> DataFrame:
    """Silhouette of each distinct point under each labelling.

    One row per point and labelling: the point, its row count, ``labelling``,
    ``cluster`` and ``silhouette``. A row alone in its cluster scores 0.
    """
    names = list(columns)
    # One row per labelling and cluster.
    sizes = {}
    for label, k in labels.items():
        found = {r[0]: r[1] for r in points.groupBy(label).agg(F.sum(WEIGHT)).collect()}
        sizes[label] = [int(found.get(c, 0)) for c in range(1, k + 1)]
    joined = points.join(distance_sums(points, names, labels), names)
    parts, at = [], 0
    for label, k in labels.items():
        size = F.array(*[F.lit(float(s)) for s in sizes[label]])
        part = F.slice("sums", at + 1, k)
        parts.append(
            F.struct(F.lit(label).alias("labelling"), F.col(label).alias("cluster"), part.alias("sums"), size.alias("sizes"))
        )
        at += k
    rows = joined.select(*names, WEIGHT, F.explode(F.array(*parts)).alias("p")).select(*names, WEIGHT, "p.*")
    own = F.col("cluster") - 1
    inside = F.try_divide(F.get("sums", own), F.get("sizes", own) - 1)
    means = F.zip_with("sums", "sizes", lambda s, n: F.try_divide(s, n))
    others = F.filter(means, lambda m, i: (i != own) & m.isNotNull())
    outside = F.array_min(others)
    score = F.when(F.get("sizes", own) > 1, F.coalesce(F.try_divide(outside - inside, F.greatest(inside, outside)), F.lit(0.0)))
    return rows.select(*names, WEIGHT, "labelling", "cluster", score.otherwise(0.0).alias("silhouette"))


def mean_silhouettes(scores: DataFrame) -> DataFrame:
    """Mean silhouette over rows per labelling."""
    mean = F.sum(F.col("silhouette") * F.col(WEIGHT)) / F.sum(WEIGHT)
    return scores.groupBy("labelling").agg(mean.alias("silhouette"))
