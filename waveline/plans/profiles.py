"""Baseline profiles: composite, grade, clusters and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.functions.bands import grade
from waveline.functions.scores import composite, poisoned_mean
from waveline.operators.collapse import collapse_periods
from waveline.operators.kmeans import Run, best_runs, counted_points, fit_runs, nearest_centre
from waveline.operators.scale import z_scores
from waveline.operators.shares import group_counts
from waveline.operators.silhouette import mean_silhouettes, silhouettes
from waveline.sources.panel_csv import G_ITEMS, N_ITEMS, P_ITEMS, SCORE
from waveline.sources.store import stored

PROFILE = [SCORE, "CompositeScore", "CGIScore"]
SCALED = [f"z_{c}" for c in PROFILE]

# Numbers of clusters, starts and steps of the two fits.
SWEEP_KS = range(2, 13)
SWEEP_STARTS = 25
SWEEP_STEPS = 300
CHOSEN_K = 4
FINAL_STARTS = 50
FINAL_STEPS = 200


def baseline_profiles(visits: DataFrame) -> DataFrame:
    """Day-0 rows of the weekly table with composite score and grade.

    Day 0 lies in week 1, so only that week is collapsed, and the filter on it
    reaches the scan. Earlier weeks would only shift the week number.
    """
    first_week = visits.where("Week = 1").drop("LeadStatus", *G_ITEMS)
    rows = collapse_periods(first_week, "PatientID", "Week", SCORE, ["VisitDay"])
    return rows.where("VisitDay = 0").withColumns(
        {"CompositeScore": composite(N_ITEMS, P_ITEMS), "CGIScore": grade(F.col(SCORE))}
    )


def scaled_points(profiles: DataFrame) -> DataFrame:
    """Distinct profiles with their standard scores and row counts, stored."""
    scaled = z_scores(profiles.select(*PROFILE), PROFILE, "z_{col}")
    return stored(counted_points(scaled, [*PROFILE, *SCALED]))


def sweep(points: DataFrame, ks=SWEEP_KS, starts: int = SWEEP_STARTS, max_steps: int = SWEEP_STEPS) -> dict[int, Run]:
    """The best run for every number of clusters."""
    return best_runs(fit_runs(points, SCALED, list(ks), starts, max_steps))


def labelled(points: DataFrame, runs: dict[int, Run]) -> DataFrame:
    """Points with one label column ``k<k>`` per run."""
    return points.withColumns({f"k{k}": nearest_centre(SCALED, run.centres) for k, run in runs.items()})


def sweep_table(points: DataFrame, runs: dict[int, Run]) -> DataFrame:
    """Within-cluster sum of squares and mean silhouette per k.

    The distances serve all labellings at once.
    """
    scores = mean_silhouettes(
        silhouettes(labelled(points, runs), SCALED, {f"k{k}": k for k in runs})
    )
    fits = points.sparkSession.createDataFrame(
        [(k, run.withinss) for k, run in runs.items()], "k int, withinss double"
    )
    return fits.join(scores.withColumn("k", F.substring("labelling", 2, 3).cast("int")).drop("labelling"), "k")


def final_clusters(profiles: DataFrame, k: int = CHOSEN_K, starts: int = FINAL_STARTS, max_steps: int = FINAL_STEPS):
    """Profiles with their cluster, and the fitted run."""
    points = scaled_points(profiles)
    run = best_runs(fit_runs(points, SCALED, [k], starts, max_steps))[k]
    scaled = z_scores(profiles, PROFILE, "z_{col}")
    return scaled.withColumn("cluster", nearest_centre(SCALED, run.centres)).drop(*SCALED), run


def cluster_means(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(*[poisoned_mean(c).alias(c) for c in ["CGIScore", "CompositeScore", SCORE]])


def score_counts_with_means(clusters: DataFrame) -> DataFrame:
    """Rows per grade, score and cluster, beside the means of the cluster."""
    counts = group_counts(clusters, ["CGIScore", SCORE, "cluster"])
    means = cluster_means(clusters).select(
        "cluster", F.col("CGIScore").alias("mean_CGIScore"), F.col(SCORE).alias(f"mean_{SCORE}")
    )
    return counts.join(means, "cluster")
