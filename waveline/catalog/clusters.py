"""Scaling, clustering, silhouettes and the tables of the clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveline.catalog.registry import query, shared_table, visits
from waveline.catalog.sql import PROFILES, with_
from waveline.catalog.tables import rounded
from waveline.operators.distribution import density, histogram, share_within
from waveline.operators.kmeans import counted_points, inertia, nearest_centre
from waveline.operators.shares import group_counts
from waveline.operators.silhouette import distance_sums, mean_silhouettes, silhouettes
from waveline.plans.profiles import (
    PROFILE,
    SCALED,
    baseline_profiles,
    cluster_means,
    final_clusters,
    labelled,
    scaled_points,
    score_counts_with_means,
    sweep,
    sweep_table,
)
from waveline.sources.panel_csv import SCORE
from waveline.sources.store import stored

# Centres for the queries that check an assignment and not a fit.
CENTRES = [(60.0, 0.0, 3.0), (85.0, -2.0, 4.0), (105.0, 1.0, 5.0), (130.0, 3.0, 6.0)]

_SQUARES = [
    f"((PANSS_Total - {a}) * (PANSS_Total - {a}) + (CompositeScore - ({b})) * (CompositeScore - ({b}))"
    f" + (CGIScore - {c}) * (CGIScore - {c}))"
    for a, b, c in CENTRES
]
ASSIGNED = PROFILES + f""",
distances as (select *, [{', '.join(_SQUARES)}] as d from profiles),
assigned as (
  select PatientID, Study, PANSS_Total, CompositeScore, CGIScore,
         cast(list_position(d, list_min(d)) as int) as cluster, list_min(d) as square
  from distances)"""
POINTS = ASSIGNED + """,
points as (
  select PANSS_Total, CompositeScore, CGIScore, cluster, count(*) as n_rows
  from assigned group by all),
sizes as (select cluster, sum(n_rows) as size from points group by cluster),
sums as (
  select p.PANSS_Total, p.CompositeScore, p.CGIScore, p.cluster, p.n_rows, q.cluster as other,
         sum(q.n_rows * sqrt((p.PANSS_Total - q.PANSS_Total) ** 2 + (p.CompositeScore - q.CompositeScore) ** 2
                             + (p.CGIScore - q.CGIScore) ** 2)) as total
  from points p, points q group by all),
parts as (
  select s.*, z.size, case when s.cluster = s.other then total / nullif(z.size - 1, 0) end as inside,
         case when s.cluster <> s.other then total / z.size end as outside
  from sums s join sizes z on s.other = z.cluster),
scores as (
  select PANSS_Total, CompositeScore, CGIScore, cluster, n_rows,
         case when max(case when cluster = other then size end) = 1 then 0.0
              else coalesce((min(outside) - max(inside)) / nullif(greatest(max(inside), min(outside)), 0), 0.0)
         end as silhouette
  from parts group by all)"""


def assigned(spark, sf_dir):
    """Profiles with the nearest of the given centres."""
    rows = baseline_profiles(visits(spark, sf_dir)).select("PatientID", "Study", *PROFILE)
    return rows.withColumn("cluster", nearest_centre(PROFILE, CENTRES))


def points(spark, sf_dir):
    """Standard scores of the distinct profiles."""
    return shared_table(
        spark, sf_dir, "points", lambda: scaled_points(baseline_profiles(visits(spark, sf_dir)))
    )


def fitted(spark, sf_dir):
    """Profiles with the cluster of the final fit."""

    def build():
        rows = baseline_profiles(visits(spark, sf_dir)).select("PatientID", "Study", *PROFILE)
        return final_clusters(rows)[0]

    return shared_table(spark, sf_dir, "clusters", build)


_RUNS: dict = {}


def runs(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = sweep(points(spark, sf_dir))
    return _RUNS[key]


def swept(spark, sf_dir):
    """Sum of squares and silhouette per number of clusters."""
    return shared_table(spark, sf_dir, "sweep", lambda: sweep_table(points(spark, sf_dir), runs(spark, sf_dir)))


@query("m2_kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    fits = runs(spark, sf_dir).values()
    return spark.createDataFrame([(r.k, r.withinss, r.steps) for r in fits], "k int, withinss double, steps int")


def _misplaced(rows, columns, cluster, k):
    """Rows, and those that lie nearer to the mean of another cluster than of their own."""
    means = rows.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in columns])
    centres = [list(r)[1:] for r in means.orderBy(cluster).collect()]
    square = [sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, centre)) for centre in centres]
    own = F.element_at(F.array(*square), F.col(cluster))
    wrong = F.coalesce((own > F.array_min(F.array(*square)) + 1e-9).cast("int"), F.lit(1))
    return rows.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("misplaced"))


@query(
    "m2_sweep_certificate",
    with_(PROFILES, "select k::int as k, count(*) as n, 0::bigint as misplaced from profiles, range(2, 13) r(k) group by k"),
)
def sweep_certificate(spark, sf_dir):
    """Each fit of the sweep stands still: every profile is nearest to the mean of its own cluster."""
    found = labelled(points(spark, sf_dir), runs(spark, sf_dir))
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    out = None
    for k in runs(spark, sf_dir):
        part = _misplaced(rows, SCALED, f"k{k}", k)
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "m3_fit_certificate",
    with_(PROFILES, """select 4 as k, count(*) as n, 0::bigint as misplaced from profiles"""),
)
def fit_certificate(spark, sf_dir):
    from waveline.operators.scale import z_scores

    return _misplaced(z_scores(fitted(spark, sf_dir), PROFILE, "z_{col}"), SCALED, "cluster", 4)


@query(
    "c7_study_totals",
    with_(PROFILES, "select Study, count(*)::bigint as n from profiles group by Study"),
)
def study_totals(spark, sf_dir):
    """Rows of the chart of clusters by study, added up over the clusters."""
    return cluster_study_chart(spark, sf_dir).groupBy("Study").agg(F.sum("n").alias("n"))


@query("m3_final_clusters")
def final(spark, sf_dir):
    return fitted(spark, sf_dir)


@query(
    "m3_assign_given_centres",
    with_(ASSIGNED, "select PatientID, Study, PANSS_Total, CompositeScore, CGIScore, cluster from assigned"),
)
def assign(spark, sf_dir):
    return assigned(spark, sf_dir)


@query(
    "m3_inertia_given_centres",
    with_(ASSIGNED, "select cluster, count(*) as n, round(cast(sum(square) as double), 6) as withinss from assigned group by cluster"),
)
def given_inertia(spark, sf_dir):
    return rounded(inertia(assigned(spark, sf_dir), PROFILE, CENTRES, "cluster"), "withinss")


def _given_points(spark, sf_dir):
    return stored(counted_points(assigned(spark, sf_dir), [*PROFILE, "cluster"]))


@query(
    "j7_distance_sums",
    with_(POINTS, "select PANSS_Total, CompositeScore, CGIScore, other, round(total, 6) as total from sums"),
)
def distances(spark, sf_dir):
    sums = distance_sums(_given_points(spark, sf_dir), PROFILE, {"cluster": len(CENTRES)})
    rows = sums.select(*PROFILE, F.posexplode("sums").alias("other", "total")).withColumn("other", F.col("other") + 1)
    return rounded(rows, "total")


@query(
    "m4_silhouette",
    with_(POINTS, """select PANSS_Total, CompositeScore, CGIScore, cluster, n_rows,
        round(silhouette, 6) as silhouette from scores"""),
)
def silhouette(spark, sf_dir):
    scores = silhouettes(_given_points(spark, sf_dir), PROFILE, {"cluster": len(CENTRES)})
    return rounded(scores.drop("labelling"), "silhouette")


@query("a9_mean_silhouette", with_(POINTS, "select round(sum(silhouette * n_rows) / sum(n_rows), 6) as silhouette from scores"))
def mean_silhouette(spark, sf_dir):
    scores = silhouettes(_given_points(spark, sf_dir), PROFILE, {"cluster": len(CENTRES)})
    return rounded(mean_silhouettes(scores).select("silhouette"), "silhouette")


@query("m5_sweep_table")
def elbow(spark, sf_dir):
    return swept(spark, sf_dir)


@query("c5_sweep_chart")
def sweep_chart(spark, sf_dir):
    return swept(spark, sf_dir).orderBy("k")


@query("t6_best_k")
def best_k(spark, sf_dir):
    return swept(spark, sf_dir).agg(F.max_by("k", "silhouette").alias("k"))


@query("c6_silhouettes_k4_k10")
def silhouette_chart(spark, sf_dir):
    chosen = {k: runs(spark, sf_dir)[k] for k in (4, 10)}
    return silhouettes(labelled(points(spark, sf_dir), chosen), SCALED, {f"k{k}": k for k in chosen})


_MEANS = """select cluster, round(avg(CGIScore), 6) as CGIScore, round(avg(CompositeScore), 6) as CompositeScore,
    round(avg(PANSS_Total), 6) as PANSS_Total from assigned group by cluster"""


@query("a2_cluster_means", with_(ASSIGNED, _MEANS))
def means(spark, sf_dir):
    return rounded(cluster_means(assigned(spark, sf_dir)), "CGIScore", "CompositeScore", SCORE)


@query("a10_cluster_sizes", with_(ASSIGNED, "select cluster, count(*) as n from assigned group by cluster"))
def sizes(spark, sf_dir):
    return group_counts(assigned(spark, sf_dir), ["cluster"])


@query(
    "a11_overlap_counts",
    with_(ASSIGNED, "select CGIScore, PANSS_Total, cluster, count(*) as n from assigned group by all"),
)
def overlaps(spark, sf_dir):
    return group_counts(assigned(spark, sf_dir), ["CGIScore", SCORE, "cluster"])


@query(
    "a12_study_share",
    with_(ASSIGNED, """select cluster, Study, count(*) as n,
        round(count(*) / sum(count(*)) over (partition by cluster), 6) as share
        from assigned group by cluster, Study"""),
)
def study_share(spark, sf_dir):
    return rounded(share_within(assigned(spark, sf_dir), "cluster", "Study"), "share")


@query(
    "a13_histogram",
    with_(ASSIGNED, """select cluster, cast(floor((PANSS_Total - 30) / 9.0) + 1 as bigint) as bin, count(*) as n
        from assigned group by all"""),
)
def score_histogram(spark, sf_dir):
    return histogram(assigned(spark, sf_dir), ["cluster"], SCORE, 30, 210, 20)


def _density_sql(value, low, high, points_):
    step = (high - low) / (points_ - 1)
    return with_(ASSIGNED, f"""
, spread as (
  select cluster, count(*) as size, stddev_samp({value}) as sd,
         (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) / 1.34 as robust
  from assigned group by cluster),
width as (
  select cluster, size, 0.9 * (case when robust > 0 and robust < sd then robust when sd > 0 then sd else 1 end)
         * power(size, -0.2) as h from spread)
select a.cluster, round({low} + g * cast({step!r} as double), 6) as x,
       round(sum(exp(-power(({low} + g * cast({step!r} as double) - {value}) / h, 2) / 2) / (sqrt(2 * pi()) * h * size)), 6) as density
from assigned a join width w on a.cluster = w.cluster, unnest(range({points_})) t(g)
group by a.cluster, g""")


def _density(spark, sf_dir, value, low, high):
    return rounded(density(assigned(spark, sf_dir), ["cluster"], value, low, high, 64), "x", "density")


@query("a13_density_score", _density_sql("PANSS_Total", 30, 210, 64))
def score_density(spark, sf_dir):
    return _density(spark, sf_dir, SCORE, 30, 210)


@query("a13_density_composite", _density_sql("CompositeScore", -42, 42, 64))
def composite_density(spark, sf_dir):
    return _density(spark, sf_dir, "CompositeScore", -42, 42)


@query("a13_density_grade", _density_sql("CGIScore", 0, 8, 64))
def grade_density(spark, sf_dir):
    return _density(spark, sf_dir, "CGIScore", 0, 8)


@query("a18_grade_counts", with_(ASSIGNED, "select cluster, CGIScore, count(*) as n from assigned group by all"))
def grade_counts(spark, sf_dir):
    return group_counts(assigned(spark, sf_dir), ["cluster", "CGIScore"])


@query("c7_cluster_study_chart")
def cluster_study_chart(spark, sf_dir):
    return share_within(fitted(spark, sf_dir), "cluster", "Study").orderBy("cluster", "Study")


@query(
    "c8_counts_with_means",
    with_(ASSIGNED, f""", means as ({_MEANS})
select a.cluster, a.CGIScore, a.PANSS_Total, count(*) as n, any_value(m.CGIScore) as mean_CGIScore,
       any_value(m.PANSS_Total) as mean_PANSS_Total
from assigned a join means m on a.cluster = m.cluster group by a.cluster, a.CGIScore, a.PANSS_Total"""),
)
def counts_with_means(spark, sf_dir):
    return rounded(score_counts_with_means(assigned(spark, sf_dir)), "mean_CGIScore", f"mean_{SCORE}")


# Ranges of the three scores of a profile, as in the densities above.
RANGES = {SCORE: (30, 210), "CompositeScore": (-42, 42), "CGIScore": (0, 8)}


@query("c9_score_distribution")
def distribution_chart(spark, sf_dir):
    """Density of each of the three scores in each fitted cluster."""
    out = None
    for score, (low, high) in RANGES.items():
        part = density(fitted(spark, sf_dir), ["cluster"], score, low, high, 64).withColumn("score", F.lit(score))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("score", "cluster", "x")


@query("c10_fitted_points")
def fitted_points(spark, sf_dir):
    """Counted points of the fitted clusters, beside the mean position of each cluster."""
    rows = fitted(spark, sf_dir)
    means = rows.groupBy("cluster").agg(F.avg("CompositeScore").alias("mean_CompositeScore"), F.avg(SCORE).alias(f"mean_{SCORE}"))
    return group_counts(rows, ["CompositeScore", SCORE, "cluster"]).join(means, "cluster")


@query(
    "c10_fitted_counts",
    with_(PROFILES, "select CompositeScore::int as CompositeScore, PANSS_Total::int as PANSS_Total, count(*) as n from profiles group by all"),
)
def fitted_counts(spark, sf_dir):
    """The fitted points without their labels: each profile has one cluster."""
    rows = fitted_points(spark, sf_dir).groupBy(F.col("CompositeScore").cast("int"), F.col(SCORE).cast("int").alias(SCORE))
    return rows.agg(F.sum("n").alias("n")).toDF("CompositeScore", SCORE, "n")


@query(
    "c10_cluster_points",
    with_(ASSIGNED, """select CompositeScore, PANSS_Total, cluster, count(*) as n from assigned group by all"""),
)
def cluster_points(spark, sf_dir):
    return group_counts(assigned(spark, sf_dir), ["CompositeScore", SCORE, "cluster"])
