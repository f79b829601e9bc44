"""Fits against plain numpy on small frames, and against known values."""

from __future__ import annotations

import gc
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waveline.functions.tails import f_upper, t_quantile, t_two_sided
from waveline.operators import lasso, logistic, moments, ols
from waveline.operators.design import Design, crossed, design_rows, factor_levels, numeric_shift
from waveline.operators.distribution import density, histogram
from waveline.operators.kmeans import WEIGHT, best_runs, counted_points, fit_runs, inertia, nearest_centre
from waveline.operators.scale import z_scores
from waveline.operators.silhouette import mean_silhouettes, silhouettes
from waveline.operators.split import split_rows
from waveline.plans import forecast
from waveline.plans.effects import BASE_ITEMS, degree_sweep, degree_sweeps, polynomial_trend


def random_frame(seed=1, n=120):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"s": rng.choice(list("ABC"), n), "g": rng.choice(["C", "T"], n), "b": rng.normal(80, 10, n)})
    pdf["y"] = 3 + (pdf.s == "B") * 2 + 0.5 * pdf.b + (pdf.g == "T") * (0.1 * pdf.b) + rng.normal(0, 2, n)
    return pdf


def test_design_names_and_columns(spark):
    design = Design.of(crossed("s", "g", "b"), levels={"s": ["A", "B", "C"], "g": ["C", "T"]})
    assert design.names[:6] == ["(Intercept)", "sB", "sC", "gT", "b", "sB:gT"]
    assert len(design.names) == 12
    pdf = random_frame()
    x = design.matrix(pdf)
    expect = (pdf.s == "C") * (pdf.g == "T") * pdf.b
    assert np.allclose(x[:, design.names.index("sC:gT:b")], expect)
    rows = design_rows(spark.createDataFrame(pdf), design, ["y"])
    total = np.sum([r.x for r in rows.collect()], axis=0)
    assert np.allclose(total, x.sum(axis=0))


def test_least_squares_equals_numpy(spark):
    pdf = random_frame()
    df = spark.createDataFrame(pdf).repartition(5)
    design = Design.of(crossed("s", "g", "b"), levels=factor_levels(df, ["s", "g"]))
    fit = ols.fit(df, design, "y")
    x = design.matrix(pdf)
    beta, rss, *_ = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)
    assert np.allclose(fit.beta, beta, rtol=1e-6, atol=1e-6)
    assert math.isclose(fit.rss, float(rss[0]), rel_tol=1e-8)
    sigma2 = fit.rss / (len(pdf) - x.shape[1])
    errors = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * sigma2)
    assert np.allclose(fit.errors, errors, rtol=1e-5)


def test_aliased_columns_are_null_and_null_rows_left_out(spark):
    pdf = random_frame(n=40)
    pdf["twice"] = 2 * pdf.b
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("y") < 50, F.col("b")))
    fit = ols.fit(df, Design.of(["b", "twice"]), "y")
    table = {c[0]: c[1] for c in fit.coefficients()}
    assert table["twice"] is None and table["b"] is not None
    assert fit.rows == int((pdf.y < 50).sum())


def test_comparison_refuses_unequal_rows_and_gives_f(spark):
    pdf = random_frame()
    df = spark.createDataFrame(pdf)
    small, large = ols.fit(df, Design.of(["b"]), "y"), ols.fit(df, Design.of(["b", "g"], levels={"g": ["C", "T"]}), "y")
    rows = ols.compare(spark, {"small": small, "large": large}).collect()
    f = (small.rss - large.rss) / (large.rss / large.residual_df)
    assert rows[0].f is None and math.isclose(rows[1].f, f) and rows[1].df == 1
    other = ols.fit(df.limit(50), Design.of(["b"]), "y")
    with pytest.raises(ValueError):
        ols.compare(spark, {"a": other, "b": large})


def test_tails():
    assert math.isclose(t_two_sided(2.0, 10), 0.0733880, rel_tol=1e-5)
    assert math.isclose(f_upper(3.0, 2, 10), 0.0953674, rel_tol=1e-5)
    assert math.isclose(t_quantile(0.975, 10), 2.2281389, rel_tol=1e-6)


def test_logistic_gradient_vanishes(spark):
    pdf = random_frame(n=300)
    pdf["passed"] = (np.random.default_rng(5).random(300) < 1 / (1 + np.exp(-(pdf.b - 80) / 8))).astype(int)
    df = spark.createDataFrame(pdf)
    design = Design.of(crossed("g", "b"), levels=factor_levels(df, ["g"]), shift=numeric_shift(df, ["b"]))
    fit = logistic.fit(df, design, "passed")
    x = design.matrix(pdf)
    p = 1 / (1 + np.exp(-x @ fit.beta))
    assert fit.converged and np.allclose(x.T @ (pdf.passed - p), 0, atol=1e-4)
    scored = logistic.predict(df, fit, ["b"]).toPandas().sort_values("b")
    assert np.allclose(scored.probability, p[np.argsort(pdf.b.to_numpy())])


def test_design_leaves_no_products_behind():
    pdf = pd.DataFrame(np.random.default_rng(2).normal(size=(500, 6)), columns=list("abcdef"))
    design = Design.of(crossed(*"abcdef"))
    size = design.matrix(pdf).nbytes
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(20):
            design.matrix(pdf)
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert left < size


def test_batches_are_worked_on_in_pieces():
    pdf = pd.DataFrame({"a": np.arange(2500)})
    found = list(moments.pieces(iter([pdf, pdf[:0]]), 1_000))
    assert [len(p) for p in found] == [1000, 1000, 500, 0]
    assert pd.concat(found)["a"].tolist() == pdf["a"].tolist()


def test_narrow_designs_take_a_whole_batch_at_once(spark, monkeypatch):
    taken, matrices = [], moments.summed_matrices
    monkeypatch.setattr(moments, "summed_matrices", lambda df, blocks, at_once=moments.ROWS_AT_ONCE: (taken.append(at_once), matrices(df, blocks, at_once))[1])
    df = spark.range(20_000).selectExpr("cast(id % 7 as double) as x", "cast(id % 5 as double) as y")
    found = moments.collect_matrices(moments.cross_products(df, Design.of(["x"]), "y"))[""]
    assert taken[0] > 10_000 and found[0].tolist() == [20_000, 20_000 // 7 * 21 + 0, 40_000]
    wide = Design.of([f"x{i}" for i in range(300)])
    moments.cross_products(spark.createDataFrame([tuple([0.0] * 301)], [*wide.columns, "y"]), wide, "y")
    assert taken[1] == moments.ROWS_AT_ONCE


def test_missing_predictor_gives_null_probability(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 0), (4, 4.0, 1), (5, None, 1)], "k long, b double, y int")
    fit = logistic.fit(df, Design.of(["b"]), "y")
    out = {r.k: r.probability for r in logistic.predict(df, fit, ["k"]).collect()}
    assert out[5] is None and all(0 < out[k] < 1 for k in (1, 2, 3, 4)) and fit.rows == 4


@pytest.mark.parametrize("alpha", [1.0, 0.0])
def test_penalised_logistic_meets_its_conditions(spark, alpha):
    rng = np.random.default_rng(8)
    x = rng.normal(0, [1, 2, 1, 3], (400, 4))
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf["y"] = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    pdf["fold"] = rng.integers(0, 4, 400).astype("int32")
    penalties = [0.1, 0.02]
    found = logistic.penalised_path(spark.createDataFrame(pdf), Design.of(list("abcd")), "y", alpha, "fold", penalties)
    for penalty, beta in zip(penalties, found.betas):
        pull = x.T @ (pdf.y - 1 / (1 + np.exp(-beta[0] - x @ beta[1:]))) / 400
        s = x.std(axis=0)
        if alpha == 0:
            assert np.allclose(pull, penalty * s**2 * beta[1:], atol=1e-4)
        else:
            used = beta[1:] != 0
            assert np.allclose(pull[used], penalty * s[used] * np.sign(beta[1:][used]), atol=1e-4)
            assert np.all(np.abs(pull) <= penalty * s + 1e-4)
    assert found.log_loss[1] < found.log_loss[0] < math.log(2)


@pytest.mark.parametrize("alpha", [1.0, 0.0])
def test_passes_over_the_rows_serve_all_penalties_and_folds(spark, alpha):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 8))
    pdf = pd.DataFrame(x, columns=list("abcdefgh"))
    pdf["y"] = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(1.5 * pdf.a - pdf.b + 0.3)))).astype(int)
    pdf["fold"] = rng.integers(0, 5, 4000).astype("int32")
    design = Design.of(list("abcdefgh"))
    df = spark.createDataFrame(pdf).repartition(3)
    found = logistic.penalised_path(df, design, "y", alpha, "fold")
    assert all(found.settled) and found.passes <= 25
    # The error on left-out folds, from fits without them.
    at = [5, 70]
    losses = np.zeros(len(at))
    for fold in range(5):
        own = logistic.penalised_path(df.where(f"fold <> {fold}"), design, "y", alpha, "fold", [found.penalties[i] for i in at])
        test = pdf[pdf.fold == fold]
        eta = design.matrix(test) @ np.array(own.betas).T
        losses += np.sum(np.logaddexp(0, eta) - test.y.to_numpy()[:, None] * eta, axis=0)
    assert np.allclose(losses / 4000, [found.log_loss[i] for i in at], atol=1e-5)


def lasso_frame(seed=4, n=240, patients=18):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": np.arange(n), "p": rng.integers(0, patients, n).astype("int64")})
    pdf.loc[: n // 3, "p"] = 3
    for c in ("u", "v", "w"):
        pdf[c] = rng.normal(0, 1, n) + 0.2 * pdf.p
    pdf["fold"] = rng.integers(0, 4, n).astype("int32")
    pdf["y"] = 50 + 3 * pdf.u - 2 * pdf.v + rng.normal(0, 5, patients)[pdf.p] + rng.normal(0, 1, n)
    return pdf


def dense(pdf, base):
    own = [p for p in sorted(pdf.p.unique()) if p != base]
    x = np.column_stack([pdf[["u", "v", "w"]].to_numpy()] + [(pdf.p == p).to_numpy(dtype=float) for p in own])
    return x, own


@pytest.mark.parametrize("alpha", [1.0, 0.0])
def test_penalised_logistic_path_is_whole_and_settles(spark, alpha):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 12)) * np.arange(1, 13)
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])
    pdf["c11"] = pdf.c0 + 0.01 * pdf.c11
    pdf["y"] = (rng.uniform(size=400) < 1 / (1 + np.exp(-(2 * pdf.c0 - 0.3 * pdf.c3)))).astype(int)
    pdf["fold"] = np.arange(400) % 5
    design = Design.of(list(pdf.columns[:12]))
    found = logistic.penalised_path(spark.createDataFrame(pdf).repartition(3), design, "y", alpha, "fold", count=30)
    assert len(found.penalties) == len(found.betas) == len(found.log_loss) == 30
    assert all(found.settled) and found.best_fit().converged
    if alpha:
        assert np.allclose(found.betas[0][1:], 0, atol=1e-4)
        assert (found.betas[-1][1:] != 0).sum() > 6
    # The last fit again, with plain gradient conditions.
    full, s = design.matrix(pdf), x.std(axis=0)
    s[11] = pdf.c11.std(ddof=0)
    for beta, penalty in ((found.betas[-1], found.penalties[-1]), (found.betas[14], found.penalties[14])):
        pull = full.T @ (pdf.y - 1 / (1 + np.exp(-full @ beta))) / 400
        u = beta[1:] * s
        rest = pull[1:] / s - (1 - alpha) * penalty * u
        assert abs(pull[0]) < 1e-4
        assert np.all(np.abs(rest) <= alpha * penalty + 1e-4)
        assert np.allclose(rest[u != 0], alpha * penalty * np.sign(u[u != 0]), atol=1e-4)


@pytest.mark.parametrize("penalty", [2.0, 0.5, 0.1])
def test_lasso_with_patient_effects_meets_its_conditions(spark, penalty):
    pdf = lasso_frame()
    m = lasso.entity_moments(spark.createDataFrame(pdf).repartition(4), Design.of(["u", "v", "w"]), "y", "p", 0, "fold", 4)
    point = lasso.path(m, [5.0, penalty], cross_validate=False)[-1]
    effects = {r.p: r.effect for r in lasso.entity_effects(m, point).collect()}
    x, own = dense(pdf, 0)
    beta = np.concatenate([point.theta[1:], [effects[p] for p in own]])
    residual = pdf.y.to_numpy() - point.theta[0] - x @ beta
    s = x.std(axis=0)
    pull = x.T @ residual / len(pdf) / s
    assert abs(residual.mean()) < 1e-3
    assert np.all(np.abs(pull) <= penalty + 2e-3)
    used = np.abs(beta) > 1e-6
    assert np.allclose(pull[used], penalty * np.sign(beta[used]), atol=2e-3)
    assert math.isclose(point.explained, 1 - residual.var() / pdf.y.var(ddof=0), rel_tol=1e-6)


def test_ridge_with_patient_effects_equals_the_closed_form(spark):
    pdf = lasso_frame()
    m = lasso.entity_moments(spark.createDataFrame(pdf), Design.of(["u", "v", "w"]), "y", "p", 0, "fold", 4)
    point = lasso.path(m, [0.7], alpha=0.0, cross_validate=False)[0]
    x, own = dense(pdf, 0)
    centred = x - x.mean(axis=0)
    y = pdf.y.to_numpy() - pdf.y.mean()
    beta = np.linalg.solve(centred.T @ centred + len(pdf) * 0.7 * np.diag(x.var(axis=0)), centred.T @ y)
    assert np.allclose(point.theta[1:], beta[:3], atol=1e-4)
    effects = {r.p: r.effect for r in lasso.entity_effects(m, point, 0.0).collect()}
    assert np.allclose([effects[p] for p in own], beta[3:], atol=1e-4)


def test_left_out_error_equals_scoring_the_fold(spark):
    pdf = lasso_frame()
    df = spark.createDataFrame(pdf)
    design = Design.of(["u", "v", "w"])
    m = lasso.entity_moments(df, design, "y", "p", 0, "fold", 4)
    point = lasso.path(m, [5.0, 0.5])[-1]
    total = 0.0
    for fold in range(4):
        rest = lasso.entity_moments(df.where(F.col("fold") != fold), design, "y", "p", 0, "fold", 4)
        own = lasso.path(rest, [5.0, 0.5], cross_validate=False)[-1]
        scored = lasso.predict(df.where(F.col("fold") == fold), rest, own, ["y"], "f")
        total += scored.agg(F.sum((F.col("y") - F.col("f")) ** 2)).first()[0]
    assert math.isclose(point.cv_mse, total / len(pdf), rel_tol=1e-3)


def test_all_effects_vanish_at_the_largest_penalty(spark):
    m = lasso.entity_moments(spark.createDataFrame(lasso_frame()), Design.of(["u", "v", "w"]), "y", "p", 0, "fold", 4)
    top = lasso.largest_penalty(m)
    at, below = lasso.path(m, [top * 1.0001, top * 0.95], cross_validate=False)
    assert at.explained < 1e-6 < below.explained
    assert len(lasso.default_penalties(m, 20)) == 20


@pytest.mark.parametrize("alpha", [1.0, 0.5, 0.0])
def test_whole_path_settles_and_is_the_same_in_tasks_and_in_passes(spark, alpha):
    pdf = lasso_frame()
    m = lasso.entity_moments(spark.createDataFrame(pdf).repartition(3), Design.of(["u", "v", "w"]), "y", "p", 0, "fold", 4)
    penalties = lasso.default_penalties(m, 12)
    tasks = lasso.path(m, penalties, alpha)
    passes = lasso.path(m, penalties, alpha, numbers_in_task=0)
    assert len(tasks) == len(passes) == 12
    for a, b in zip(tasks, passes, strict=True):
        assert a.settled and b.settled
        assert max(a.violation, b.violation) <= 1e-6
        assert np.allclose(a.theta, b.theta, atol=1e-6)
        assert math.isclose(a.cv_mse, b.cv_mse, rel_tol=1e-6)


@pytest.mark.parametrize("alpha", [1.0, 0.0])
def test_passes_over_the_entities_serve_all_penalties_and_folds(spark, monkeypatch, alpha):
    """Passes do not grow with the number of penalties, and some entities only give the starts."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(900, 4)), columns=list("uvwt"))
    pdf["p"], pdf["fold"] = rng.integers(0, 150, 900), rng.integers(0, 4, 900).astype(np.int32)
    pdf["t"] = pdf.groupby("p")["t"].transform("mean")
    pdf["y"] = pdf.u - pdf.t + rng.normal(0, 1, 150)[pdf.p] + rng.normal(0, 1, 900)
    m = lasso.entity_moments(spark.createDataFrame(pdf).repartition(3), Design.of(list("uvwt")), "y", "p", 0, "fold", 4)
    penalties = lasso.default_penalties(m, 30)
    tasks = lasso.path(m, penalties, alpha)
    plain, passes = lasso.summed_matrices, []
    monkeypatch.setattr(lasso, "summed_matrices", lambda *args: passes.append(1) or plain(*args))
    monkeypatch.setattr(lasso, "NUMBERS_TO_START", 2_000)
    found = lasso.path(m, penalties, alpha, numbers_in_task=0)
    assert len(passes) <= 120
    assert all(p.settled for p in found)
    for a, b in zip(tasks, found, strict=True):
        assert np.allclose(a.theta, b.theta, atol=1e-2)
        assert math.isclose(a.cv_mse, b.cv_mse, rel_tol=1e-4)


def test_lasso_fits_every_penalty_past_the_least_error(spark, monkeypatch):
    """More columns than the folds can tell apart: the error rises again and the path goes on."""
    rng = np.random.default_rng(8)
    names = [f"c{i}" for i in range(40)]
    pdf = pd.DataFrame(rng.normal(size=(90, 40)), columns=names)
    pdf["p"], pdf["fold"] = rng.integers(0, 12, 90), np.arange(90, dtype=np.int32) % 4
    # Columns that are constant within an entity compete with its effect.
    for c in names[:8]:
        pdf[c] = pdf.groupby("p")[c].transform("mean")
    pdf["y"] = pdf.c10 + rng.normal(0, 1, 90)
    m = lasso.entity_moments(spark.createDataFrame(pdf).repartition(2), Design.of(names), "y", "p", 0, "fold", 4)
    monkeypatch.setattr(forecast, "forecast_moments", lambda features: m)
    points = forecast.fit_forecast(None, 1.0).points
    assert len(points) == 100
    assert all(p.settled for p in points)
    assert lasso.best_point(points).penalty > points[-20].penalty


def test_ridge_fits_every_penalty_where_the_error_only_grows(spark, monkeypatch):
    pdf = lasso_frame().assign(y=np.random.default_rng(3).normal(0, 1, len(lasso_frame())))
    m = lasso.entity_moments(spark.createDataFrame(pdf).repartition(2), Design.of(["u", "v", "w"]), "y", "p", 0, "fold", 4)
    monkeypatch.setattr(forecast, "forecast_moments", lambda features: m)
    assert len(forecast.fit_forecast(None, 0.0).points) == 100


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centres = [(0, 0, 0), (10, 0, 5), (0, 12, -5)]
    points = [tuple(float(round(v)) for v in rng.normal(c, 1.0)) for c in centres for _ in range(20)]
    return spark.createDataFrame(points, "x double, y double, z double")


def test_kmeans_finds_the_blobs(blobs):
    columns = ["x", "y", "z"]
    points = counted_points(blobs, columns).cache()
    best = best_runs(fit_runs(points, columns, [2, 3, 4], 8, 50))
    assert best[2].withinss > best[3].withinss > best[4].withinss
    labelled = blobs.withColumn("cluster", nearest_centre(columns, best[3].centres))
    table = inertia(labelled, columns, best[3].centres, "cluster").collect()
    assert [r.n for r in table] == [20, 20, 20]
    assert math.isclose(sum(r.withinss for r in table), best[3].withinss, rel_tol=1e-9)
    with pytest.raises(ValueError):
        fit_runs(points, columns, [100], 1, 5)


@pytest.fixture
def uncoalesced(spark):
    """Shuffle partitions stay apart, as they do when they are large."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("block", [4, 2048])
def test_silhouette_equals_brute_force(blobs, monkeypatch, uncoalesced, block):
    import waveline.operators.silhouette as module

    monkeypatch.setattr(module, "POINTS_PER_BLOCK", block)
    columns = ["x", "y", "z"]
    centres = [(0, 0, 0), (10, 0, 5), (0, 12, -5), (90, 90, 90)]
    alone = blobs.union(blobs.limit(1).selectExpr("80D", "80D", "80D"))
    points = counted_points(alone, columns).withColumn("c", nearest_centre(columns, centres)).cache()
    ours = {(r.x, r.y, r.z): r.silhouette for r in silhouettes(points, columns, {"c": 4}).collect()}
    assert silhouettes(points, columns, {"c": 4}).count() == len(ours)
    pdf = points.toPandas()
    pdf = pdf.loc[pdf.index.repeat(pdf[WEIGHT])].reset_index(drop=True)
    x, c = pdf[columns].to_numpy(), pdf.c.to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(len(x)):
        mates = (c == c[i]) & (np.arange(len(x)) != i)
        if not mates.any():
            score = 0.0
        else:
            inside = d[i][mates].mean()
            outside = min(d[i][c == k].mean() for k in set(c) - {c[i]})
            score = (outside - inside) / max(inside, outside)
        scores.append(score)
        assert math.isclose(ours[tuple(x[i])], score, abs_tol=1e-9)
    mean = mean_silhouettes(silhouettes(points, columns, {"c": 4})).first().silhouette
    assert math.isclose(mean, float(np.mean(scores)), abs_tol=1e-9)


def test_z_scores(blobs):
    row = z_scores(blobs, ["x", "y"]).agg(F.avg("x"), F.stddev_samp("x"), F.avg("y"), F.stddev_samp("y")).first()
    assert np.allclose(list(row), [0, 1, 0, 1], atol=1e-9)


def test_density_integrates_to_one_and_histogram_counts_all(spark):
    df = spark.createDataFrame([("a", float(v % 17)) for v in range(200)] + [("b", 5.0)] * 3, "g string, v double")
    out = density(df, ["g"], "v", -40, 60, 801).toPandas()
    for _, part in out.groupby("g"):
        assert math.isclose(np.trapezoid(part.sort_values("x").density, part.sort_values("x").x), 1.0, rel_tol=1e-2)
    assert histogram(df, ["g"], "v", 0, 20, 5).agg(F.sum("n")).first()[0] == 203


def test_polynomial_trend_recovers_a_curve(spark):
    rows = [(g, float(x), k + 2.0 * x - 0.5 * x**2) for g, k in (("a", 1.0), ("b", 4.0)) for x in range(8)]
    table = polynomial_trend(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y", 2)
    found = {(r.g, r.power): r.estimate for r in table.collect()}
    assert math.isclose(found["a", 0], 1.0, abs_tol=1e-6) and math.isclose(found["b", 0], 4.0, abs_tol=1e-6)
    assert math.isclose(found["a", 1], 2.0, abs_tol=1e-6) and math.isclose(found["b", 2], -0.5, abs_tol=1e-6)


def test_degree_sweep_train_error_never_rises(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"AssessmentID": np.arange(400), "TreatmentWeek": rng.integers(0, 12, 400)})
    pdf["TxGroup"] = rng.choice(["Control", "Treatment"], 400)
    pdf["BaselinePANSS_Total"] = rng.integers(60, 120, 400)
    pdf["PANSS_Total"] = pdf.BaselinePANSS_Total - pdf.TreatmentWeek**1.5 + rng.normal(0, 3, 400)
    table = degree_sweep(spark.createDataFrame(pdf), 5).orderBy("degree").toPandas()
    assert np.all(np.diff(table.train_rmse) <= 1e-6) and len(table) == 5 and (table.test_rmse > 0).all()


def test_degree_sweep_has_the_items_and_equals_numpy(spark):
    rng = np.random.default_rng(4)
    n = 900
    pdf = pd.DataFrame({"AssessmentID": np.arange(n), "TreatmentWeek": rng.integers(0, 12, n)})
    pdf["TxGroup"] = rng.choice(["Control", "Treatment"], n)
    pdf["Country"] = rng.choice(["A", "B", "C"], n)
    for c in BASE_ITEMS:
        pdf[c] = rng.integers(1, 8, n)
    pdf["BaselinePANSS_Total"] = pdf[BASE_ITEMS].sum(axis=1)
    pdf["PANSS_Total"] = pdf.BaselinePANSS_Total - pdf.TreatmentWeek * pdf.BaselineP1 + 4 * (pdf.Country == "B") + rng.normal(0, 1, n)
    df = spark.createDataFrame(pdf)
    found = degree_sweeps(df, 2).where("degree = 2").toPandas().set_index("model")
    drawn = {r[0] for r in split_rows(df, "AssessmentID", 0.5)[0].select("AssessmentID").collect()}
    week, treated = pdf.TreatmentWeek.to_numpy(dtype=float) / 11, (pdf.TxGroup == "Treatment").to_numpy(dtype=float)
    items = pdf[BASE_ITEMS].to_numpy(dtype=float)
    sides = np.column_stack([np.ones(n), items, treated])
    x = np.column_stack([sides, pdf.Country == "B", pdf.Country == "C", items * treated[:, None], *(sides * week[:, None] ** d for d in (1, 2))]).astype(float)
    train = pdf.AssessmentID.isin(drawn).to_numpy()
    beta = np.linalg.lstsq(x[train], pdf.PANSS_Total[train], rcond=None)[0]
    left = pdf.PANSS_Total - x @ beta
    assert math.isclose(found.train_rmse["items"], (left[train] ** 2).mean() ** 0.5, rel_tol=1e-5)
    assert math.isclose(found.test_rmse["items"], (left[~train] ** 2).mean() ** 0.5, rel_tol=1e-5)
    assert found.test_rmse["items"] < found.test_rmse["total"]


def test_degree_ten_equals_least_squares_by_numpy(spark):
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"AssessmentID": np.arange(n), "TreatmentWeek": rng.integers(0, 25, n)})
    pdf["TxGroup"] = rng.choice(["Control", "Treatment"], n)
    pdf["BaselinePANSS_Total"] = rng.integers(60, 120, n)
    pdf["PANSS_Total"] = pdf.BaselinePANSS_Total - 10 * np.sin(pdf.TreatmentWeek / 3) + rng.normal(0, 3, n)
    df = spark.createDataFrame(pdf).repartition(5)
    found = degree_sweep(df, 10).orderBy("degree").toPandas()
    drawn = {r[0] for r in split_rows(df, "AssessmentID", 0.5)[0].select("AssessmentID").collect()}
    train = pdf.AssessmentID.isin(drawn).to_numpy()
    treated, base = (pdf.TxGroup == "Treatment").to_numpy(dtype=float), (pdf.BaselinePANSS_Total - 90) / 17
    sides = np.column_stack([np.ones(n), base, treated])
    for degree in (1, 4, 10):
        t = np.polynomial.legendre.legvander(pdf.TreatmentWeek / 12 - 1, degree)
        x = np.column_stack([base * treated, *(sides * t[:, [d]] for d in range(degree + 1))])
        q, r = np.linalg.qr(x[train])
        left = pdf.PANSS_Total - x @ np.linalg.solve(r, q.T @ pdf.PANSS_Total[train])
        assert math.isclose(found.train_rmse[degree - 1], (left[train] ** 2).mean() ** 0.5, rel_tol=1e-8)
        assert math.isclose(found.test_rmse[degree - 1], (left[~train] ** 2).mean() ** 0.5, rel_tol=1e-8)


def test_degree_sweep_of_few_weeks_keeps_the_rank(spark):
    """More degrees than weeks: columns that add nothing change no error."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"AssessmentID": np.arange(600), "TreatmentWeek": rng.integers(0, 4, 600), "TxGroup": rng.choice(["Control", "Treatment"], 600)})
    pdf["BaselinePANSS_Total"] = rng.integers(60, 120, 600)
    pdf["PANSS_Total"] = pdf.BaselinePANSS_Total - pdf.TreatmentWeek**2 + rng.normal(0, 3, 600)
    table = degree_sweep(spark.createDataFrame(pdf), 10).orderBy("degree").toPandas()
    assert np.allclose(table.train_rmse[2:], table.train_rmse[2], rtol=1e-8)
    assert np.allclose(table.test_rmse[2:], table.test_rmse[2], rtol=1e-8)


def test_ill_conditioned_fit_keeps_its_digits(spark):
    """Raw powers up to ten: products of columns would keep hardly a digit."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"x": rng.uniform(0, 1, 4000)})
    pdf["y"] = np.cos(4 * pdf.x) + rng.normal(0, 0.01, 4000)
    for d in range(1, 11):
        pdf[f"x{d}"] = pdf.x**d
    design = Design.of([f"x{d}" for d in range(1, 11)])
    fit = ols.fit(spark.createDataFrame(pdf).repartition(7), design, "y")
    x = design.matrix(pdf)
    beta, rss, *_ = np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)
    assert fit.kept == list(range(11))
    assert math.isclose(fit.rss, float(rss[0]), rel_tol=1e-8)
    assert np.allclose(x @ fit.beta, x @ beta, rtol=1e-8, atol=1e-8)
    assert np.allclose(fit.beta, beta, rtol=1e-5)


def test_pass_model_equals_plain_numpy_on_the_panel(spark):
    """The factorial without flags, refitted on rows that DuckDB derives."""
    import duckdb

    from waveline.catalog.registry import panel
    from waveline.catalog.sql import ORDER, PANEL
    from waveline.plans.visit_check import CROSSED_ITEMS, check_features, labelled_rows

    folder = "/root/testdata/sf0.01"
    rows = labelled_rows(check_features(panel(spark, folder), spread="row"))
    design = Design.of(
        [*crossed("TxGroup", "TreatmentWeek"), *crossed(*CROSSED_ITEMS)],
        levels=factor_levels(rows, ["TxGroup"]),
        shift=numeric_shift(rows, ["TreatmentWeek", *CROSSED_ITEMS]),
    )
    fit = logistic.fit(rows, design, "passed")

    con = duckdb.connect()
    for table in ("orders", "customer", "nation"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    lags = ", ".join(f"coalesce(lag({c}) over ({ORDER}), 0) as Lag{c}" for c in CROSSED_ITEMS[:4])
    pdf = con.execute(
        f"""with {PANEL} select * from (
        select *, row_number() over (partition by PatientID {ORDER}) - 1 as TreatmentWeek, {lags} from panel)
        where Study <> 'E'"""
    ).df()
    x, y = design.matrix(pdf), (pdf.LeadStatus == "Passed").to_numpy(dtype=float)
    beta = np.zeros(x.shape[1])
    for _ in range(12):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ beta))
    deviance = -2 * np.sum(np.log(np.where(y > 0.5, mu, 1 - mu)))
    assert fit.rows == len(pdf) == 11_915 and fit.converged
    assert math.isclose(fit.deviance, deviance, abs_tol=1e-6)
    assert np.allclose(fit.beta, beta, atol=1e-5)


def test_starts_come_from_all_points_at_any_partitioning(spark):
    from waveline.operators.kmeans import _starts

    points = spark.range(5000).selectExpr("cast(id as double) as x", "cast(id * id % 97 as double) as y", "1L as n_rows")
    keys = [(k, s) for k in (2, 5) for s in range(3)]
    found = [_starts(points.repartition(n), ["x", "y"], keys, 2) for n in (1, 4, 13)]
    for other in found[1:]:
        assert all(np.array_equal(found[0][key], other[key]) for key in keys)
    assert all(len({tuple(c) for c in found[0][k, s]}) == k for k, s in keys)
    assert max(c[0] for centres in found[0].values() for c in centres) > 4000
    with pytest.raises(ValueError, match="distinct points"):
        _starts(points.limit(3), ["x", "y"], keys, 2)
