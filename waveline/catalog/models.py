"""Regressions, comparisons, classification and their scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from waveline.catalog.registry import query, shared_table, visits
from waveline.catalog.scans import checks, features
from waveline.catalog.sql import PANEL, TREATMENT, VISITS, with_
from waveline.catalog.tables import _CHECKS, rounded
from waveline.operators import logistic, ols
from waveline.operators.design import design_rows
from waveline.operators.lasso import entity_effects, path, rmse
from waveline.operators.moments import cross_products, product_table
from waveline.operators.split import split_rows
from waveline.plans.effects import (
    degree_sweeps,
    effect_comparison,
    effect_design,
    effect_models,
    polynomial_trend,
    pure_power_trend,
)
from waveline.plans.forecast import (
    fit_forecast,
    forecast_moments,
    grid_penalties,
    holdout_rmse,
    path_table,
    predicted,
    split,
    target_forecast,
)
from waveline.plans.treatment import treatment_data
from waveline.plans.visit_check import (
    TEST_SHARE,
    accuracies,
    accuracy,
    check_design,
    given_probability,
    labelled_rows,
    pass_probabilities,
    penalised_classes,
    penalised_check,
    penalised_probabilities,
    random_classes,
)
from waveline.functions.scores import threshold_class
from waveline.sources.panel_csv import SCORE


def treated(spark, sf_dir):
    """Rows of the effect models."""
    return shared_table(spark, sf_dir, "treatment", lambda: treatment_data(visits(spark, sf_dir)))


_FULL = "study_group_baseline"
_COLUMNS = ["1"]
_NAMES = ["(Intercept)"]
_STUDY = {s: f"(Study = '{s}')::int" for s in "BCDE"}
_TX = "(TxGroup = 'Treatment')::int"
_COLUMNS += [*_STUDY.values(), _TX, "BaselinePANSS"]
_NAMES += [*[f"Study{s}" for s in _STUDY], "TxGroupTreatment", "BaselinePANSS"]
_COLUMNS += [f"{v} * {_TX}" for v in _STUDY.values()] + [f"{v} * BaselinePANSS" for v in _STUDY.values()]
_NAMES += [f"Study{s}:TxGroupTreatment" for s in _STUDY] + [f"Study{s}:BaselinePANSS" for s in _STUDY]
_COLUMNS += [f"{_TX} * BaselinePANSS"] + [f"{v} * {_TX} * BaselinePANSS" for v in _STUDY.values()]
_NAMES += ["TxGroupTreatment:BaselinePANSS"] + [f"Study{s}:TxGroupTreatment:BaselinePANSS" for s in _STUDY]

_DESIGN = TREATMENT + f""",
design as (
  select PatientID * 1000 + TreatmentWeek as id, unnest({_NAMES!r}) as term,
         unnest([{', '.join(f'cast({c} as double)' for c in _COLUMNS)}]) as value
  from data where BaselinePANSS is not null)"""


@query("m10_design_sums", with_(_DESIGN, "select term, round(sum(value), 3) as total from design group by term"))
def design_sums(spark, sf_dir):
    data = treated(spark, sf_dir)
    design = effect_design(data, _FULL)
    names = F.array(*[F.lit(n) for n in design.names])
    total = design_rows(data, design, ["PatientID"]).agg(vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("x"))
    return total.select(F.posexplode("x").alias("j", "total")).select(F.get(names, F.col("j")).alias("term"), F.round("total", 3).alias("total"))


@query(
    "m6_moments",
    with_(_DESIGN + f""",
response as (
  select id, term, value from design union all
  select PatientID * 1000 + TreatmentWeek as id, 'PANSS_Total', cast(PANSS_Total as double) from data where BaselinePANSS is not null)""", """
select a.term, b.term as other, sum(a.value * b.value) as value
from response a join response b on a.id = b.id group by all"""),
)
def moments(spark, sf_dir):
    data = treated(spark, sf_dir)
    design = effect_design(data, _FULL)
    return product_table(cross_products(data, design, SCORE), [*design.names, SCORE]).drop("group")


@query("m7_coefficients")
def coefficients(spark, sf_dir):
    return ols.coefficient_table(spark, effect_models(treated(spark, sf_dir))).drop("low", "high")


@query("m7_model_summary")
def model_summary(spark, sf_dir):
    return ols.summary_table(spark, effect_models(treated(spark, sf_dir)))


@query("m8_model_comparison")
def comparison(spark, sf_dir):
    return effect_comparison(treated(spark, sf_dir))


@query("m9_confidence_intervals")
def intervals(spark, sf_dir):
    table = ols.coefficient_table(spark, effect_models(treated(spark, sf_dir)))
    return table.select("model", "term", "low", "high")


# The models have closed forms: crossed factors are cell means, a crossed
# covariate is one line per cell.
_LINE = "regr_syy(PANSS_Total, BaselinePANSS) - regr_sxy(PANSS_Total, BaselinePANSS) ** 2 / regr_sxx(PANSS_Total, BaselinePANSS)"
_FITS = TREATMENT + f""",
kept as (select * from data where BaselinePANSS is not null),
whole as (select count(*) as rows, var_pop(PANSS_Total) * count(*) as tss from kept),
parts as (
  select 'study_group_baseline' as model, 2 as size, {_LINE} as rss from kept group by Study, TxGroup
  union all select 'study_group', 1, var_pop(PANSS_Total) * count(*) from kept group by Study, TxGroup
  union all select 'baseline_group', 2, {_LINE} from kept group by TxGroup),
fits as (
  select model, rows, rows - sum(size)::bigint as res_df, sum(size)::bigint - 1 as f_df, sum(rss) as rss, any_value(tss) as tss
  from parts, whole group by model, rows)"""


@query(
    "m7_model_fit",
    with_(_FITS, """select model, rows, res_df, f_df, round(sqrt(rss / res_df), 6) as sigma, round(1 - rss / tss, 6) as r2,
        round(1 - rss / tss * (rows - 1) / res_df, 6) as adj_r2, round((tss - rss) / f_df / (rss / res_df), 4) as f from fits"""),
)
def model_fit(spark, sf_dir):
    table = ols.summary_table(spark, effect_models(treated(spark, sf_dir))).drop("p")
    return rounded(table, "sigma", "r2", "adj_r2").withColumn("f", F.round("f", 4))


@query(
    "m8_comparison_steps",
    with_(_FITS, """, steps as (
  select model, res_df, rss, lag(res_df) over o - res_df as df, lag(rss) over o - rss as sum_sq,
         last_value(rss / res_df) over (order by res_df desc rows between unbounded preceding and unbounded following) as scale
  from fits window o as (order by res_df desc))
select model, res_df, round(rss, 4) as rss, df, round(sum_sq, 4) as sum_sq, round(sum_sq / df / scale, 4) as f from steps"""),
)
def comparison_steps(spark, sf_dir):
    table = effect_comparison(treated(spark, sf_dir)).drop("p")
    return table.withColumns({c: F.round(c, 4) for c in ("rss", "sum_sq", "f")})


_EFFECTS = _FITS + f""",
cell as (select Study, TxGroup, avg(PANSS_Total) as m, 1.0::double / count(*) as v from kept group by Study, TxGroup),
sd as (select sqrt(rss / res_df) as sigma, res_df from fits where model = 'study_group'),
pick as (
  select * from (values ('(Intercept)', 'A', 'Control', 1), ('TxGroupTreatment', 'A', 'Treatment', 1), ('TxGroupTreatment', 'A', 'Control', -1)) v(term, Study, TxGroup, w)
  {" ".join(
      f"union all select * from (values ('Study{s}', '{s}', 'Control', 1), ('Study{s}', 'A', 'Control', -1),"
      f" ('Study{s}:TxGroupTreatment', '{s}', 'Treatment', 1), ('Study{s}:TxGroupTreatment', '{s}', 'Control', -1),"
      f" ('Study{s}:TxGroupTreatment', 'A', 'Treatment', -1), ('Study{s}:TxGroupTreatment', 'A', 'Control', 1)) v(term, Study, TxGroup, w)"
      for s in "BCDE")}),
effects as (
  select term, sum(w * m) as estimate, sqrt(sum(v)) * any_value(sigma) as std_error, any_value(res_df)::double as df
  from pick join cell using (Study, TxGroup), sd group by term)"""


@query(
    "m7_cell_effects",
    with_(_EFFECTS, "select term, round(estimate, 6) as estimate, round(std_error, 6) as std_error, round(estimate / std_error, 4) as t from effects"),
)
def cell_effects(spark, sf_dir):
    table = ols.coefficient_table(spark, effect_models(treated(spark, sf_dir))).where("model = 'study_group'")
    return rounded(table.select("term", "estimate", "std_error", F.round("t", 4).alias("t")), "estimate", "std_error")


# The quantile of t by its expansion in 1 / df around the normal one.
_Z = 1.959963984540054
_T = f"({_Z} + {(_Z**3 + _Z) / 4!r} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / (df * df))"


@query(
    "m9_cell_intervals",
    with_(_EFFECTS, f"select term, round(estimate - {_T} * std_error, 4) as low, round(estimate + {_T} * std_error, 4) as high from effects"),
)
def cell_intervals(spark, sf_dir):
    table = ols.coefficient_table(spark, effect_models(treated(spark, sf_dir))).where("model = 'study_group'")
    return table.select("term", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))



@query(
    "m24_line_per_group",
    with_(TREATMENT, " union all ".join(
        f"""select TxGroup, cast({p} as int) as power,
        round(regr_intercept(PANSS_Total, TreatmentWeek ** {p}), 6) as intercept,
        round(regr_slope(PANSS_Total, TreatmentWeek ** {p}), 6) as slope from data group by TxGroup"""
        for p in (1, 2, 3, 4))),
)
def lines(spark, sf_dir):
    table = pure_power_trend(treated(spark, sf_dir), "TxGroup", "TreatmentWeek", SCORE)
    return rounded(table, "intercept", "slope")


@query("m24_curve_per_study")
def curves(spark, sf_dir):
    return polynomial_trend(treated(spark, sf_dir), "Study", "TreatmentWeek", SCORE, 4)


@query(
    "m24_curve_values",
    with_(TREATMENT, "select Study, TreatmentWeek, round(avg(PANSS_Total), 4) as value from data group by all"),
)
def curve_values(spark, sf_dir):
    """The curve of degree 4 at the five weeks, where it meets the cell means."""
    data = treated(spark, sf_dir)
    weeks = data.select("Study", "TreatmentWeek").distinct()
    terms = polynomial_trend(data, "Study", "TreatmentWeek", SCORE, 4).join(weeks, "Study")
    value = F.sum(F.col("estimate") * F.when(F.col("power") == 0, F.lit(1.0)).otherwise(F.pow("TreatmentWeek", "power")))
    return terms.groupBy("Study", "TreatmentWeek").agg(F.round(value, 4).alias("value"))


@query("m23_degree_sweep")
def degrees(spark, sf_dir):
    return degree_sweeps(features(spark, sf_dir).where("Study = 'E'"))


_GIVEN = {"P1": -0.3, "N1": 0.2, "CompositeScore": 0.05}
_ETA = "1.5::double + " + " + ".join(f"{c} * ({w})::double" for c, w in _GIVEN.items())


@query(
    "m18_given_probability",
    with_(_CHECKS, f"select AssessmentID, round(1 / (1 + exp(-({_ETA}))), 6) as probability from flagged"),
)
def given(spark, sf_dir):
    rows = checks(spark, sf_dir).select("AssessmentID", given_probability(1.5, _GIVEN).alias("probability"))
    return rounded(rows, "probability")


_SCORED = _CHECKS + f""",
scored as (
  select AssessmentID, LeadStatus, case when 1 / (1 + exp(-({_ETA}))) > 0.8 then 'P' else 'NP' end as class
  from flagged where Study <> 'E')"""


def _scored(spark, sf_dir):
    rows = checks(spark, sf_dir).where("Study <> 'E'")
    return rows.withColumn("class", threshold_class(given_probability(1.5, _GIVEN), 0.8))


@query(
    "a7_accuracy",
    with_(_SCORED, "select round(avg((class = LeadStatus)::int), 6) as accuracy from scored"),
)
def given_accuracy(spark, sf_dir):
    return rounded(accuracy(_scored(spark, sf_dir), "class", "LeadStatus"), "accuracy")


@query("a17_confusion", with_(_SCORED, "select class, LeadStatus, count(*) as n from scored group by all"))
def confusion(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("class", "LeadStatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a8_rmse",
    with_(VISITS, """
        select round(sqrt(avg((BaselineTotal - PANSS_Total) ** 2)), 6) as rmse from (
          select PANSS_Total, first_value(PANSS_Total) over (partition by PatientID order by VisitDay) as BaselineTotal
          from visits)"""),
)
def baseline_rmse(spark, sf_dir):
    rows = features(spark, sf_dir)
    return rounded(rmse(rows, "BaselinePANSS_Total", SCORE), "rmse")


_DRAW = "cast('0x' || substr(md5('{seed}:' || cast(AssessmentID as varchar)), 1, 8) as bigint) / 4294967296.0"


@query(
    "m19_random_baseline",
    with_(PANEL, f"""select round(avg((class = LeadStatus)::int), 6) as accuracy from (
        select case when {_DRAW.format(seed=3)} > 0.8 then 'P' else 'NP' end as class,
               case when LeadStatus = 'Passed' then 'P' else 'NP' end as LeadStatus
        from panel where Study <> 'E' and {_DRAW.format(seed=2)} >= 0.5)"""),
)
def random_baseline(spark, sf_dir):
    train = split_rows(labelled_rows(checks(spark, sf_dir)), "AssessmentID", TEST_SHARE)[1]
    return rounded(accuracy(random_classes(train, "AssessmentID", 3), "class", "LeadStatus"), "accuracy")


@query("m17_logistic_fit")
def logistic_fit(spark, sf_dir):
    rows = labelled_rows(checks(spark, sf_dir))
    train = split_rows(rows, "AssessmentID", TEST_SHARE)[1]
    model = logistic.fit(train, check_design(rows), "passed")
    return spark.createDataFrame(model.coefficients(), "term string, estimate double")


@query(
    "m17_score_equations",
    with_(_CHECKS, """select TxGroup, count(*) as n, sum(case when LeadStatus = 'P' then 1 else 0 end)::double as passed
        from flagged where Study <> 'E' group by TxGroup"""),
)
def score_equations(spark, sf_dir):
    """At the fit the probabilities of each group add up to its passed rows, as the group is a term."""
    rows = labelled_rows(checks(spark, sf_dir))
    model = logistic.fit(rows, check_design(rows), "passed")
    scored = logistic.predict(rows, model, ["TxGroup"])
    return scored.groupBy("TxGroup").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("probability"), 3).alias("passed"))


@query(
    "m20_scored_rows",
    with_(_CHECKS, "select AssessmentID, true as valid from flagged where Study = 'E'"),
)
def scored_rows(spark, sf_dir):
    found = pass_probabilities(checks(spark, sf_dir))
    probability = [c for c in found.columns if c != "AssessmentID"][0]
    return found.select("AssessmentID", F.col(probability).between(0, 1).alias("valid"))


@query("m19_accuracies")
def model_accuracies(spark, sf_dir):
    return accuracies(checks(spark, sf_dir))


@query("m20_pass_probabilities")
def target_probabilities(spark, sf_dir):
    return pass_probabilities(checks(spark, sf_dir))


_FORECASTS: dict = {}


def forecast_model(spark, sf_dir, alpha):
    """The cross-validated model, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, alpha)
    if key not in _FORECASTS:
        _FORECASTS[key] = fit_forecast(features(spark, sf_dir), alpha)
    return _FORECASTS[key]


@query("m11_shared_coefficients")
def shared_coefficients(spark, sf_dir):
    model = forecast_model(spark, sf_dir, 1.0)
    rows = [(t, float(b)) for t, b in zip(model.moments.design.names, model.best.theta)]
    return spark.createDataFrame(rows, "term string, estimate double")


@query("m13_lasso_path")
def lasso_path(spark, sf_dir):
    points = path(forecast_moments(features(spark, sf_dir)), grid_penalties(), cross_validate=False)
    rows = [(i, p.penalty, float(p.explained), int((p.theta[1:] != 0).sum()), p.settled) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "step int, penalty double, explained double, shared_terms int, settled boolean")


@query("m14_cross_validation")
def cross_validation(spark, sf_dir):
    return path_table(features(spark, sf_dir), forecast_model(spark, sf_dir, 1.0))


@query("t6_best_penalty")
def best_penalty(spark, sf_dir):
    table = path_table(features(spark, sf_dir), forecast_model(spark, sf_dir, 1.0))
    return table.agg(F.min_by("penalty", "cv_mse").alias("penalty"))


@query("m15_holdout_rmse")
def lasso_rmse(spark, sf_dir):
    return holdout_rmse(features(spark, sf_dir), forecast_model(spark, sf_dir, 1.0))


@query("j8_keyed_predictions")
def keyed_predictions(spark, sf_dir):
    test = split(features(spark, sf_dir))[1]
    return predicted(test, forecast_model(spark, sf_dir, 1.0), ["AssessmentID", "PatientID", SCORE])


@query(
    "j8_predicted_rows",
    with_(VISITS, f"""select AssessmentID, PatientID, PANSS_Total from visits
        where Study = 'E' and {_DRAW.format(seed=2)} >= 0.7"""),
)
def predicted_rows(spark, sf_dir):
    return keyed_predictions(spark, sf_dir).where("predicted is not null").select("AssessmentID", "PatientID", SCORE)


@query("m15_patient_effects")
def patient_effects(spark, sf_dir):
    model = forecast_model(spark, sf_dir, 1.0)
    return entity_effects(model.moments, model.best)


@query("m16_target_forecast")
def week_forecast(spark, sf_dir):
    return target_forecast(features(spark, sf_dir), forecast_model(spark, sf_dir, 1.0))


@query(
    "m16_forecast_rows",
    with_(VISITS, """, target as (select PatientID, PANSS_Total from visits where Study = 'E' and Week = 18)
select p.PatientID, t.PANSS_Total::double as actual
from (select distinct PatientID from visits where Study = 'E') p left join target t on p.PatientID = t.PatientID"""),
)
def forecast_rows(spark, sf_dir):
    """Every patient has a score at the target; where one was measured, it is that one."""
    known = features(spark, sf_dir).where("Study = 'E' and Week = 18").select("PatientID").distinct().withColumn("known", F.lit(True))
    table = target_forecast(features(spark, sf_dir), forecast_model(spark, sf_dir, 1.0)).where(F.col(SCORE).isNotNull())
    return table.join(known, "PatientID", "left").select("PatientID", F.when(F.col("known"), F.col(SCORE).cast("double")).alias("actual"))


@query("m21_ridge_path")
def ridge_path(spark, sf_dir):
    return path_table(features(spark, sf_dir), forecast_model(spark, sf_dir, 0.0))


@query("m21_ridge_rmse")
def ridge_rmse(spark, sf_dir):
    return holdout_rmse(features(spark, sf_dir), forecast_model(spark, sf_dir, 0.0))


_CHECK_PATHS: dict = {}
KINDS = {"lasso": 1.0, "ridge": 0.0}


def check_path(spark, sf_dir, kind):
    """The cross-validated penalised model, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _CHECK_PATHS:
        _CHECK_PATHS[key] = penalised_check(checks(spark, sf_dir), KINDS[kind])
    return _CHECK_PATHS[key]


def _penalty_table(spark, found):
    terms = [int((b[1:] != 0).sum()) for b in found.betas]
    rows = list(zip(found.penalties, map(float, found.log_loss), terms, found.settled))
    return spark.createDataFrame(rows, "penalty double, log_loss double, terms int, settled boolean")


@query("m22_lasso_logistic")
def lasso_logistic(spark, sf_dir):
    return _penalty_table(spark, check_path(spark, sf_dir, "lasso"))


@query("m22_ridge_path")
def ridge_logistic_path(spark, sf_dir):
    return _penalty_table(spark, check_path(spark, sf_dir, "ridge"))


@query("m22_ridge_logistic")
def ridge_logistic(spark, sf_dir):
    return penalised_probabilities(checks(spark, sf_dir).where("Study = 'E'"), check_path(spark, sf_dir, "ridge"))


@query("m22_lasso_probabilities")
def lasso_probabilities(spark, sf_dir):
    return penalised_probabilities(checks(spark, sf_dir).where("Study = 'E'"), check_path(spark, sf_dir, "lasso"))


def _by_kind(spark, sf_dir, table):
    parts = [table(penalised_classes(checks(spark, sf_dir), check_path(spark, sf_dir, k))).select(F.lit(k).alias("penalty"), "*") for k in KINDS]
    return parts[0].unionByName(parts[1])


@query("m22_class_tables")
def class_tables(spark, sf_dir):
    """Predicted and actual classes of the test rows, for both penalties."""
    return _by_kind(spark, sf_dir, lambda rows: rows.groupBy("class", "LeadStatus").agg(F.count(F.lit(1)).alias("n")))


@query("m22_accuracies")
def penalised_accuracies(spark, sf_dir):
    return _by_kind(spark, sf_dir, lambda rows: accuracy(rows, "class", "LeadStatus"))


@query("m22_test_rows")
def class_totals(spark, sf_dir):
    """The class tables hold every test row once."""
    return class_tables(spark, sf_dir).groupBy("penalty", "LeadStatus").agg(F.sum("n").alias("n"))
