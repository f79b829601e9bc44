"""Windows and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveline.catalog.registry import panel, query, shared_table, visits
from waveline.catalog.sql import ENTITY, ITEMS, LEVELS, ORDER, PANEL, VISITS, WEEKLY, with_
from waveline.functions.columns import uniform
from waveline.functions.scores import composite
from waveline.operators.align import actual_or_predicted, baseline, natural_left_join, nearest_visit
from waveline.operators.collapse import (
    collapse_periods,
    lowest_row,
    period_mean,
    with_group_value,
    with_period_ordinal,
)
from waveline.operators.ordered import OrderedBlocks, lag_lead
from waveline.operators.shares import complete_grid, group_counts, step_difference, with_share
from waveline.operators.split import split_rows
from waveline.plans.forecast import baseline_items, forecast_features
from waveline.plans.treatment import CELL, GRID, improvement_shares, treatment_data, weekly
from waveline.plans.visit_check import check_features
from waveline.sources.panel_csv import N_ITEMS, P_ITEMS, SCORE, VISIT_ORDER

SCORES = [*ITEMS, SCORE]


def features(spark, sf_dir):
    """Visits with lags, leads and baselines, as several models read them."""
    return shared_table(
        spark, sf_dir, "forecast", lambda: forecast_features(visits(spark, sf_dir)), "Study"
    )


def checks(spark, sf_dir):
    """Assessments with flags and label, as several models read them."""
    return shared_table(spark, sf_dir, "checks", lambda: check_features(panel(spark, sf_dir)), "Study")


@query(
    "w1_week_mean",
    with_(PANEL, """select AssessmentID, PatientID, Week,
        cast(ceil(avg(PANSS_Total) over (partition by PatientID, Week)) as int) as WeekMean from panel"""),
)
def week_mean(spark, sf_dir):
    rows = panel(spark, sf_dir).select("AssessmentID", "PatientID", "Week", SCORE)
    return period_mean(rows, "PatientID", "Week", SCORE, "WeekMean").drop(SCORE)


_PART = "case when LeadStatus = 'Flagged' then null else PANSS_Total end"


@query(
    "w1_week_mean_nulls",
    with_(PANEL, f"""select AssessmentID, PatientID, Week,
        cast(case when count({_PART}) over w = count(*) over w then ceil(avg({_PART}) over w) end as int) as WeekMean
        from panel window w as (partition by PatientID, Week)"""),
)
def week_mean_nulls(spark, sf_dir):
    rows = panel(spark, sf_dir).select("AssessmentID", "PatientID", "Week", F.expr(_PART).alias(SCORE))
    return period_mean(rows, "PatientID", "Week", SCORE, "WeekMean").drop(SCORE)


@query(
    "w2_lowest_row",
    with_(VISITS, """select * from visits
        qualify row_number() over (partition by PatientID, Week order by PANSS_Total, VisitDay) = 1"""),
)
def lowest(spark, sf_dir):
    return lowest_row(visits(spark, sf_dir), ["PatientID", "Week"], SCORE, ["VisitDay"])


@query("w2_collapse", with_(WEEKLY, "select * exclude (TreatmentWeek) from weekly"))
def collapse(spark, sf_dir):
    return collapse_periods(visits(spark, sf_dir), "PatientID", "Week", SCORE, ["VisitDay"])


@query(
    "w2_collapse_nulls",
    with_(VISITS, f"""select PatientID, Week, VisitDay, AssessmentID, cast(ceil(m) as int) as PANSS_Total from (
        select *, avg({_PART}) over w as m, count({_PART}) over w as known, count(*) over w as n,
               row_number() over (partition by PatientID, Week order by VisitDay) as r
        from visits window w as (partition by PatientID, Week))
        where r = 1 and known = n"""),
)
def collapse_nulls(spark, sf_dir):
    rows = visits(spark, sf_dir).select("PatientID", "Week", "VisitDay", "AssessmentID", F.expr(_PART).alias(SCORE))
    return collapse_periods(rows, "PatientID", "Week", SCORE, ["VisitDay"])


@query("w3_week_ordinal", with_(WEEKLY, "select PatientID, Week, TreatmentWeek from weekly"))
def week_ordinal(spark, sf_dir):
    rows = collapse_periods(
        visits(spark, sf_dir).select("PatientID", "Week", "VisitDay", SCORE), "PatientID", "Week", SCORE, ["VisitDay"]
    )
    return with_period_ordinal(rows, "PatientID", "Week").select("PatientID", "Week", "TreatmentWeek")


@query(
    "w4_visit_ordinal",
    with_(PANEL, f"""select AssessmentID, PatientID, VisitDay,
        row_number() over ({ENTITY}) - 1 as TreatmentWeek from panel"""),
)
def visit_ordinal(spark, sf_dir):
    blocks = OrderedBlocks.of(panel(spark, sf_dir).select(*VISIT_ORDER), VISIT_ORDER)
    numbered = blocks.ordinal("TreatmentWeek", "PatientID").frame()
    return numbered.select("AssessmentID", "PatientID", "VisitDay", "TreatmentWeek")


@query(
    "w5_share",
    with_(LEVELS, "select Study, TxGroup, TreatmentWeek, ImprovementLevel, n, round(pct, 9) as pct from shares"),
)
def share(spark, sf_dir):
    counts = group_counts(treatment_data(visits(spark, sf_dir)), GRID)
    shares = with_share(complete_grid(counts, GRID), CELL)
    return shares.withColumn("pct", F.round("pct", 9))


@query(
    "w6_difference",
    with_(LEVELS, """select Study, TreatmentWeek, ImprovementLevel, round(diff, 9) as diff from (
        select *, pct - lag(pct) over (partition by Study, TreatmentWeek, ImprovementLevel order by TxGroup) as diff
        from shares) where diff is not null"""),
)
def difference(spark, sf_dir):
    shares = improvement_shares(treatment_data(visits(spark, sf_dir)))
    diff = step_difference(shares, ["Study", "TreatmentWeek", "ImprovementLevel"], "TxGroup", "pct")
    return diff.withColumn("diff", F.round("diff", 9))


def _lag_sql(fn, name, over, source="panel"):
    cols = ", ".join(f"{fn}({c}) over ({over}) as {name}{c}" for c in SCORES)
    return with_(PANEL, f"select AssessmentID, {cols} from {source}")


def _shifted(spark, sf_dir, scope, side):
    rows = panel(spark, sf_dir).select(*VISIT_ORDER, *SCORES)
    blocks = lag_lead(OrderedBlocks.of(rows, VISIT_ORDER), SCORES, "PatientID", scope)
    return blocks.frame().select("AssessmentID", *[f"{side}{c}" for c in SCORES])


@query("w7_lag_table", _lag_sql("lag", "Lag", ORDER))
def lag_table(spark, sf_dir):
    return _shifted(spark, sf_dir, "table", "Lag")


@query("w7_lag_entity", _lag_sql("lag", "Lag", ENTITY))
def lag_entity(spark, sf_dir):
    return _shifted(spark, sf_dir, "entity", "Lag")


@query("w8_lead_table", _lag_sql("lead", "Lead", ORDER))
def lead_table(spark, sf_dir):
    return _shifted(spark, sf_dir, "table", "Lead")


@query("w8_lead_entity", _lag_sql("lead", "Lead", ENTITY))
def lead_entity(spark, sf_dir):
    return _shifted(spark, sf_dir, "entity", "Lead")


def _change_sql(over):
    cols = ", ".join(f"coalesce({c} - lag({c}) over ({over}), 0) as Change{c}" for c in ITEMS)
    return with_(PANEL, f"select AssessmentID, {cols} from panel")


@query("w9_change_table", _change_sql(ORDER))
def change_table(spark, sf_dir):
    return checks(spark, sf_dir).select("AssessmentID", *[f"Change{c}" for c in ITEMS])


@query("w9_change_entity", _change_sql(ENTITY))
def change_entity(spark, sf_dir):
    rows = check_features(panel(spark, sf_dir), scope="entity", spread="row")
    return rows.select("AssessmentID", *[f"Change{c}" for c in ITEMS])


_GAPS = {"Known1": "case when AssessmentID % 3 = 0 then P1 end", "Known2": "case when P2 = 1 then G16 end"}


def _fill_sql(fn, over, frame):
    cols = ", ".join(f"{fn}({e} ignore nulls) over ({over} {frame}) as {c}" for c, e in _GAPS.items())
    return with_(PANEL, f"select AssessmentID, {cols} from panel")


def _filled(spark, sf_dir, direction, entity=None):
    rows = panel(spark, sf_dir).select(*VISIT_ORDER, *[F.expr(e).alias(c) for c, e in _GAPS.items()])
    blocks = OrderedBlocks.of(rows, VISIT_ORDER).fill({c: direction for c in _GAPS}, entity)
    return blocks.frame().select("AssessmentID", *_GAPS)


_ON = "rows between current row and unbounded following"
_BACK = "rows between unbounded preceding and current row"


@query("w10_fill_up_table", _fill_sql("first_value", ORDER, _ON))
def fill_up_table(spark, sf_dir):
    return _filled(spark, sf_dir, "up")


@query("w10_fill_up_entity", _fill_sql("first_value", ENTITY, _ON))
def fill_up_entity(spark, sf_dir):
    return _filled(spark, sf_dir, "up", "PatientID")


@query("w11_fill_down_table", _fill_sql("last_value", ORDER, _BACK))
def fill_down_table(spark, sf_dir):
    return _filled(spark, sf_dir, "down")


@query("w11_fill_down_entity", _fill_sql("last_value", ENTITY, _BACK))
def fill_down_entity(spark, sf_dir):
    return _filled(spark, sf_dir, "down", "PatientID")


_BALANCE = f"({' + '.join(N_ITEMS)}) - ({' + '.join(P_ITEMS)})"


@query(
    "w12_composite_neighbours",
    with_(PANEL, f"""select AssessmentID, {_BALANCE} as CompositeScore,
        coalesce(lag({_BALANCE}) over ({ORDER}), 0) as LagCompositeScore,
        coalesce(lead({_BALANCE}) over ({ORDER}), 0) as LeadCompositeScore from panel"""),
)
def composite_neighbours(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("CompositeScore", composite(N_ITEMS, P_ITEMS))
    rows = rows.select(*VISIT_ORDER, "CompositeScore")
    blocks = lag_lead(OrderedBlocks.of(rows, VISIT_ORDER), ["CompositeScore"], "PatientID", missing=0)
    return blocks.frame().select("AssessmentID", "CompositeScore", "LagCompositeScore", "LeadCompositeScore")


@query(
    "w13_least_distance",
    with_(VISITS, """select AssessmentID, PatientID,
        min(abs(VisitDay - 126)) over (partition by PatientID) as least from visits"""),
)
def least_distance(spark, sf_dir):
    rows = visits(spark, sf_dir).select("AssessmentID", "PatientID", "VisitDay")
    least = F.min(F.abs(F.col("VisitDay") - 126))
    return with_group_value(rows, ["PatientID"], least=least).select("AssessmentID", "PatientID", "least")


_FILLED = VISITS + f""",
based as (
  select v.*, {', '.join(f'b.{c} as Baseline{c}' for c in ITEMS)}, b.PANSS_Total as BaselinePANSS_Total
  from visits v left join (select * from visits where VisitDay = 0) b on v.PatientID = b.PatientID),
shifted as (
  select *, {', '.join(f'lag({c}) over o as lag_{c}, lead({c}) over o as lead_{c}' for c in SCORES)},
         row_number() over (partition by PatientID order by VisitDay) - 1 as TreatmentWeek
  from based window o as (order by PatientID, VisitDay)),
forecast as (
  select * exclude ({', '.join(f'lag_{c}, lead_{c}, Baseline{c}' for c in SCORES)}, SiteID, RaterID),
         {', '.join(f'''first_value(lag_{c} ignore nulls) over ahead as Lag{c},
         last_value(lead_{c} ignore nulls) over back as Lead{c},
         last_value(Baseline{c} ignore nulls) over back as Baseline{c}''' for c in SCORES)}
  from shifted
  window ahead as (order by PatientID, VisitDay rows between current row and unbounded following),
         back as (order by PatientID, VisitDay rows between unbounded preceding and current row))"""


@query("w11_forecast_features", with_(_FILLED, "select * from forecast"))
def all_features(spark, sf_dir):
    return features(spark, sf_dir)


@query(
    "j2_baseline_join",
    with_(WEEKLY, """select w.PatientID, w.Week, w.PANSS_Total, b.PANSS_Total as BaselinePANSS
        from weekly w left join (select * from weekly where VisitDay = 0) b on w.PatientID = b.PatientID"""),
)
def baseline_join(spark, sf_dir):
    rows = weekly(visits(spark, sf_dir))
    base = baseline(rows, "PatientID", "VisitDay", {SCORE: "BaselinePANSS"})
    return natural_left_join(rows, base).select("PatientID", "Week", SCORE, "BaselinePANSS")


@query(
    "j3_natural_join",
    with_(VISITS, f"""select v.*, {', '.join(f'b.{c} as Baseline{c}' for c in ITEMS)}, b.PANSS_Total as BaselinePANSS_Total
        from visits v left join (select * from visits where VisitDay = 0) b on v.PatientID = b.PatientID"""),
)
def natural_join(spark, sf_dir):
    rows = visits(spark, sf_dir)
    return natural_left_join(rows, baseline_items(visits(spark, sf_dir)))


_NEAREST = """select * from visits where Study = 'E'
    qualify row_number() over (partition by PatientID order by abs(VisitDay - 126), VisitDay) = 1"""


@query(
    "j4_actual_or_predicted",
    with_(VISITS + f""",
week18 as (select PatientID, PANSS_Total from visits where Study = 'E' and Week = 18),
nearest as ({_NEAREST})""", """
select coalesce(a.PatientID, p.PatientID) as PatientID, coalesce(a.PANSS_Total, p.PANSS_Total) as PANSS_Total
from week18 a full join nearest p on a.PatientID = p.PatientID"""),
)
def merge_actual(spark, sf_dir):
    e = visits(spark, sf_dir).where("Study = 'E'")
    near = nearest_visit(e, "PatientID", "VisitDay", 126, ["VisitDay"])
    return actual_or_predicted(e.where("Week = 18"), near, "PatientID", SCORE)


@query("j5_nearest_visit", with_(VISITS, _NEAREST))
def nearest(spark, sf_dir):
    e = visits(spark, sf_dir).where("Study = 'E'")
    return nearest_visit(e, "PatientID", "VisitDay", 126, ["VisitDay"])


@query("j6_complete_grid", with_(LEVELS, "select Study, TxGroup, TreatmentWeek, ImprovementLevel, n from filled"))
def grid(spark, sf_dir):
    return complete_grid(group_counts(treatment_data(visits(spark, sf_dir)), GRID), GRID)


_DRAW = "cast('0x' || substr(md5('2:' || cast(AssessmentID as varchar)), 1, 8) as bigint) / 4294967296.0"


@query(
    "j9_split_complement",
    with_(PANEL, f"""select AssessmentID, Study, case when {_DRAW} < 0.5 then 'test' else 'train' end as part
        from panel where Study <> 'E'"""),
)
def split_complement(spark, sf_dir):
    rows = panel(spark, sf_dir).where("Study <> 'E'").select("AssessmentID", "Study")
    test, train = split_rows(rows, "AssessmentID", 0.5)
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query(
    "m12_split_70",
    with_(VISITS, f"select AssessmentID, PatientID from visits where Study = 'E' and {_DRAW} < 0.7"),
)
def split_70(spark, sf_dir):
    rows = visits(spark, sf_dir).where("Study = 'E'").select("AssessmentID", "PatientID")
    return split_rows(rows, "AssessmentID", 0.7)[0]


@query("f20_uniform", with_(PANEL, f"select AssessmentID, round({_DRAW}, 9) as draw from panel"))
def uniform_draw(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", F.round(uniform(F.col("AssessmentID")), 9).alias("draw"))


@query(
    "t4_sort_predictions",
    with_(PANEL, f"""select PatientID, AssessmentID, round({_DRAW}, 9) as predicted from panel
        where Study = 'E' order by PatientID, AssessmentID"""),
)
def sort_predictions(spark, sf_dir):
    rows = panel(spark, sf_dir).where("Study = 'E'")
    scored = rows.select("PatientID", "AssessmentID", F.round(uniform(F.col("AssessmentID")), 9).alias("predicted"))
    return scored.orderBy("PatientID", "AssessmentID")
