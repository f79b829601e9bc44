"""Aggregations, scalar rules and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveline.catalog.registry import panel, query, visits
from waveline.catalog.scans import checks
from waveline.catalog.sql import CHANGE, ITEMS, LEVELS, N_ITEMS, ORDER, P_ITEMS, PANEL, PROFILES, TREATMENT, VISITS, WEEKLY, with_
from waveline.functions.bands import grade, improvement, severity
from waveline.functions.scores import (
    closeness,
    composite,
    relative_change,
    row_spread,
    row_sum,
    threshold_class,
)
from waveline.operators.align import baseline, natural_left_join
from waveline.operators.collapse import with_group_value
from waveline.operators.ordered import OrderedBlocks
from waveline.operators.scale import z_scores
from waveline.operators.shares import group_counts, with_share
from waveline.plans.forecast import VISIT_KEY
from waveline.plans.profiles import PROFILE, baseline_profiles
from waveline.plans.treatment import (
    CELL,
    improvement_differences,
    improvement_shares,
    mean_scores,
    mean_scores_with_lines,
    treatment_data,
    weekly,
)
from waveline.plans.visit_check import table_spread
from waveline.sources.panel_csv import SCORE, with_week


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_MEANS = "select Study, TxGroup, TreatmentWeek, round(avg(PANSS_Total), 6) as avgPANSS from data group by all"


@query("a1_mean_score", with_(TREATMENT, _MEANS))
def mean_score(spark, sf_dir):
    return rounded(mean_scores(treatment_data(visits(spark, sf_dir))), "avgPANSS")


@query("c1_mean_score_chart", with_(TREATMENT, _MEANS + " order by Study, TxGroup, TreatmentWeek"))
def mean_score_chart(spark, sf_dir):
    return rounded(mean_scores(treatment_data(visits(spark, sf_dir))), "avgPANSS").orderBy(*CELL)


@query(
    "c2_mean_score_lines",
    with_(TREATMENT, """
        select Study, TxGroup, TreatmentWeek, round(m, 6) as PANSS_Total,
               cast((m >= 58)::int + (m >= 75)::int + (m >= 95)::int + (m >= 116)::int as int) as lines_below,
               case when m >= 116 then 'Severe' when m >= 95 then 'Marked' when m >= 75 then 'Moderate'
                    when m >= 58 then 'Mild' end as line_label
        from (select Study, TxGroup, TreatmentWeek, avg(PANSS_Total) as m from data group by all)"""),
)
def mean_score_lines(spark, sf_dir):
    return rounded(mean_scores_with_lines(treatment_data(visits(spark, sf_dir))), SCORE)


@query(
    "c3_improvement_shares",
    with_(LEVELS, "select Study, TxGroup, TreatmentWeek, ImprovementLevel, n, round(pct, 6) as pct from shares"),
)
def improvement_chart(spark, sf_dir):
    return rounded(improvement_shares(treatment_data(visits(spark, sf_dir))), "pct")


@query(
    "c4_improvement_differences",
    with_(LEVELS, """select Study, TreatmentWeek, ImprovementLevel, round(diff, 6) as diff from (
        select *, pct - lag(pct) over (partition by Study, TreatmentWeek, ImprovementLevel order by TxGroup) as diff
        from shares) where diff is not null order by 1, 2, 3"""),
)
def difference_chart(spark, sf_dir):
    out = rounded(improvement_differences(treatment_data(visits(spark, sf_dir))), "diff")
    return out.orderBy("Study", "TreatmentWeek", "ImprovementLevel")


@query(
    "a3_level_counts",
    with_(TREATMENT, "select Study, TxGroup, TreatmentWeek, ImprovementLevel, count(*) as n from data group by all"),
)
def level_counts(spark, sf_dir):
    return group_counts(treatment_data(visits(spark, sf_dir)), [*CELL, "ImprovementLevel"])


@query(
    "a6_table_range",
    with_(PANEL, f"""select AssessmentID,
        (select max(greatest({', '.join(P_ITEMS)})) - min(least({', '.join(P_ITEMS)})) from panel) as SpreadP,
        (select max(greatest({', '.join(N_ITEMS)})) - min(least({', '.join(N_ITEMS)})) from panel) as SpreadN
        from panel"""),
)
def table_range(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return rows.select(
        "AssessmentID", table_spread(rows, P_ITEMS).alias("SpreadP"), table_spread(rows, N_ITEMS).alias("SpreadN")
    )


@query(
    "a14_last_week",
    with_(VISITS, """select PatientID, max(r) as maxTreatmentWeek from (
        select PatientID, row_number() over (partition by PatientID order by VisitDay) - 1 as r from visits)
        group by PatientID"""),
)
def last_week(spark, sf_dir):
    numbered = OrderedBlocks.of(visits(spark, sf_dir).select(*VISIT_KEY), VISIT_KEY).ordinal("r", "PatientID")
    return numbered.frame().groupBy("PatientID").agg(F.max("r").alias("maxTreatmentWeek"))


@query(
    "f21_next_visit_ordinal",
    with_(VISITS, """select PatientID, VisitDay, count(*) over (partition by PatientID) as NextWeek from visits"""),
)
def next_ordinal(spark, sf_dir):
    rows = OrderedBlocks.of(visits(spark, sf_dir).select(*VISIT_KEY), VISIT_KEY).ordinal("r", "PatientID").frame()
    return with_group_value(rows, ["PatientID"], NextWeek=F.max("r") + 1).drop("r")


@query(
    "a15_status_share",
    with_(PANEL, """select Study, LeadStatus, count(*) as n,
        round(count(*) / sum(count(*)) over (partition by Study), 6) as pct
        from panel where Study <> 'E' group by Study, LeadStatus"""),
)
def status_share(spark, sf_dir):
    counts = group_counts(panel(spark, sf_dir).where("Study <> 'E'"), ["Study", "LeadStatus"])
    return rounded(with_share(counts, ["Study"]), "pct")


@query(
    "a16_mean_by_ordinal",
    with_(PANEL, f"""select Study, TxGroup, TreatmentWeek, round(avg(PANSS_Total), 6) as avgPANSS from (
        select *, row_number() over (partition by PatientID {ORDER}) - 1 as TreatmentWeek from panel)
        group by Study, TxGroup, TreatmentWeek"""),
)
def mean_by_ordinal(spark, sf_dir):
    return rounded(mean_scores(checks(spark, sf_dir)), "avgPANSS")


@query(
    "f1_week",
    with_(PANEL, "select AssessmentID, VisitDay, cast(ceil((VisitDay - 40 + 1) / 7.0) as int) as ShiftedWeek from panel"),
)
def week_of_day(spark, sf_dir):
    rows = panel(spark, sf_dir).select("AssessmentID", "VisitDay", (F.col("VisitDay") - 40).alias("d"))
    return with_week(rows, "d", "ShiftedWeek").drop("d")


@query(
    "f2_f3_relative_change",
    with_(WEEKLY, f"""select w.PatientID, Week, {CHANGE} as PctChange
        from weekly w left join (select PatientID, PANSS_Total as BaselinePANSS from weekly where VisitDay = 0) b
        on w.PatientID = b.PatientID"""),
)
def pct_change(spark, sf_dir):
    rows = weekly(visits(spark, sf_dir))
    base = baseline(rows, "PatientID", "VisitDay", {SCORE: "BaselinePANSS"})
    joined = natural_left_join(rows, base)
    return joined.select("PatientID", "Week", relative_change(SCORE, "BaselinePANSS").alias("PctChange"))


@query("f4_abs", with_(PANEL, "select AssessmentID, abs(VisitDay - 126) as distance from panel"))
def distance(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", F.abs(F.col("VisitDay") - 126).alias("distance"))


@query(
    "f5_severity",
    with_(PANEL, """select AssessmentID, case when PANSS_Total < 75 then 'Mild' when PANSS_Total < 95 then 'Moderate'
        when PANSS_Total < 116 then 'Marked' else 'Severe' end as CGI from panel"""),
)
def severity_band(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", severity(F.col(SCORE)).alias("CGI"))


@query(
    "f6_grade",
    with_(PANEL, """select AssessmentID, case when PANSS_Total < 45 then 1 when PANSS_Total < 58 then 2
        when PANSS_Total < 75 then 3 when PANSS_Total < 95 then 4 when PANSS_Total < 116 then 5
        when PANSS_Total < 145 then 6 else 7 end as CGIScore from panel"""),
)
def grade_band(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", grade(F.col(SCORE)).alias("CGIScore"))


@query(
    "f7_improvement",
    with_(TREATMENT, "select PatientID, TreatmentWeek, PctChange, ImprovementLevel from data"),
)
def improvement_level(spark, sf_dir):
    data = treatment_data(visits(spark, sf_dir))
    level = improvement(F.col("TreatmentWeek"), F.col("PctChange")).alias("ImprovementLevel")
    return data.select("PatientID", "TreatmentWeek", "PctChange", level)


@query("f8_row_sum", with_(PANEL, f"select AssessmentID, {' + '.join(ITEMS)} as Total from panel"))
def item_sum(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", row_sum(ITEMS).alias("Total"))


@query(
    "f9_composite",
    with_(PANEL, f"select AssessmentID, ({' + '.join(N_ITEMS)}) - ({' + '.join(P_ITEMS)}) as CompositeScore from panel"),
)
def composite_score(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", composite(N_ITEMS, P_ITEMS).alias("CompositeScore"))


_CHANGES = ", ".join(f"coalesce({c} - lag({c}) over o, 0) as Change{c}" for c in ITEMS)
_CHECKS = PANEL + f""",
moved as (
  select *, {_CHANGES}, ({' + '.join(N_ITEMS)}) - ({' + '.join(P_ITEMS)}) as CompositeScore,
         {', '.join(f'coalesce(lag({c}) over o, 0) as Lag{c}, coalesce(lead({c}) over o, 0) as Lead{c}' for c in ITEMS)},
         row_number() over (partition by PatientID {ORDER}) - 1 as TreatmentWeek
  from panel window o as ({ORDER})),
checks as (
  select * exclude (LeadStatus, SiteID, RaterID),
         coalesce(lag(CompositeScore) over o, 0) as LagCompositeScore,
         coalesce(lead(CompositeScore) over o, 0) as LeadCompositeScore,
         {', '.join(f'case when abs(Change{c}) > 2 then 1 when Change{c} <= 2 then 0 end as FlagChange{c}' for c in ITEMS)},
         case when LeadStatus = 'Passed' then 'P' when LeadStatus is not null then 'NP' end as LeadStatus
  from moved window o as ({ORDER})),
flagged as (
  select *, (select max(greatest({', '.join(P_ITEMS)})) - min(least({', '.join(P_ITEMS)})) from panel) > 2 as FlagInconsistentP,
         (select max(greatest({', '.join(N_ITEMS)})) - min(least({', '.join(N_ITEMS)})) from panel) > 2 as FlagInconsistentN,
         CompositeScore - LagCompositeScore > 5 as FlagInconsistentComposite,
         P1 >= 3 as FlagDelusion, P3 >= 3 as FlagHallucination, P5 >= 3 as FlagGrandiosity, G5 >= 2 as FlagMannerisms,
         CompositeScore > LagCompositeScore and CompositeScore < LeadCompositeScore as FlagUnusualOutcome,
         {' + '.join(f'FlagChange{c}' for c in ITEMS)} > 3 as FlagInconsistentMeasure
  from checks)"""


def _flag_query(name, *columns):
    @query(name, with_(_CHECKS, f"select AssessmentID, {', '.join(columns)} from flagged"))
    def flag(spark, sf_dir):
        return checks(spark, sf_dir).select("AssessmentID", *columns)

    return flag


_flag_query("f10_change_flags", *[f"FlagChange{c}" for c in ITEMS])
_flag_query("f11_level_flags", "FlagDelusion", "FlagHallucination", "FlagGrandiosity", "FlagMannerisms")
_flag_query("f12_spread_flags_table", "FlagInconsistentP", "FlagInconsistentN")
_flag_query("f13_jump_flag", "FlagInconsistentComposite")
_flag_query("f14_rising_flag", "FlagUnusualOutcome")
_flag_query("f15_many_flags", "FlagInconsistentMeasure")


@query("w12_check_features", with_(_CHECKS, "select * from flagged"))
def check_table(spark, sf_dir):
    return checks(spark, sf_dir)


@query(
    "f12_spread_flags_row",
    with_(PANEL, f"""select AssessmentID,
        greatest({', '.join(P_ITEMS)}) - least({', '.join(P_ITEMS)}) > 2 as FlagInconsistentP,
        greatest({', '.join(N_ITEMS)}) - least({', '.join(N_ITEMS)}) > 2 as FlagInconsistentN from panel"""),
)
def spread_row(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "AssessmentID",
        (row_spread(P_ITEMS) > 2).alias("FlagInconsistentP"),
        (row_spread(N_ITEMS) > 2).alias("FlagInconsistentN"),
    )


@query(
    "f16_threshold_class",
    with_(PANEL, """select AssessmentID, case when PANSS_Total / 210.0 > 0.4 then 'P' else 'NP' end as class from panel"""),
)
def threshold(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "AssessmentID", threshold_class(F.col(SCORE) / F.lit(210.0), 0.4).alias("class")
    )


@query(
    "f19_closeness",
    with_(VISITS, """select AssessmentID, round(1 - abs(VisitDay - 126) / 126, 6) as weight
        from visits where Study = 'E'"""),
)
def closeness_weight(spark, sf_dir):
    rows = visits(spark, sf_dir).where("Study = 'E'")
    return rounded(rows.select("AssessmentID", closeness("VisitDay").alias("weight")), "weight")


@query("m1_z_scores", with_(PROFILES, """
    select PatientID, round((PANSS_Total - avg(PANSS_Total) over ()) / stddev_samp(PANSS_Total) over (), 6) as PANSS_Total,
           round((CompositeScore - avg(CompositeScore) over ()) / stddev_samp(CompositeScore) over (), 6) as CompositeScore,
           round((CGIScore - avg(CGIScore) over ()) / stddev_samp(CGIScore) over (), 6) as CGIScore
    from profiles"""))
def scaled_profiles(spark, sf_dir):
    rows = baseline_profiles(visits(spark, sf_dir)).select("PatientID", *PROFILE)
    return rounded(z_scores(rows, PROFILE), *PROFILE)


@query(
    "f9_baseline_profiles",
    with_(PROFILES, "select PatientID, Study, PANSS_Total, CompositeScore, CGIScore from profiles"),
)
def profiles(spark, sf_dir):
    return baseline_profiles(visits(spark, sf_dir)).select("PatientID", "Study", *PROFILE)
