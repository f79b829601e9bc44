"""Sources, projections, filters and combining."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from waveline.catalog.registry import panel, query, visits
from waveline.catalog.sql import ITEMS, PANEL, TREATMENT, VISITS, WEEKLY, with_
from waveline.functions.bands import DIFFERENCE_LEVEL_ORDER, LEVEL_ORDER, level_position
from waveline.functions.columns import across, col_range, drop_range, numeric_columns, prefix_range
from waveline.functions.scores import two_way
from waveline.operators.align import visits_at_least_distance
from waveline.operators.combine import first_per_key, merge_all
from waveline.operators.ordered import OrderedBlocks, nulls_last
from waveline.plans.prepare import combine_studies, one_visit_per_day
from waveline.plans.treatment import treatment_data, weekly
from waveline.sources.panel_csv import TIES, VISIT_ORDER, read_panel, write_panel
from waveline.sources.store import scratch_path
from waveline.sources.testdata import raw_panel


@query("panel_build", with_(PANEL, "select * from panel"))
def panel_build(spark, sf_dir):
    return raw_panel(spark, sf_dir)


@query("s1_csv_scan", with_(PANEL, "select * from panel"))
def csv_scan(spark, sf_dir):
    path = scratch_path(spark)
    write_panel(panel(spark, sf_dir), path)
    return read_panel(spark, path)


@query("s1_study_files", with_(PANEL, "select * from panel"))
def study_files(spark, sf_dir):
    """Five files as they come: columns in any order, one without LeadStatus, none with Week."""
    parts = []
    for i, study in enumerate("ABCDE"):
        path = scratch_path(spark)
        own = panel(spark, sf_dir).where(F.col("Study") == study).drop("Week", *["LeadStatus"] * (study == "E"))
        write_panel(own.select(*own.columns[i:], *own.columns[:i]), path)
        parts.append(read_panel(spark, path).drop("Week"))
    return combine_studies(parts)


@query(
    "s2_csv_row_names",
    with_(PANEL, """
        select row_number() over (order by PatientID, VisitDay, Study, Country, SiteID, RaterID, AssessmentID) as X, *
        from panel"""),
)
def csv_row_names(spark, sf_dir):
    path = scratch_path(spark)
    source = panel(spark, sf_dir)
    write_panel(source, path, row_names=VISIT_ORDER)
    return read_panel(spark, path, T.StructType([T.StructField("X", T.LongType()), *source.schema]))


@query("s3_csv_sink", with_(VISITS, "select PatientID, PANSS_Total from visits"))
def csv_sink(spark, sf_dir):
    path = scratch_path(spark)
    out = visits(spark, sf_dir).select("PatientID", "PANSS_Total")
    write_panel(out, path)
    return read_panel(spark, path, out.schema)


@query("r1_drop_columns", with_(PANEL, "select * exclude (LeadStatus, SiteID, RaterID) from panel"))
def drop_columns(spark, sf_dir):
    return panel(spark, sf_dir).drop("LeadStatus", "SiteID", "RaterID")


@query("r2_drop_range", with_(PANEL, f"select * exclude ({', '.join(ITEMS)}) from panel"))
def drop_items(spark, sf_dir):
    return drop_range(panel(spark, sf_dir), "P1", "G16")


@query("r3_keep_range", with_(PANEL, f"select PatientID, {', '.join(ITEMS)} from panel"))
def keep_items(spark, sf_dir):
    df = panel(spark, sf_dir)
    return df.select("PatientID", *col_range(df, "P1", "G16"))


@query("r4_select_numeric", with_(PANEL, "select * exclude (Study, Country, TxGroup, LeadStatus) from panel"))
def select_numeric(spark, sf_dir):
    df = panel(spark, sf_dir)
    return df.select(*numeric_columns(df))


@query(
    "r5_rename",
    with_(WEEKLY, "select PatientID, PANSS_Total as BaselinePANSS from weekly where VisitDay = 0"),
)
def rename(spark, sf_dir):
    base = weekly(visits(spark, sf_dir)).where("VisitDay = 0").select("PatientID", "PANSS_Total")
    return base.withColumnRenamed("PANSS_Total", "BaselinePANSS")


@query(
    "r6_prefix_range",
    with_(VISITS, f"""select PatientID, {', '.join(f'{c} as Baseline{c}' for c in ITEMS)}
                      from visits where VisitDay = 0"""),
)
def prefix_items(spark, sf_dir):
    base = visits(spark, sf_dir).where("VisitDay = 0").select("PatientID", *ITEMS)
    return prefix_range(base, "P1", "G16", "Baseline")


@query("r7_filter_equal", with_(VISITS, "select * from visits where Study = 'E' and Week = 18"))
def filter_equal(spark, sf_dir):
    return visits(spark, sf_dir).where((F.col("Study") == "E") & (F.col("Week") == 18))


@query("r8_filter_not_equal", with_(PANEL, "select * from panel where Study <> 'E'"))
def filter_not_equal(spark, sf_dir):
    return panel(spark, sf_dir).where(F.col("Study") != "E")


@query(
    "r9_filter_weeks",
    with_(WEEKLY, """select PatientID, Week, TreatmentWeek, PANSS_Total from weekly
                     where TreatmentWeek <= 2 or TreatmentWeek = 4 or TreatmentWeek = 6"""),
)
def filter_weeks(spark, sf_dir):
    rows = weekly(visits(spark, sf_dir)).select("PatientID", "Week", "TreatmentWeek", "PANSS_Total")
    return rows.where((F.col("TreatmentWeek") <= 2) | F.col("TreatmentWeek").isin(4, 6))


@query(
    "r10_filter_least_distance",
    with_(VISITS, """
        select * from visits where Study = 'E'
        qualify abs(VisitDay - 126) = min(abs(VisitDay - 126)) over (partition by PatientID)"""),
)
def filter_least_distance(spark, sf_dir):
    e = visits(spark, sf_dir).where("Study = 'E'")
    return visits_at_least_distance(e, "PatientID", "VisitDay", 126)


@query(
    "r11_across",
    with_(PANEL, f"""select AssessmentID, {', '.join(f'{c} - 4 as Centred{c}' for c in ITEMS)} from panel"""),
)
def centre_items(spark, sf_dir):
    df = panel(spark, sf_dir).select("AssessmentID", *ITEMS)
    return across(df, ITEMS, lambda c: c - 4, "Centred{col}").drop(*ITEMS)


@query("r12_constant", with_(VISITS, "select PatientID, AssessmentID, 126 as VisitDay from visits"))
def constant(spark, sf_dir):
    return visits(spark, sf_dir).select("PatientID", "AssessmentID", "VisitDay").withColumn("VisitDay", F.lit(126))


@query("r13_drop_incomplete", with_(PANEL, "select * from panel where LeadStatus is not null"))
def drop_incomplete(spark, sf_dir):
    return panel(spark, sf_dir).dropna()


@query(
    "r14_fill_zero",
    with_(PANEL, """
        select AssessmentID,
               coalesce(cast(case when LeadStatus = 'Passed' then P1 end as int), 0) as PassedP1,
               coalesce(cast(case when LeadStatus = 'Passed' then N1 end as int), 0) as PassedN1
        from panel"""),
)
def fill_zero(spark, sf_dir):
    passed = F.col("LeadStatus") == "Passed"
    df = panel(spark, sf_dir).select(
        "AssessmentID", F.when(passed, F.col("P1")).alias("PassedP1"), F.when(passed, F.col("N1")).alias("PassedN1")
    )
    return df.fillna(0, ["PassedP1", "PassedN1"])


@query(
    "r15_two_way",
    with_(PANEL, """select AssessmentID, case when LeadStatus = 'Passed' then 'P'
                    when LeadStatus is not null then 'NP' end as LeadStatus from panel"""),
)
def recode(spark, sf_dir):
    return panel(spark, sf_dir).select(
        "AssessmentID", two_way("LeadStatus", "Passed", "P", "NP").alias("LeadStatus")
    )


@query(
    "r16_first_known",
    with_(PANEL, "select AssessmentID, coalesce(LeadStatus, Study) as Status from panel"),
)
def first_known(spark, sf_dir):
    return panel(spark, sf_dir).select("AssessmentID", F.coalesce("LeadStatus", "Study").alias("Status"))


@query(
    "r17_factor_levels",
    with_(VISITS, """select PatientID, row_number() over (order by PatientID) as level
                     from (select distinct PatientID from visits)"""),
)
def factor_levels(spark, sf_dir):
    ids = visits(spark, sf_dir).select("PatientID").distinct()
    return OrderedBlocks.of(ids, ["PatientID"]).ordinal("level", start=1).frame()


@query(
    "r17_factor_codes",
    with_(TREATMENT, """
        select PatientID, TreatmentWeek, CGI, cast(list_position(['Marked', 'Mild', 'Moderate', 'Severe'], CGI) as int) as code
        from data"""),
)
def factor_codes(spark, sf_dir):
    # The levels are the known band labels, in alphabetical order.
    data = treatment_data(visits(spark, sf_dir))
    levels = ["Marked", "Mild", "Moderate", "Severe"]
    return data.select("PatientID", "TreatmentWeek", "CGI", level_position(F.col("CGI"), levels).alias("code"))


def _positions(order, name):
    return f"cast(list_position({order!r}, ImprovementLevel) as int) as {name}"


@query(
    "r18_level_order",
    with_(TREATMENT, f"""
        select PatientID, TreatmentWeek, ImprovementLevel, {_positions(LEVEL_ORDER, 'stack_position')},
               {_positions(DIFFERENCE_LEVEL_ORDER, 'dodge_position')} from data"""),
)
def level_order(spark, sf_dir):
    level = F.col("ImprovementLevel")
    return treatment_data(visits(spark, sf_dir)).select(
        "PatientID",
        "TreatmentWeek",
        "ImprovementLevel",
        level_position(level, LEVEL_ORDER).alias("stack_position"),
        level_position(level, DIFFERENCE_LEVEL_ORDER).alias("dodge_position"),
    )


def _study_files(spark, sf_dir):
    df = panel(spark, sf_dir).drop("Week")
    files = [df.where(F.col("Study") == s) for s in "ABCD"]
    return [*files, df.where("Study = 'E'").drop("LeadStatus")]


@query("j1_stack", with_(PANEL, "select * from panel"))
def stack_studies(spark, sf_dir):
    return combine_studies(_study_files(spark, sf_dir))


@query("t7_union", with_(PANEL, "select * from panel"))
def union(spark, sf_dir):
    return combine_studies(_study_files(spark, sf_dir))


_SITE_COLUMNS = ["Study", "Country", "TxGroup", "Week"]


@query(
    "j1_merge",
    with_(PANEL + """,
a as (select Study, Country, TxGroup, Week, P1 from panel where Study <> 'E'),
b as (select Study, Country, TxGroup, Week, N1 from panel where Study <> 'A')""", """
select coalesce(a.Study, b.Study) as Study, coalesce(a.Country, b.Country) as Country,
       coalesce(a.TxGroup, b.TxGroup) as TxGroup, coalesce(a.Week, b.Week) as Week, P1, N1
from a full join b on a.Study is not distinct from b.Study and a.Country is not distinct from b.Country
  and a.TxGroup is not distinct from b.TxGroup and a.Week is not distinct from b.Week"""),
)
def merge_overlapping(spark, sf_dir):
    df = panel(spark, sf_dir)
    a = df.where("Study <> 'E'").select(*_SITE_COLUMNS, "P1")
    b = df.where("Study <> 'A'").select(*_SITE_COLUMNS, "N1")
    return merge_all(a, b)


@query("a4_first_per_day", with_(VISITS, "select * from visits"))
def first_per_day(spark, sf_dir):
    return one_visit_per_day(panel(spark, sf_dir))


@query(
    "a5_first_per_patient",
    with_(VISITS, "select * from visits qualify row_number() over (partition by PatientID order by VisitDay) = 1"),
)
def first_per_patient(spark, sf_dir):
    return first_per_key(visits(spark, sf_dir), ["PatientID"], ["VisitDay", *TIES])


_SORT_SQL = "order by PatientID nulls last, VisitDay nulls last, AssessmentID"


@query("t1_sort", with_(PANEL, f"select PatientID, VisitDay, AssessmentID, PANSS_Total from panel {_SORT_SQL}"))
def sort_visits(spark, sf_dir):
    df = panel(spark, sf_dir).select("PatientID", "VisitDay", "AssessmentID", "PANSS_Total")
    return df.orderBy(*nulls_last(["PatientID", "VisitDay", "AssessmentID"]))


@query("t2_sort_one_key", with_(PANEL, "select VisitDay, AssessmentID from panel order by VisitDay nulls last, AssessmentID"))
def sort_one_key(spark, sf_dir):
    return panel(spark, sf_dir).select("VisitDay", "AssessmentID").orderBy(*nulls_last(["VisitDay", "AssessmentID"]))


@query(
    "t3_sort_levels",
    with_(TREATMENT, """select Study, TreatmentWeek, ImprovementLevel, TxGroup, count(*) as n from data group by all
                        order by Study, TreatmentWeek, ImprovementLevel, TxGroup"""),
)
def sort_levels(spark, sf_dir):
    keys = ["Study", "TreatmentWeek", "ImprovementLevel", "TxGroup"]
    data = treatment_data(visits(spark, sf_dir))
    return data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*nulls_last(keys))


@query(
    "t5_top_one",
    with_(VISITS, """select * from visits
        qualify row_number() over (partition by PatientID order by PANSS_Total, VisitDay) = 1"""),
)
def top_one(spark, sf_dir):
    return first_per_key(visits(spark, sf_dir), ["PatientID"], ["PANSS_Total", "VisitDay"])
