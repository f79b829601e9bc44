"""SQL of the shared tables, for the twins of the queries."""

from __future__ import annotations

from waveline.sources.panel_csv import ITEMS, N_ITEMS, P_ITEMS

ITEM_LIST = ", ".join(ITEMS)


def _item(j: int) -> str:
    return (
        "cast(greatest(1, least(7, 3 + (PatientID % 5) - 2"
        f" + ((((AssessmentID % 9973) * {j * j + 31 * j + 17}) % 10007) % 5) - 2"
        " - (case when TxGroup = 'Treatment' then cast(floor(VisitDay / 60) as int) else 0 end))) as int)"
    )


PANEL = f"""
v as (
  select case c_mktsegment when 'AUTOMOBILE' then 'A' when 'BUILDING' then 'B'
              when 'FURNITURE' then 'C' when 'HOUSEHOLD' then 'D' else 'E' end as Study,
         n_name as Country, o_custkey as PatientID, c_nationkey as SiteID,
         o_orderkey % 97 as RaterID, o_orderkey as AssessmentID,
         case when o_custkey % 2 = 0 then 'Control' else 'Treatment' end as TxGroup,
         cast(floor(date_diff('day', cast(min(o_orderdate) over (partition by o_custkey) as date),
                              cast(o_orderdate as date)) / 12) as int) as VisitDay,
         o_orderstatus
  from orders join customer on o_custkey = c_custkey
              join nation on c_nationkey = n_nationkey),
i as (select v.*, {", ".join(f"{_item(j)} as {c}" for j, c in enumerate(ITEMS, 1))} from v),
panel as (
  select Study, Country, PatientID, SiteID, RaterID, AssessmentID, TxGroup, VisitDay, {ITEM_LIST},
         {" + ".join(ITEMS)} as PANSS_Total,
         case when Study = 'E' then null when o_orderstatus = 'P' then 'Flagged' else 'Passed' end as LeadStatus,
         cast(ceil((VisitDay + 1) / 7.0) as int) as Week
  from i)"""

VISITS = PANEL + """,
visits as (
  select * from panel
  qualify row_number() over (partition by PatientID, VisitDay
    order by Study, Country, SiteID, RaterID, AssessmentID) = 1)"""

WEEKLY = VISITS + """,
collapsed as (
  select * replace (cast(ceil(week_mean) as int) as PANSS_Total) from (
    select *, avg(PANSS_Total) over (partition by PatientID, Week) as week_mean,
           row_number() over (partition by PatientID, Week order by VisitDay) as week_row
    from visits)
  where week_row = 1),
weekly as (
  select * exclude (week_mean, week_row),
         cast(row_number() over (partition by PatientID order by Week) - 1 as int) as TreatmentWeek
  from collapsed)"""

def half_even(x: str, digits: int = 2) -> str:
    """The nearer decimal in double arithmetic, ties to the even digit."""
    scale = f"cast({10**digits} as double)"
    whole = f"floor(abs({x}) * {scale})"
    below, above = f"({whole} / {scale})", f"(ceil(abs({x}) * {scale}) / {scale})"
    to_below, to_above = f"(abs({x}) - {below})", f"({above} - abs({x}))"
    nearest = (
        f"(case when {to_above} < {to_below} or ({to_above} = {to_below} and {whole} % 2 = 1)"
        f" then {above} else {below} end)"
    )
    return f"(case when {x} < 0 then cast(0 as double) - {nearest} when {x} >= 0 then {nearest} end)"


CHANGE = half_even("((PANSS_Total - BaselinePANSS) / BaselinePANSS)")

TREATMENT = WEEKLY + f""",
base as (select PatientID, PANSS_Total as BaselinePANSS from weekly where VisitDay = 0),
changed as (
  select w.*, b.BaselinePANSS,
         case when PANSS_Total < 75 then 'Mild' when PANSS_Total < 95 then 'Moderate'
              when PANSS_Total < 116 then 'Marked' else 'Severe' end as CGI,
         {CHANGE} as PctChange
  from weekly w left join base b on w.PatientID = b.PatientID
  where TreatmentWeek <= 2 or TreatmentWeek = 4 or TreatmentWeek = 6),
data as (
  select *, case when PctChange > 0.1 then 'Worsen'
    when TreatmentWeek = 1 and PctChange > -0.19 then 'None'
    when TreatmentWeek = 1 and PctChange > -0.4 then 'Minimal'
    when TreatmentWeek = 1 and PctChange <= -0.4 then 'Much'
    when TreatmentWeek = 2 and PctChange > -0.23 then 'None'
    when TreatmentWeek = 2 and PctChange > -0.45 then 'Minimal'
    when TreatmentWeek = 2 and PctChange <= -0.45 then 'Much'
    when TreatmentWeek = 4 and PctChange > -0.26 then 'None'
    when TreatmentWeek = 4 and PctChange > -0.51 then 'Minimal'
    when TreatmentWeek = 4 and PctChange <= -0.51 then 'Much'
    when TreatmentWeek = 6 and PctChange > -0.28 then 'None'
    when TreatmentWeek = 6 and PctChange > -0.53 then 'Minimal'
    when TreatmentWeek = 6 and PctChange <= -0.53 then 'Much'
    else 'Baseline' end as ImprovementLevel
  from changed)"""

LEVELS = TREATMENT + """,
counted as (select Study, TxGroup, TreatmentWeek, ImprovementLevel, count(*) as n from data group by all),
grid as (
  select * from (select distinct Study from counted), (select distinct TxGroup from counted),
                (select distinct TreatmentWeek from counted), (select distinct ImprovementLevel from counted)),
filled as (
  select g.*, coalesce(c.n, 0) as n from grid g left join counted c
    using (Study, TxGroup, TreatmentWeek, ImprovementLevel)),
shares as (
  select *, case when sum(n) over (partition by Study, TxGroup, TreatmentWeek) > 0
                 then n / sum(n) over (partition by Study, TxGroup, TreatmentWeek) end as pct
  from filled)"""

PROFILES = WEEKLY + f""",
profiles as (
  select *, ({" + ".join(N_ITEMS)}) - ({" + ".join(P_ITEMS)}) as CompositeScore,
         case when PANSS_Total < 45 then 1 when PANSS_Total < 58 then 2 when PANSS_Total < 75 then 3
              when PANSS_Total < 95 then 4 when PANSS_Total < 116 then 5
              when PANSS_Total < 145 then 6 else 7 end as CGIScore
  from weekly where VisitDay = 0)"""

ORDER = "order by PatientID, VisitDay, Study, Country, SiteID, RaterID, AssessmentID"
ENTITY = f"partition by PatientID {ORDER}"


def with_(tables: str, select: str) -> str:
    tail = select.strip()
    # A tail that starts with a comma defines more tables first.
    return f"with {tables.strip()}{tail}" if tail.startswith(",") else f"with {tables.strip()}\n{tail}"
