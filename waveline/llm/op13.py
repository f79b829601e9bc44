"""Query of phrase collocations and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveline.llm.catalog import query
from waveline.llm.collocations import collocations
from waveline.llm.common import table

LEAST, TOP, COVERED = 10, 2000, 50

SQL = rf"""
with p as materialized (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as p
  from (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents where text is not null)),
w as materialized (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as materialized (
  select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase, count(*) as f
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, range(1, 4) r(m))
  group by all),
n as (select lang, sum(f)::bigint as n from g where m = 1 group by lang),
c as materialized (select lang, m, phrase, string_split(phrase, ' ') as w, f as a from g where m > 1 and f >= {LEAST}),
cuts as (
  select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, m)) as k from c) c
  join g x on x.lang = c.lang and x.phrase = array_to_string(c.w[1 : k], ' ')
  join g y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1 :], ' ')),
best as (select lang, phrase, a, arg_min({{'l': l, 'r': r, 'score': score}}, (score, k)) as x from cuts group by lang, phrase, a),
inside as (
  select lang, array_to_string(w[i : i + n - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, m - n + 2)) as i from (select *, unnest(range(2, m)) as n from c)) group by all),
kept as (
  select best.* from best left join inside using (lang, phrase) where longer is null or 100 * longer < {COVERED} * a)
select lang, rank, phrase, a, x.l as l, x.r as r, n, x.score::bigint as score
from (select *, row_number() over (partition by lang order by x.score desc, a desc, phrase) as rank from kept) join n using (lang)
where rank <= {TOP}
"""


@query("op13_collocations", SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), LEAST, TOP, COVERED)
