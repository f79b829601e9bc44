"""Query of benchmark decontamination and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveline.llm.catalog import query
from waveline.llm.common import table
from waveline.llm.decontaminate import MASKS, ONE_GAP, OVERLAP, SHARE, SHORT, leaks


def _seed_rows(side: str) -> str:
    return " union all ".join(
        f"select id, p, {m} as m, "
        + " || ' ' || ".join(f"w[p + {i}]" for i, c in enumerate(mask) if c == "1")
        + f" as seed from {side} where p + {len(mask) - 1} <= len(w)"
        for m, mask in enumerate(MASKS)
    )


SQL = rf"""
with d as (
  select doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w
  from documents),
b as (
  select item_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w
  from benchmark),
dp as (select id, w, unnest(range(1, len(w) + 1)) as p from d),
bp as (select id, w, unnest(range(1, len(w) + 1)) as p from b),
h as (
  select distinct x.id as doc_id, y.id as item_id, x.p - y.p as shift
  from ({_seed_rows("dp")}) x join ({_seed_rows("bp")}) y using (m, seed)
  union
  select dp.id, b.id, dp.p - 1
  from dp join b on len(b.w) between 1 and {SHORT - 1} and dp.p + len(b.w) - 1 <= len(dp.w)
  where len(list_filter(range(1, len(b.w) + 1), lambda i: dp.w[dp.p + i - 1] <> b.w[i])) <= (len(b.w) >= {ONE_GAP})::int),
a as (
  select h.doc_id, h.item_id, h.shift, bp.p, len(bp.w) as item_words,
         case when d.w[bp.p + shift] = bp.w[bp.p] then 1 else -1 end as v
  from h join bp on bp.id = h.item_id join d on d.id = h.doc_id
  where bp.p + shift between 1 and len(d.w)),
s as (
  select *, sum(v) over (partition by doc_id, item_id, shift order by p) as total from a),
k as (
  select *, least(0, min(total) over (partition by doc_id, item_id, shift order by p rows between unbounded preceding and 1 preceding)) as low
  from s)
select doc_id, item_id, max(total - coalesce(low, 0))::bigint as overlap, any_value(item_words)::bigint as item_words
from k group by doc_id, item_id
having 100 * max(total - coalesce(low, 0)) >= {2 * SHARE - 100} * least(any_value(item_words), {OVERLAP})
"""


@query("op7_decontamination", SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
