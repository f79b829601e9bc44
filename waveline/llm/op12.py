"""Query of sharding and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.catalog import query
from waveline.llm.common import table
from waveline.llm.hash_ring import BITS, DIGITS, assign

SHARDS, REPLICAS = 16, 64


def _crc32_step(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def _place(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, {DIGITS}))::bigint"


_TABLE = [_crc32_step(b) for b in range(256)]
_BYTES = "list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::bigint)"
_CRC = f"""xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, {_BYTES}),
  lambda c, b: xor(c >> 8, ({_TABLE}::bigint[])[(xor(c, b) & 255) + 1])))"""

#: The same walk over the ring, as a recursion over the arcs with an excess.
SQL = f"""
with recursive
ring as materialized (
  select row_number() over (order by hi, shard) - 1 as arc, shard, coalesce(lag(hi) over (order by hi, shard), -1) as lo, hi
  from (select s as shard, {_place("s || '#' || r")} as hi from range(0, {SHARDS}) a(s), range(0, {REPLICAS}) b(r))),
others as materialized (
  select a.arc, list(b.shard order by b.far) as others
  from ring a, lateral (
    select shard, min((arc - a.arc + {SHARDS * REPLICAS}) % {SHARDS * REPLICAS}) as far from ring where shard <> a.shard group by shard) b
  group by a.arc),
docs as materialized (
  select row_number() over () as r, doc_id, strlen(text) + 1 as size, {_CRC} as text_crc32, {_place("coalesce(doc_id::varchar, '')")} as place
  from (select doc_id, coalesce(text, '') as text from documents)),
keys as materialized (
  select d.*, coalesce(g.arc, 0) as arc, {_place("concat_ws(':', coalesce(doc_id::varchar, ''), size, text_crc32)")} as o
  from docs d left join ring g on d.place > g.lo and d.place <= g.hi),
ranked as materialized (
  select *, row_number() over (partition by arc order by o, doc_id nulls first, size, text_crc32) - 1 as rank from keys),
total as (select count(*) as n from docs),
arcs as materialized (
  select g.arc, g.shard, coalesce(k.n, 0) as n, t.n // {SHARDS} + (g.shard < t.n % {SHARDS})::bigint as bound
  from ring g left join (select arc, count(*) as n from keys group by arc) k using (arc), total t),
own as materialized (
  select *, greatest(0, least(n, bound - slot)) as home
  from (select *, (sum(n) over (partition by shard order by arc) - n)::bigint as slot from arcs)),
excess as materialized (
  select row_number() over (order by arc) as i, arc, n, n - home as rest, others from own join others using (arc) where n > home),
bounds as materialized (select list(bound order by shard) as bound, list(bound - held order by shard) as room
  from (select shard, any_value(bound) as bound, sum(home)::bigint as held from own group by shard)),
walk(i, room, arc, n, rest, others, took) as (
  select 0::bigint, room, -1::bigint, 0::bigint, 0::bigint, []::bigint[], []::bigint[] from bounds
  union all
  select i, list_transform(room, lambda r, s: r - coalesce(took[list_position(others, s - 1)], 0)), arc, n, rest, others, took
  from (
    select e.i, e.arc, e.n, e.rest, e.others, w.room, list_transform(e.others, lambda s, j:
      greatest(0, least(w.room[s + 1], e.rest - coalesce(list_sum(list_transform(e.others[1 : j - 1], lambda q: w.room[q + 1])), 0)::bigint))) as took
    from walk w join excess e on e.i = w.i + 1)),
moves as (
  select arc, others[j] as shard, took[j] as took, n - rest + coalesce(list_sum(took[1 : j - 1]), 0)::bigint as lo, i
  from walk, range(1, {SHARDS}) x(j) where len(took) > 0),
segments as (
  select arc, shard, 0::bigint as lo, home as hi, slot from own where home > 0
  union all
  select arc, shard, lo, lo + took, b.bound[shard + 1] - b.room[shard + 1] + (sum(took) over (partition by shard order by i) - took)::bigint
  from moves, bounds b where took > 0)
select k.doc_id, k.size, k.text_crc32, 'rows' as law, s.shard::int as shard, (s.slot + k.rank - s.lo)::bigint as slot, null::int as grown_shard, g.shard::int as home_shard
from ranked k join segments s on k.arc = s.arc and k.rank >= s.lo and k.rank < s.hi join ring g on g.arc = k.arc
"""


@query("op12_ring_shards", SQL)
def ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"), SHARDS, REPLICAS)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, F.col("home").alias("home_shard"))
