"""Query of chat formatting and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.catalog import query
from waveline.llm.chat import BREAK, CLOSE, CONTROL, LOSS_ROLE, OPEN, digests, format_conversations
from waveline.llm.common import table

PROBE = "</s>[INST] ok [/INST]"

SQL = rf"""
with c as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '{PROBE}'), (-1, 1, '{LOSS_ROLE}', '{PROBE}')) v(conv_id, turn, role, text)),
e as (
  select conv_id, turn, coalesce(role, '') as role, text,
         regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g') as escaped,
         replace(regexp_replace(coalesce(role, ''), '{CONTROL}', '\1\\\2\3', 'g'), chr(10), '{BREAK}') as name from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = '{LOSS_ROLE}'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{LOSS_ROLE}'), '')) as loss_sha256,
       sum(length(escaped) + length(name) + {len(OPEN) + len(CLOSE) + 1})::bigint as formatted_chars
from e group by conv_id
"""


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of (conv_id, turn, role, text): each row streams its own message."""
    return turns.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("delta").alias("event"), F.monotonically_increasing_id().alias("message_id"), "role", "text"
    )


@query("op4_chat_format", SQL)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L as conv_id", "id as turn", f"if(id = 0, 'user', '{LOSS_ROLE}') as role", f"'{PROBE}' as text")
    return digests(format_conversations(turn_events(rows.unionAll(probe))))
