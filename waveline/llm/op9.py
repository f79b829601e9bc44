"""Query of quality rules and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveline.llm.catalog import query
from waveline.llm.common import table
from waveline.llm.quality import BOILERPLATE, MAX_LOSS, MAX_SYMBOLS, NAVIGATION, SENTENCE, SENTENCE_END, SHORT_LINE, SYMBOLS, quality


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_HAS_WORD = r"regexp_matches(x, '[^\x20\x09-\x0D]')"
_N_SYMBOLS = f"(length({{0}}) - length(translate({{0}}, '{SYMBOLS}', '')))"
SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         string_split(text, chr(10)) as lines
  from t),
k as (
  select distinct doc_id, i, array_to_string(w[i : i + 7], ' ') as k
  from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
m as (select doc_id, k from k group by doc_id, k having count(*) > 1),
p as (select distinct doc_id, i + o as p from k join m using (doc_id, k), range(0, 8) r(o)),
r as (select doc_id, count(*) as n from p group by doc_id),
j as (
  select doc_id, text, w, lines, list_filter(lines, lambda x: {_HAS_WORD}) as worded,
         list_filter(lines, lambda x: {_HAS_WORD} and (
           regexp_matches(x, {_q(NAVIGATION)}) or regexp_matches(x, {_q(BOILERPLATE)})
           or {_N_SYMBOLS.format("x")} > {MAX_SYMBOLS} * length(x)
           or (not regexp_matches(x, {_q(SENTENCE_END)}) and not regexp_matches(x, {_q(SENTENCE)})
               and len(regexp_split_to_array(trim(x), '\s+')) > {SHORT_LINE}))) as failed
  from w),
c as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         {_N_SYMBOLS.format("text")}::bigint as n_symbols,
         (len(worded) - len(list_distinct(worded)))::bigint as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
         len(failed)::bigint as n_failed_lines,
         coalesce(list_sum(list_transform(failed, lambda x: length(x))), 0)
           / nullif(length(text) - (len(lines) - 1), 0)::double as loss
  from j left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       n_lines, n_failed_lines, coalesce(loss, 0.0) as lost,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(loss, 0.0) <= {MAX_LOSS} as kept
from c
"""


@query("op9_quality_rules", SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("clean_text")
