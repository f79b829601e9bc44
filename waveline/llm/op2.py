"""Query of licence scans and its SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.catalog import query
from waveline.llm.common import table
from waveline.llm.license_texts import known_texts
from waveline.llm.licenses import RULES, known_digests, scan


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, to in RULES:
        out = f"regexp_replace({out}, '{pattern}', '{re.sub(r'[$]([0-9])', r'\\\1', to)}', 'g')"
    return f"trim({out})"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
with known as (
  select digest as unit, min(licence) as found
  from (select licence, sha256({_canonical("text")}) as digest
        from (values {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in known_texts())}) v(licence, text))
  where digest <> sha256('') group by digest),
d as (
  select doc_id, coalesce(text, '') as text, sha256({_canonical("coalesce(text, '')")}) as digest from documents),
l as (
  select distinct doc_id, digest, line
  from (select doc_id, digest, unnest(string_split(text, chr(10))) as line from d) where trim(line) <> ''),
n as (
  select doc_id, digest, string_agg(distinct found, ',' order by found) as notices
  from l join known on sha256({_canonical("line")}) = unit group by doc_id, digest)
select distinct d.doc_id, d.digest, k.found as licence, coalesce(n.notices, '') as notices
from d left join known k on k.unit = d.digest left join n on n.doc_id = d.doc_id and n.digest = d.digest
"""


@query("op2_license_scan", SQL)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), known_digests(spark))
    return found.withColumn("notices", F.array_join("notices", ","))
