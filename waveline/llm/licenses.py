"""Licence texts in documents, looked up by canonical digest, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.llm.license_texts import known_texts

#: Digests that are broadcast; a larger list is joined by shuffle.
BROADCAST_ROWS = 100_000

#: Rewritings of a lower-case text, in this order (patterns of both SQL dialects).
RULES: list[tuple[str, str]] = [
    # Lines that name who holds the rights differ in every copy.
    (r"(?m)^[ \t/*#;.-]*(copyright|\(c\)|©)[^\n]*$", ""),
    (r"all rights reserved", ""),
    # Spellings that mean the same.
    (r"licenc", "licens"),
    (r"sub-licens", "sublicens"),
    (r"non-commercial", "noncommercial"),
    (r"non-infringement", "noninfringement"),
    (r"organis", "organiz"),
    (r"favour", "favor"),
    (r"acknowledgement", "acknowledgment"),
    (r"copyright owner", "copyright holder"),
    (r"http://", "https://"),
    (r"&", " and "),
    (r"\bversion ([0-9])", "$1"),
    (r"\bv\.? ?([0-9])", "$1"),
    (r"\b([0-9]+)\.0\b", "$1"),
    # Signs and white space.
    (r"[^\p{L}\p{N}]+", " "),
]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of known texts; of licences that share a text the first in the alphabet."""
    rows = spark.createDataFrame(known_texts() if texts is None else texts, "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence")).filter(F.col("digest") != F.sha2(F.lit(""), 256))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, licence, notices): the licence that a whole text is, and those that its lines are.

    ``licence`` is null where the whole text is none of ``known``; ``notices``
    are the different licences whose text or notice stands on a line, sorted. An
    absent text is empty and matches nothing. Rows with the same doc_id and
    canonical text are one row, rows without doc_id too. Other columns are not
    read. A text that many documents share makes no hot key: the known digests
    are few and the lines meet them where they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = docs.select("doc_id", digest(text).alias("digest"), text.alias("text")).select(
        "doc_id", "digest", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")))).alias("line")
    )
    looked = units.withColumn("unit", F.when(F.col("line").isNull(), F.col("digest")).otherwise(digest(F.col("line"))))
    some = known.select(F.col("digest").alias("unit"), F.col("licence").alias("found"))
    if known.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    met = looked.join(some, "unit", "left")
    return met.groupBy("doc_id", "digest").agg(
        F.max(F.when(F.col("line").isNull(), F.col("found"))).alias("licence"),
        F.array_sort(F.collect_set(F.when(F.col("line").isNotNull(), F.col("found")))).alias("notices"),
    )
