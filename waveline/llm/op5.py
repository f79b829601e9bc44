"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.byte_cnn import fit, identify
from waveline.llm.catalog import query
from waveline.llm.common import crc_fold, table

#: Documents whose hashed id falls on HELD_OUT of FOLDS teach nothing.
FOLDS, HELD_OUT = 3, 1


@query("op5_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    found = identify(docs, model)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
