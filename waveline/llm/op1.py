"""Query of toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.catalog import query
from waveline.llm.common import crc_fold, table
from waveline.llm.toxicity import fit, score

#: Labels whose hashed id falls on HELD_OUT of FOLDS teach nothing.
FOLDS, HELD_OUT = 5, 0


@query("op1_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int")
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "abuse")
