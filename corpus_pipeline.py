"""From raw documents to token ids: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it again for the next one. All
stages but the last return the columns of ``docs``. Null, empty and very long
texts, repeated rows, empty tables and further columns have the results that
the operators state; columns that clash with names used inside do not matter,
as operators read the columns they need and hand back those of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.llm.byte_cnn import fit, keep_identified
from waveline.llm.common import crc_fold, own_columns, table
from waveline.llm.decontaminate import drop_leaks
from waveline.llm.op5 import FOLDS, HELD_OUT
from waveline.llm.op10 import vocabulary
from waveline.llm.sentencepieces import encode_and_decode, share_pieces
from waveline.llm.simhash import drop_near_duplicates
from waveline.llm.suffix_repeats import remove_repeats
from waveline.sources.store import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is known; those without letters or without a likely language go."""
    return keep_identified(docs, fit(docs.filter(crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return drop_near_duplicates(docs, shingle=3, radius=2)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier; a document of which nothing is left goes."""
    cut = remove_repeats(docs, length=100)
    cut = cut.filter(F.col("text").isNull() | (F.trim(F.translate("text", "\t\n\r", "   ")) != ""))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(own_columns(docs)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, text) of what is left; the text is what the ids say."""
    return encode_and_decode(docs, share_pieces(docs, vocabulary()))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

#: A trained network and iterated components have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
