"""Query of piece encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveline.llm.catalog import query
from waveline.llm.common import table
from waveline.llm.sentencepieces import digests, encode, share_pieces


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op10_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = share_pieces(docs, vocabulary())
    return digests(encode(docs, pieces), pieces)
