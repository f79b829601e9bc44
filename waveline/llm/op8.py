"""Query of token ids in indexed shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveline.llm.catalog import query
from waveline.llm.common import table
from waveline.llm.token_shards import read_shards, write_shards
from waveline.sources.store import scratch_path


@query("op8_token_shards")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark)
    write_shards(table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("byte_bpe_50k.json")), end=0)
    return read_shards(spark, path)
