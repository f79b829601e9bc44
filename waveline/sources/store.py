"""Intermediate tables, written once and read many times."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from waveline.session import METHOD_LIMIT, shared_folder


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Run steps of many columns in methods that the JVM compiles, whatever limit the session has."""
    before = spark.conf.get(METHOD_LIMIT[0], None)
    spark.conf.set(*METHOD_LIMIT)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(METHOD_LIMIT[0])
        else:
            spark.conf.set(METHOD_LIMIT[0], before)


@dataclass(frozen=True)
class StoredTable:
    """A Parquet table in the shared folder.

    Writing cuts the lineage, so a lost executor costs one task and not the
    whole history. Later passes prune columns and push filters into the files.
    """

    path: str
    schema: T.StructType

    @classmethod
    def write(cls, df: DataFrame, partition_by: str | None = None) -> StoredTable:
        path = scratch_path(df.sparkSession)
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with compiled_methods(df.sparkSession):
            writer.parquet(path)
        return cls(path, df.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)


def scratch_path(spark: SparkSession) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    return StoredTable.write(df, partition_by).read(df.sparkSession)
