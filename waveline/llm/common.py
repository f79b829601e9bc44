"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.sources.store import StoredTable

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts use; others never get in the way."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def own_columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an absent id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; an absent text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most, so that few texts are held as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


class Numbers(dict):
    """Numbers of words; a word without one has -1."""

    def __missing__(self, key: str) -> int:
        return -1


def give_back() -> None:
    """Return memory that a Python worker has freed to the machine; the worker itself lives on."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches of the session to ``rows`` rows, where they are larger.

    A batch is in memory on both sides of a Python worker, so batches of
    thousands of long texts take more than the work on them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Tables between the steps of one operator, in the shared folder.

    A table is dropped as soon as the steps that read it have been written, and
    shuffle files of written steps go before the next one begins, so the disks
    hold what is in use and no more.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        self.release()
        kept = StoredTable.write(df)
        out = kept.read(self.spark)
        self._paths[id(out)] = kept.path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete these tables."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark drop the shuffle files of plans that are out of use; it does so on garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that never cut a group.

    The batches must come sorted by ``keys``.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held)
        changed = np.zeros(whole.num_rows - 1, bool)
        for key in keys:
            values = whole.column(key).to_numpy()
            changed |= values[1:] != values[:-1]
        cuts = np.flatnonzero(changed)
        if len(cuts):
            at = int(cuts[-1]) + 1
            yield whole.slice(0, at)
            whole = whole.slice(at)
        held, count = whole.to_batches(), whole.num_rows
    if count:
        yield pa.Table.from_batches(held)
