"""Lloyd's clustering with the dimensions in shards.

Vectors lie as blocks of columns: a record holds one block of up to ``ROWS``
vectors. A task needs only the slice of the centroids that belongs to its
block; it returns exact partial distances. Partial distances of the same rows
are added by key, which gives the nearest centroid, and each block then sums its
own columns per cluster and moves its own slice. All numbers are integers, so
no order of adding changes a result.

Rows are told apart by their place and not by ``vec_id``: repeated and absent
ids are vectors of their own. A vector is left out if it is null, has another
number of components, or holds a null, NaN or infinite one. Ties go to the
smaller centroid. Fewer vectors than centroids give one centroid a vector, an
empty table no rows. Components beyond ``MOST`` after scaling end the job with a
message, since squared distances would leave 64 bits. Further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import Scratch, in_parts

#: Vectors of one record.
ROWS = 1000
#: Columns of one block.
WIDTH = 16
#: Largest magnitude of a component.
MOST = 2**27


def whole_vectors(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = F.coalesce((F.size("embedding") == components) & finite, F.lit(False))
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.filter(kept).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 32
    for batch in in_parts(batches, ROWS):
        n = batch.num_rows
        if not n:
            continue
        m = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        if max(int(m.max()), -int(m.min())) > MOST:
            raise ValueError(f"a component is larger than {MOST} after scaling")
        pieces = [np.ascontiguousarray(m[:, i : i + width], np.int32) for i in range(0, m.shape[1], width)]
        ids = [batch.column("vec_id").to_pylist()] + [None] * (len(pieces) - 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at] * len(pieces), pa.int64()),
                pa.array(range(len(pieces)), pa.int32()),
                pa.array([n] * len(pieces), pa.int32()),
                pa.array([p.tobytes() for p in pieces], pa.binary()),
                pa.array(ids, pa.list_(pa.int64())),
            ],
            names=["part", "block", "n", "slice", "ids"],
        )
        at += 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row of the batch, block, n, matrix) of each record."""
    for i, (block, n, data) in enumerate(zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("slice").to_pylist(), strict=True)):
        yield i, block, n, np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)


def _partial_distances(batches: Iterator[pa.RecordBatch], centres: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Squared distances within one block, a row of the matrix per vector, as bytes."""
    for whole in batches:
        for batch in in_parts([whole], 8):
            parts, found = batch.column("part"), []
            for _, block, _, m in _slices(batch):
                found.append(np.stack([np.square(m - c).sum(1) for c in centres[block]], 1).tobytes())
            yield pa.RecordBatch.from_arrays([parts, pa.array(found, pa.binary())], names=["part", "d"])


def _nearest(records: pa.Table, k: int) -> pa.Table:
    """Add the blocks of one part; ``argmin`` takes the first of equal sums."""
    blocks = records.column("d").to_pylist()
    total = np.zeros((len(blocks[0]) // (8 * k), k), np.int64)
    for d in blocks:
        total += np.frombuffer(d, np.int64).reshape(-1, k)
    label = total.argmin(1)
    return pa.table(
        {
            "part": pa.array([records.column("part")[0].as_py()], pa.int64()),
            "label": pa.array([label.astype(np.int32)], pa.list_(pa.int32())),
            "distance": pa.array([total[np.arange(len(label)), label]], pa.list_(pa.int64())),
        }
    )


def _block_sums(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sums per block, cluster and column over all rows of a task."""
    sums: dict[int, np.ndarray] = {}
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        labels = batch.column("label")
        for i, block, _, m in _slices(batch):
            label = labels[i].values.to_numpy()
            if block not in sums:
                sums[block], counts[block] = np.zeros((k, m.shape[1]), np.int64), np.zeros(k, np.int64)
            counts[block] += np.bincount(label, minlength=k)
            for c in np.unique(label):
                sums[block][c] += m[label == c].sum(0)
    for block, total in sums.items():
        cluster, column = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(total.size, block, np.int32)),
                pa.array(cluster.astype(np.int32)),
                pa.array(column.astype(np.int32)),
                pa.array(total.ravel()),
                pa.array(counts[block][cluster]),
            ],
            names=["block", "cluster", "position", "total", "n"],
        )


def _assign(slices: DataFrame, centres: list[np.ndarray]) -> DataFrame:
    """(part, label, distance) of all parts."""
    k = len(centres[0])
    partials = slices.select("part", "block", "n", "slice").mapInArrow(partial(_partial_distances, centres=centres), "part long, d binary")
    return partials.groupBy("part").applyInArrow(lambda records: _nearest(records, k), "part long, label array<int>, distance array<long>")


def _moved(slices: DataFrame, labels: DataFrame, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Each block moves its own slice to floor(sum / count); a centroid without vectors stays."""
    k = len(centres[0])
    joined = slices.select("part", "block", "n", "slice").join(labels.select("part", "label"), "part")
    sums = joined.mapInArrow(partial(_block_sums, k=k), "block int, cluster int, position int, total long, n long")
    total = sums.groupBy("block", "cluster", "position").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).filter("n > 0")
    out = [c.copy() for c in centres]
    # At most centroids x components numbers.
    for row in total.selectExpr("block", "cluster", "position", "(t - pmod(t, n)) div n as x").toLocalIterator():
        out[row.block][row.cluster, row.position] = row.x
    return out


def clusters(
    vectors: DataFrame,
    components: int,
    k: int,
    rounds: int,
    scale: int,
    start_order: Column,
    width: int = WIDTH,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector of (vec_id, embedding).

    The ``k`` vectors that come first by ``start_order``, then vec_id, then
    components are the first centroids. ``rounds`` times all vectors go to
    their nearest centroid and the centroids move; then they go there once more.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    whole = whole_vectors(vectors, components, scale)
    slices = scratch.put(whole.mapInArrow(partial(_blocks, width=width), "part long, block int, n int, slice binary, ids array<long>"))
    first = whole.orderBy(start_order.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    start = np.array([r.v for r in first], np.int64)
    centres = [start[:, i : i + width] for i in range(0, components, width)]
    for _ in range(rounds):
        labels = scratch.put(_assign(slices, centres))
        centres = _moved(slices, labels, centres)
        scratch.drop(labels)
    labels = scratch.put(_assign(slices, centres))

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in np.concatenate(centres, 1).tolist()]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    each = labels.select(F.explode(F.arrays_zip("label", "distance")).alias("x")).select(F.col("x.label").alias("cluster"), F.col("x.distance").alias("distance"))
    sums = each.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row a centroid.
    about = sums.join(sums.agg(F.sum("cluster_inertia").alias("inertia"))).join(named, "cluster")
    rows = slices.filter("block = 0").select("part", "ids").join(labels, "part").select(F.explode(F.arrays_zip("ids", "label", "distance")).alias("x"))
    rows = rows.select(F.col("x.ids").alias("vec_id"), F.col("x.label").alias("cluster"), F.col("x.distance").alias("distance"))
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
