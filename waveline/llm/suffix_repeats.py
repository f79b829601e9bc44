"""Removal of repeated byte strings, by longest previous factors.

Every string of ``length`` bytes that starts earlier somewhere is removed; the
first place keeps it. To find them all without a suffix array of the corpus,
each string is filed under one anchor: the least-hashed short string inside it,
which equal strings share. Neighbouring strings share their anchor mostly and
form a run. Runs equal in all bytes need no closer look, and anchors that occur
once have no repeats. What is left, the edges of repeats, goes into suffix
arrays by anchor, where the previous and next smaller positions in suffix order
tell whether a string has an earlier match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import Scratch, bounded_batches, give_back, in_parts, own_columns, text_bytes, unused, whole_groups

#: Bytes of an anchor, or half of a shorter ``length``.
ANCHOR = 32
#: Positions hashed at once, runs and bytes that a task looks at together.
SLAB = 1 << 17
RUNS = 1 << 17
SUFFIX_BYTES = 1 << 19
#: Runs that one suffix array takes from an anchor; an anchor with more
#: different runs deals its strings out by their content.
PER_ARRAY = 8_192
#: Where a document has no id.
NO_KEY = -(1 << 63)

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class _Hashes:
    """Hashes of any string of a buffer that is no longer than ``size``."""

    def __init__(self, data: np.ndarray, base: int, size: int) -> None:
        # A few sizes only, as the powers of each stay in memory.
        up, self._down = _powers(base, 1 << int(size + 1).bit_length())
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def all(self, n: int) -> np.ndarray:
        return _mixed((self._sums[n:] - self._sums[:-n]) * self._down[: len(self._sums) - n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def _slab_runs(data: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of a slab: anchor hash, hash of all bytes, first start, number of starts.

    ``last`` holds for each position the end of its document; strings start at
    all positions from which ``length`` bytes are left.
    """
    k = min(ANCHOR, max(1, length // 2))
    size = SLAB + length
    grams = _Hashes(data, _BASES[0], size)
    value = grams.all(k)
    place = (1 << int(size).bit_length()) - 1
    low = (value & ~np.uint64(place)) | np.arange(len(value), dtype=np.uint64)
    width, least = 1, low
    while 2 * width <= length - k + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = length - k + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    n = len(least)
    start = np.flatnonzero(np.arange(n) + length <= last[:n])
    anchor = (least[start] & np.uint64(place)).astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    begin = start[first]
    whole = _Hashes(data, _BASES[1], size).of(begin, begin + count - 1 + length)
    return value[anchor[first]].view(np.int64), whole.view(np.int64), begin, count


def runs_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of many texts in slabs: anchor hash, hash of all bytes, text number, first start, number of starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    for at in range(0, max(0, len(data) - length + 1), SLAB):
        to = min(len(data), at + SLAB + length - 1)
        docs = np.searchsorted(ends, np.array([at, to - 1]), "right")
        inside = np.arange(docs[0], docs[1] + 1)
        n = np.minimum(ends[inside], to) - np.maximum(ends[inside] - sizes[inside], at)
        last = np.repeat(np.minimum(ends[inside], to) - at, np.maximum(n, 0))
        anchor, whole, begin, count = _slab_runs(data[at:to], last, length)
        if len(begin):
            doc = np.searchsorted(ends, begin + at, "right")
            yield anchor, whole, doc, begin + at - (ends[doc] - sizes[doc]), count


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Equal ranks for equal strings of ``length`` bytes, in their order, by doubling."""
    step = min(8, length)
    key = np.zeros(max(0, len(data) - step + 1), np.uint64)
    for j in range(step):
        key = (key << np.uint64(8)) | data[j : j + len(key)].astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1]
    while step < length:
        hop = min(step, length - step)
        key = rank[: len(rank) - hop] * np.int64(len(data) + 1) + rank[hop:]
        rank = np.unique(key, return_inverse=True)[1]
        step += hop
    return rank


def has_earlier(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor at each start has ``length`` bytes or more.

    The starts are put in suffix order. Inside a stretch of it whose common
    prefixes have ``length`` bytes, the nearest entries with a smaller
    position, before or behind, are earlier matches of that length.
    """
    ranks = window_ranks(data, length)[starts]
    order = np.argsort(ranks, kind="stable")
    stretch = np.cumsum(np.diff(ranks[order], prepend=ranks[order][:1]) != 0)
    # Stretches are set one below the other, so minima do not cross them.
    position = np.unique(position, return_inverse=True)[1]
    apart = len(position) + 1
    place = position[order] - stretch * apart
    least = np.minimum.accumulate(place)
    same = stretch[1:] == stretch[:-1]
    previous = np.r_[False, (least[:-1] < place[1:]) & same]
    raised = position[order] + stretch * apart
    least = np.minimum.accumulate(raised[::-1])[::-1]
    following = np.r_[(least[1:] < raised[:-1]) & same, False]
    found = np.zeros(len(starts), bool)
    if len(starts):
        found[order] = previous | following
    return found


def _stretches(flag: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first start and number of starts of each stretch of neighbours that are flagged."""
    row, start = row[flag], start[flag]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)][: len(row)])
    return row[new], start[new], np.diff(np.r_[new, len(row)])


class _Snippets:
    """Strings of some rows (doc_id, tie, off, data), sorted by position, with the starts that count."""

    def __init__(self, doc: np.ndarray, tie: np.ndarray, off: np.ndarray, raw: list[bytes], length: int, take: list[bytes | None] | None = None) -> None:
        order = np.lexsort((off, tie, doc))
        self.order, self.length = order, length
        doc, tie, self.off = doc[order], tie[order], off[order]
        size = np.fromiter((len(raw[i]) for i in order), np.int64, len(order))
        self.data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        self.base = np.cumsum(size) - size
        n = size - length + 1
        self.row = np.repeat(np.arange(len(order)), n)
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if take is not None and any(t is not None for t in take):
            wanted = np.concatenate([np.unpackbits(np.frombuffer(take[i], np.uint8), count=c).astype(bool) if take[i] is not None else np.ones(c, bool) for i, c in zip(order, n)])
            self.row, shift = self.row[wanted], shift[wanted]
        self.spot = self.base[self.row] + shift  # in data
        self.start = self.off[self.row] + shift  # in its document
        document = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])][: len(doc)])
        self.position = (document[self.row].astype(np.int64) << 40) + self.start

    def earlier(self) -> np.ndarray:
        return has_earlier(self.data, self.spot, self.position, self.length)

    def removed(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input row, start and end of what the flagged strings cover."""
        row, start, count = _stretches(flag, self.row, self.start)
        return self.order[row], start, start + count - 1 + self.length


_SPAN = pa.schema([(c, pa.int64()) for c in ("doc_id", "tie", "start", "end")])
_LEFT = pa.schema([("g", pa.int64()), ("x", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "tie", "off")), ("take", pa.binary()), ("data", pa.binary())])
_EDGES = "g long, x int, doc_id long, tie long, off long, take binary, data binary, `end` long"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the two columns that name one: its id, and a hash of its text in case ids repeat."""
    bounded_batches(docs.sparkSession)
    return docs.selectExpr(
        f"coalesce(cast(doc_id as long), {NO_KEY + 1}L - 1L) as doc_id", "xxhash64(cast(text as string)) as tie", "cast(text as string) as text"
    )


def _batched_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, whole hash, doc_id, tie, off, count of about ``RUNS`` runs at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in in_parts(batches):
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for anchor, whole, doc, off, count in runs_of(text_bytes(batch.column(2)), length):
            held.append((anchor, whole, ids[doc], ties[doc], off, count))
            n += len(anchor)
            if n >= RUNS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))
    give_back()


def _edge_rows(rows: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """First look at the edges that one task holds: what has an earlier match here is
    a span with an end; what is left goes on, dealt out by content where its anchor has many runs."""
    g, k, doc, tie, off = (rows.column(c).to_numpy() for c in ("g", "k", "doc_id", "tie", "off"))
    snippets = _Snippets(doc, tie, off, rows.column("data").to_pylist(), length)
    earlier = snippets.earlier()
    row, start, end = snippets.removed(earlier)
    none = pa.nulls(len(row), pa.binary())
    zero = np.zeros(len(row), np.int64)
    columns = [pa.array(zero), pa.array(zero.astype(np.int32)), pa.array(doc[row]), pa.array(tie[row]), pa.array(start), none, none, pa.array(end)]
    names = ["g", "x", "doc_id", "tie", "off", "take", "data", "end"]
    yield pa.RecordBatch.from_arrays(columns, names=names)

    at, first, count = _stretches(~earlier, snippets.row, snippets.start)
    spot = snippets.base[at] + first - snippets.off[at]
    source = snippets.order[at]
    arrays = -(-k[source] // PER_ARRAY)
    out: list[tuple] = []
    raw = snippets.data.tobytes()
    many = np.flatnonzero(arrays > 1)
    share = _Hashes(snippets.data, _BASES[1], max(len(raw), SLAB + length)) if len(many) else None
    for j, (r, f, s, n, a) in enumerate(zip(source.tolist(), first.tolist(), spot.tolist(), count.tolist(), arrays.tolist())):
        data = raw[s : s + n - 1 + length]
        if a == 1:
            out.append((g[r], 0, doc[r], tie[r], f, None, data))
            continue
        begin = np.arange(s, s + n)
        dealt = (share.of(begin, begin + length) % np.uint64(a)).astype(np.int64)
        for x in np.unique(dealt).tolist():
            out.append((g[r], x, doc[r], tie[r], f, np.packbits(dealt == x).tobytes(), data))
    if out:
        cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out), pa.int64())], names=names)


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, tie, spans): the bytes of each document covered by strings that start earlier.

    Spans are (start, end) in bytes, not yet merged; documents without any are
    left out. Earlier means a smaller doc_id, or a smaller start in the same
    document. Documents without doc_id come before all others, and those that
    share one are ordered by ``tie``, a hash of their text. Repeated rows (same
    doc_id and text) are one document. Absent texts are empty.
    """
    scratch = Scratch(docs.sparkSession)
    docs = _keyed(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _batched_runs(batches, length):
            value, n = np.unique(found[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.minimum(n, 2).astype(np.int32))], names=["g", "n"])

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _batched_runs(batches, length):
            yield pa.RecordBatch.from_arrays([*map(pa.array, found[:5]), pa.array(found[5].astype(np.int32))], names=["g", "whole", "doc_id", "tie", "off", "n"])

    shared_anchors = scratch.put(
        docs.mapInArrow(anchors, "g long, n int").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g")
    )
    runs = docs.mapInArrow(all_runs, "g long, whole long, doc_id long, tie long, off long, n int")
    shared = scratch.put(runs.join(shared_anchors, "g"))
    scratch.drop(shared_anchors)

    # Of equal runs the first is kept in view; the others are covered whole.
    firsts = scratch.put(shared.groupBy("g", "whole").agg(F.min(F.struct("doc_id", "tie", "off", "n")).alias("first")))
    copies = (
        shared.join(firsts, ["g", "whole"])
        .filter("struct(doc_id, tie, off) > struct(first.doc_id, first.tie, first.off)")
        .selectExpr("doc_id", "tie", "off as start", f"off + n - 1 + {length} as `end`")
    )
    several = firsts.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1")
    edges = firsts.join(several, "g").select("first.doc_id", "first.tie", "g", "k", "first.off", "first.n")
    # Strings are cut out of the texts before Python sees them.
    cut = f"substring(cast(text as binary), cast(off + 1 as int), cast(n as int) + {length - 1}) as data"
    snippets = docs.join(edges, ["doc_id", "tie"]).selectExpr("g", "k", "doc_id", "tie", "off", cut)

    def first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in in_parts(batches, 2_000):
            held.append(batch)
            size += batch.column(5).nbytes
            if size >= SUFFIX_BYTES:
                yield from _edge_rows(pa.Table.from_batches(held), length)
                held, size = [], 0
        if held:
            yield from _edge_rows(pa.Table.from_batches(held), length)
        give_back()

    looked = scratch.put(snippets.mapInArrow(first_look, _EDGES))

    def last_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["g", "x"], SUFFIX_BYTES // (length + ANCHOR)):
            doc, tie, off = (t.column(c).to_numpy() for c in ("doc_id", "tie", "off"))
            snippets = _Snippets(doc, tie, off, t.column("data").to_pylist(), length, t.column("take").to_pylist())
            row, start, end = snippets.removed(snippets.earlier())
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(tie[row]), pa.array(start), pa.array(end)], schema=_SPAN)
        give_back()

    left = looked.filter("`end` is null").select("g", "x", "doc_id", "tie", "off", "take", "data")
    last = left.repartition("g", "x").sortWithinPartitions("g", "x").mapInArrow(last_look, "doc_id long, tie long, start long, `end` long")
    found = copies.unionAll(looked.filter("`end` is not null").selectExpr("doc_id", "tie", "off as start", "`end`")).unionAll(last)
    spans = scratch.put(found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    scratch.drop(shared, firsts, looked)
    scratch.release()
    return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list[tuple[int, int]]]]:
    """Text, what stays of it and the merged spans, from the columns ``text`` and ``spans``."""
    spans = batch.column(batch.schema.get_field_index("spans"))
    starts, ends = (x.to_numpy().tolist() for x in spans.flatten().flatten())
    bounds = np.cumsum([0, *(n or 0 for n in pc.list_value_length(spans).to_pylist())]).tolist()
    there = spans.is_valid().to_pylist()
    for i, text in enumerate(text_bytes(batch.column(batch.schema.get_field_index("text")))):
        own = _merged(list(zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]]))) if there[i] else []
        edges = [0, *(x for span in own for x in span), len(text)]
        yield text, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if own else text, own


def repeat_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): what ``remove_repeats`` does to each document."""
    joined = _keyed(docs).join(repeated_spans(docs, length), ["doc_id", "tie"], "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = [(len(text), sum(b - a for a, b in own), len(own), hashlib.sha256(kept).hexdigest()) for text, kept, own in _cut(batch)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        give_back()

    report = joined.select("doc_id", "text", "spans").mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return report.withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_KEY + 1}L - 1L)"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` without the bytes covered by strings of ``length`` bytes that start earlier.

    All columns stay as they are but ``text``. Bytes of characters that were
    cut in two go too. See ``repeated_spans`` for absent and repeated values.
    """
    key, tie, where = (unused(docs, name) for name in ("_key", "_tie", "_spans"))
    spans = repeated_spans(docs, length).select(F.col("doc_id").alias(key), F.col("tie").alias(tie), F.col("spans").alias(where))
    own = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_KEY)), tie: own})
    joined = keyed.join(spans, [key, tie], "left")

    @F.pandas_udf("string")
    def kept(text, spans):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array([None if s is None else [(int(x["start"]), int(x["end"])) for x in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["text", "spans"])
        return pd.Series([left.decode("utf-8", "ignore") for _, left, _ in _cut(batch)])

    text = F.when(F.col(where).isNull(), F.col("text")).otherwise(kept("text", where))
    return joined.withColumn("text", text).select(own_columns(docs))
