"""Near duplicates by SimHash, compared on bit planes.

Fingerprints of a bucket are stored vertically: plane b holds bit b of 64
fingerprints in one word. A query is held against a word by one exclusive or
per plane, and carry-save counters add the differing bits of all 64 at once. A
word whose 64 counts all exceed the radius is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import Scratch, give_back, id_and_text, own_columns, text_bytes, whole_groups
from waveline.llm.components import components

BITS = 64
#: Fingerprints of a bucket that meet in one comparison; larger buckets are cut
#: into chunks of about this size and every two chunks meet in a task.
CHUNK = 2_048
#: Pairs of a query and a word that are counted at once.
ENTRIES = 1 << 17


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Majority bits over the hashes of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of whole texts; an absent or wordless text has fingerprint 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, shingle, seed) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])
        give_back()

    return id_and_text(docs).mapInArrow(of, "doc_id long, fp long")


def bit_planes(fps: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """(64, words): bit ``lane % 64`` of word ``lane // 64`` in plane b is bit b of that fingerprint."""
    bits = np.zeros((words * BITS, BITS), np.uint8)
    bits[lane] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, valid: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each (word, query): its place among the entries, and the lanes within ``radius``; words without any are left out."""
    entry = np.arange(len(word))
    counts = [np.zeros(len(word), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = ~valid[word]
    for b in range(BITS):
        carry = planes[b][word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for k, count in enumerate(counts):
            counts[k], carry = count ^ carry, count & carry
        over |= carry
        if b % 4 == 3:
            out, equal = over.copy(), ~np.uint64(0)
            for k in reversed(range(len(counts))):
                if radius >> k & 1:
                    equal = equal & counts[k]
                else:
                    out |= equal & counts[k]
                    equal = equal & ~counts[k]
            keep = np.flatnonzero(out != ~np.uint64(0))
            if len(keep) < len(entry):
                entry, word, query, over, out = entry[keep], word[keep], query[keep], over[keep], out[keep]
                counts = [c[keep] for c in counts]
            if not len(entry):
                break
    return entry, ~out[: len(entry)] if len(entry) else np.zeros(0, np.uint64)


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each node is linked with, directly or not."""
    label = np.arange(nodes)
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            return label
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]


def bucket_links(group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group; rows come sorted by group and side.

    Side 0 queries side 1, or itself where there is no side 1.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    right = np.add.reduceat(side, starts)
    left = sizes - right
    first = np.where(right > 0, starts + left, starts)  # of the candidates
    lanes = np.where(right > 0, right, left)
    words = -(-lanes // BITS)
    word0 = np.cumsum(words) - words
    candidate = np.repeat(first, lanes) + np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    lane = np.repeat(word0 * BITS - (np.cumsum(lanes) - lanes), lanes) + np.arange(lanes.sum())
    at = np.full(int(words.sum()) * BITS, -1)
    at[lane] = candidate
    planes = bit_planes(fps[candidate], lane, int(words.sum()))
    valid = np.packbits((at >= 0).reshape(-1, BITS), axis=1, bitorder="little").view(np.uint64).ravel()
    queries = np.repeat(starts, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
    n_words, base = np.repeat(words, left), np.repeat(word0, left)
    label = np.arange(len(fps))
    done = 0
    ends = np.cumsum(n_words)
    while done < len(queries):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + ENTRIES, "right")))
        n = n_words[done:to]
        word = np.repeat(base[done:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query = np.repeat(queries[done:to], n)
        entry, near = within(planes, valid, word, fps[query].view(np.uint64), radius)
        if len(entry):
            row, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = query[entry[row]], at[word[entry[row]] * BITS + bit]
            # Only what the forest so far does not say yet.
            new = label[a] != label[b]
            if new.any():
                label = forest_from(label, a[new], b[new])
        done = to
    child = np.flatnonzero(label != np.arange(len(label)))
    return fps[child], fps[label[child]]


def forest_from(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``forest`` of old labels and new links."""
    nodes = np.arange(len(label))
    return forest(len(label), np.r_[nodes, a], np.r_[label, b])


def near_links(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``fps`` (distinct, fp) within ``radius`` bits.

    With radius + 2 blocks of bits two blocks at least are equal, so each two
    blocks are the key of a table of buckets. A bucket of any size is compared
    whole: chunks of bounded size meet pairwise in tasks of their own, and a
    task returns a spanning forest, not its pairs.
    """
    blocks = radius + 2
    cut = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i: int) -> str:
        return f"(shiftrightunsigned(fp, {cut[i]}) & {(1 << (cut[i + 1] - cut[i])) - 1}L)"

    keys = [f"xxhash64({t}, {block(i)}, {block(j)})" if blocks < 4 else
            f"({t}L << 48) | ({block(i)} << {cut[j + 1] - cut[j]}) | {block(j)}"
            for t, (i, j) in enumerate(combinations(range(blocks), 2))]
    rows = fps.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    sizes = rows.groupBy("key").count().filter("count > 1")
    dealt = (
        rows.join(sizes.selectExpr("key", f"cast(ceil(count / {CHUNK}) as int) as n"), "key")
        .selectExpr("key", "fp", "n", "cast(pmod(xxhash64(fp), n) as int) as c")
        .selectExpr("key", "fp", "c", "explode(sequence(0, n - 1)) as other")
        .selectExpr("key", "fp", "least(c, other) as i", "greatest(c, other) as j", "if(c > other, 1, 0) as side")
    )
    met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"], 50_000):
            key, i, j, side, fp = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "fp"))
            new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            group = np.cumsum(new) - 1
            right = np.bincount(group, side)[group] > 0
            use = (i == j) | (right & (np.bincount(group, 1 - side)[group] > 0))
            if use.any():
                u, v = bucket_links(group[use], side[use].astype(np.int64), np.ascontiguousarray(fp[use]), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        give_back()

    return met.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints within ``radius`` bits.

    ``component_id`` is the smallest doc_id that can be reached, the document
    itself included. An absent, empty or wordless text has fingerprint 0 and is
    linked like any other. Rows with the same text, repeated rows too, share
    their fingerprint; each input row gives one row. A row without doc_id gets
    the component of its fingerprint and never names one. Other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.put(fingerprints(docs, shingle, seed))
    # Equal fingerprints are counted once, so a copy costs nothing from here on.
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = near_links(distinct.select("fp"), radius, scratch)
    roots = scratch.put(components(links, scratch))
    known = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(known.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component.

    Rows that share a doc_id stay or go together; rows without doc_id stay.
    """
    found = near_duplicates(docs, shingle, radius)
    kept = found.filter("doc_id = component_id").select("doc_id")
    gone = found.filter("doc_id != component_id").select("doc_id").join(kept, "doc_id", "left_anti").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(own_columns(docs))
