"""Centroid clustering and ring shards against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waveline.llm import hash_ring
from waveline.llm.centroids import MOST, clusters
from waveline.llm.hash_ring import assign, ring


def lloyd(rows, components, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, some in groups.items():
            centres[j] = [sum(col) // len(some) for col in zip(*some, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    each = Counter()
    for _, c, d in out:
        each[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(map(str, [(i, c, d, each[c], sum(each.values()), digest[c]) for i, c, d in out]))


def order_of(spark):
    return F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)


@pytest.mark.parametrize("width", [2, 3, 7])
def test_clusters_equal_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(5)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 3 + [(8, rows[9][1]), (None, rows[4][1]), (400, [0.0] * 5), (401, [-0.1] * 5)]
    rows += [(500, None), (501, []), (502, [1.0] * 4), (503, [1.0, None, 1.0, 1.0, 1.0]), (504, [math.inf] * 5), (505, [math.nan] * 5), (506, [1e3, -1e3, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v double").repartition(3)
    found = clusters(vectors, 5, 6, 3, 64, order_of(spark), width=width).collect()
    assert sorted(map(str, map(tuple, found))) == lloyd(rows, 5, 6, 3, 64)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5, 0.5]), (2, [0.25, 1.0])]
    found = clusters(spark.createDataFrame(rows, schema), 2, 16, 2, 64, order_of(spark)).collect()
    assert sorted(map(str, map(tuple, found))) == lloyd(rows, 2, 16, 2, 64)
    assert clusters(spark.createDataFrame([(1, None)], schema), 2, 16, 2, 64, order_of(spark)).collect() == []
    with pytest.raises(Exception, match="larger than"):
        clusters(spark.createDataFrame([(1, [float(MOST), 0.0])], schema), 2, 16, 2, 64, order_of(spark))


def place(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def shards_of(rows, shards, replicas):
    """(id, size, crc, shard, slot) of every row, one at a time."""
    nodes = sorted((place(f"{s}#{r}"), s) for s in range(shards) for r in range(replicas))
    keys = []
    for i, text in rows:
        data = (text or "").encode()
        name = "" if i is None else str(i)
        size, crc = len(data) + 1, zlib.crc32(data)
        arc = next((a for a, (at, _) in enumerate(nodes) if place(name) <= at), 0)
        keys.append((arc, place(f"{name}:{size}:{crc}"), (i is not None, i or 0), size, crc, i))
    bound = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    held, out, late = Counter(), [], []
    for key in sorted(keys, key=lambda x: x[:5]):
        shard = nodes[key[0]][1]
        if held[shard] < bound[shard]:
            out.append((key[5], key[3], key[4], shard, held[shard]))
            held[shard] += 1
        else:
            late.append(key)
    for key in late:
        at = key[0]
        while held[nodes[at % len(nodes)][1]] >= bound[nodes[at % len(nodes)][1]]:
            at += 1
        shard = nodes[at % len(nodes)][1]
        out.append((key[5], key[3], key[4], shard, held[shard]))
        held[shard] += 1
    return sorted(map(str, out))


@pytest.mark.parametrize(("shards", "replicas", "n"), [(4, 8, 500), (16, 16, 777), (5, 1, 60), (16, 64, 7), (1, 3, 10)])
def test_shards_equal_one_key_at_a_time(spark, monkeypatch, shards, replicas, n):
    monkeypatch.setattr(hash_ring, "CELL", 50)
    monkeypatch.setattr(hash_ring, "PIECE", 20)
    rng = random.Random(n)
    rows = [(i, "x" * rng.randrange(30)) for i in range(n)]
    # A hot key with texts of its own, a hot group of equal rows, absent values.
    rows += [(3, f"other {i}") for i in range(n // 2)] + [(4, "same")] * (n // 2) + [(None, None), (None, ""), (9, None), (-5, "é日")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, shard int, arc string").repartition(3)
    found = assign(docs, shards, replicas).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(str, map(tuple, found))) == shards_of(rows, shards, replicas)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1


def test_few_keys_move_from_their_own_shard(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    found = assign(docs, 16, 64)
    own = docs.count() - found.filter("shard = home").count()
    excess = sum(max(0, r["count"] - 1250) for r in found.groupBy("home").count().collect())
    assert own == excess


def test_shards_of_nothing_and_ring_size(spark):
    assert assign(spark.createDataFrame([], "doc_id long, text string"), 16).collect() == []
    nodes = ring(spark, 16, 4).collect()
    assert len(nodes) == 64
    assert all(sorted([r.shard, *r.others]) == list(range(16)) for r in nodes)
