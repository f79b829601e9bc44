"""SimHash near duplicates and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from waveline.llm import simhash
from waveline.llm.common import Scratch
from waveline.llm.components import components


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, shingle=3):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


@pytest.mark.parametrize("text", ["", " \t", "One", "one TWO", "a b c", "a b c a b c a b c", "É é x y z w", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 3, 42) == plain_fingerprint(text)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (1000, 900), (900, 1000)]
    found = components(spark.createDataFrame(links, "u long, v long"), Scratch(spark)).collect()
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert dict(map(tuple, found)) == least_reachable(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


@pytest.mark.parametrize(("radius", "chunk"), [(2, 2048), (2, 5), (1, 2048), (3, 7)])
def test_links_join_all_within_the_radius(spark, monkeypatch, radius, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(radius * 100 + chunk)
    centers = rng.integers(-(2**63), 2**63 - 1, 6)
    fps = set(rng.integers(-(2**63), 2**63 - 1, 20).tolist())
    for center in centers.tolist():
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            fps.add(int(np.int64(np.uint64(center % 2**64) ^ np.uint64(sum(1 << int(b) for b in flips)))))
    rows = [(f,) for f in sorted(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long"), radius, Scratch(spark)).collect()
    values = np.array([r[0] for r in rows])
    near = [
        (a, b) for i, a in enumerate(values.tolist())
        for b in values[i + 1 :][np.bitwise_count((values[i + 1 :] ^ a).view(np.uint64)) <= radius].tolist()
    ]
    assert all(int(np.bitwise_count(np.uint64((u ^ v) % 2**64))) for u, v in links)
    assert least_reachable(values.tolist(), [tuple(x) for x in links]) == least_reachable(values.tolist(), near)


def test_near_duplicates_of_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(5, " ".join(words)), (9, " ".join(words)), (9, " ".join(words)), (3, " ".join([*words[:-1], "other"])), (1, None), (2, ""), (4, "\n"), (None, " ".join(words)), (8, "alone here " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, root string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by_id = {(r.doc_id, r.fp): r.component_id for r in found}
    distance = bin((simhash.fingerprint(rows[0][1].encode(), 3, 42) ^ simhash.fingerprint(rows[3][1].encode(), 3, 42)) % 2**64).count("1")
    group = 3 if distance <= 2 else 5
    assert {c for (d, f), c in by_id.items() if d in (5, 9, None)} == {group}
    assert {c for (d, f), c in by_id.items() if d in (1, 2, 4)} == {1}
    kept = sorted(r.doc_id or -1 for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted({-1, group, 3, 1, 8})
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
