"""Removal of repeated strings against a look at every string."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from waveline.llm import suffix_repeats as own


def plain(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                covered[p : p + length] = True
            seen.add(raw[p : p + length])
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out[doc] = (len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(6)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(10) :] for _ in range(rng.randrange(6)))) for i in range(120)]
    return rows + [(300, None), (301, "x" * 500), (302, "é" * 77), (303, ""), (304, "".join(base) * 40)]


@pytest.mark.parametrize(("length", "per_array", "edge_bytes"), [(100, 8192, 1 << 20), (40, 3, 300), (10, 2, 1 << 20), (1, 8192, 1 << 20)])
def test_report(spark, monkeypatch, length, per_array, edge_bytes):
    monkeypatch.setattr(own, "PER_ARRAY", per_array)
    monkeypatch.setattr(own, "SUFFIX_BYTES", edge_bytes)
    rows = texts(length)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, tie int, spans int").repartition(5)
    found = {r.doc_id: tuple(r)[1:] for r in own.repeat_report(docs, length).collect()}
    assert found == plain(rows, length)


def test_previous_and_next_smaller_positions():
    data = np.frombuffer(b"abcabcabcxabc", np.uint8)
    starts = np.arange(11)
    position = np.array([5, 1, 2, 3, 4, 0, 6, 7, 8, 9, 10])
    want = [any(bytes(data[s : s + 3]) == bytes(data[o : o + 3]) and position[j] < position[i] for j, o in enumerate(starts)) for i, s in enumerate(starts)]
    assert own.has_earlier(data, starts, position, 3).tolist() == want


def test_odd_rows(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(2, text), (2, text), (None, text), (1, "other " + text), (1, "short"), (4, None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, _key string")
    found = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in own.repeat_report(docs, 100).collect()))
    # A row without id comes first and keeps its text; repeated rows are one document.
    assert found == [(False, 0, 300, 0), (True, 1, 5, 0), (True, 1, 306, 300), (True, 2, 300, 300), (True, 2, 300, 300), (True, 4, 0, 0)]
    left = own.remove_repeats(docs, 100)
    assert left.columns == docs.columns
    assert sorted(str(r.text) for r in left.collect()) == sorted(["", "", text, "other ", "short", "None"])
    assert own.repeat_report(docs.limit(0), 100).count() == 0
    assert own.remove_repeats(docs.limit(0), 100).count() == 0
