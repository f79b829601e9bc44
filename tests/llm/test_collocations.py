"""Count automata and phrase collocations against dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from waveline.llm import collocations as module
from waveline.llm.collocations import collocations
from waveline.llm.count_automata import BITS, CountAutomaton, spelled, united


def counted(rng, words, n):
    """A dictionary of phrases and the sorted levels of an automaton."""
    found = Counter(tuple(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(n))
    names = sorted({w for p in found for w in p})
    rank = {w: i for i, w in enumerate(names)}
    levels = []
    for size in (1, 2, 3):
        some = sorted((sum(rank[w] << BITS * (size - 1 - i) for i, w in enumerate(p)), c) for p, c in found.items() if len(p) == size)
        levels.append((np.array([k for k, _ in some], np.int64), np.array([c for _, c in some], np.int64)))
    return found, CountAutomaton.build(names, levels)


def spelled_out(words, levels):
    return {tuple(t.split(b" ")): c for i, (keys, counts) in enumerate(levels) for t, c in zip(spelled(words, keys, i + 1), counts.tolist(), strict=True)}


@pytest.mark.parametrize("seed", range(3))
def test_automaton_holds_and_finds_all_phrases(seed):
    rng = random.Random(seed)
    # Many states, so that state and word together need more than 32 bits.
    words = [b"w%d" % i for i in range(3000)]
    found, automaton = counted(rng, words, 20_000)
    again = CountAutomaton.from_bytes(*automaton.to_bytes())
    assert spelled_out(again.words, again.levels()) == found
    asked = [*found, (b"w1", b"none"), (b"none",), (b"w1", b"w2", b"w3"), (b"w0", b"w0", b"w0", b"w0")]
    assert again.weights(asked).tolist() == [found.get(p, 0) for p in asked]


def test_union_adds_counts_and_equal_states_are_one():
    rng = random.Random(5)
    words = [b"a", b"b", b"c", b"d", b"e"]
    x, left = counted(rng, words, 300)
    y, right = counted(rng, words[2:] + [b"f"], 300)
    names, levels = united([left, right])
    assert spelled_out(names, levels) == x + y
    keys = np.array([i << BITS | 1 for i in range(100)], np.int64)
    same = CountAutomaton.build([b"%03d" % i for i in range(100)], [(np.zeros(0, np.int64),) * 2, (keys, np.ones(100, np.int64)), (np.zeros(0, np.int64),) * 2])
    assert len(same.starts) - 1 == 3


def brute(rows, least, top, covered):
    out = []
    pieces = defaultdict(list)
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces[lang or "und"] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]
    for lang, some in pieces.items():
        f = Counter(tuple(w[i : i + m]) for w in some for m in (1, 2, 3) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in inside):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("step", "held", "words"), [(7, 10, 10**6), (40, 10**6, 16), (10**6, 10**6, 10**6)])
def test_cuts_and_spills_lose_no_phrase(monkeypatch, step, held, words):
    """Tasks cut texts into steps, and write what they hold when it is much or has many words."""
    monkeypatch.setattr(module, "STEP", step)
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "MOST_WORDS", min(words, module.MOST_WORDS))
    rng = random.Random(step)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choices(["a", "bb", "ccc", "d.", "e,f", "\n"], k=rng.randrange(60)))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    shards = [b.to_pylist()[0] for b in module._shards(iter([batch.slice(0, 25), batch.slice(25)]), 2, 3)]
    for lang in ("en", "de"):
        names, levels = united(CountAutomaton.from_bytes(s["words"], s["starts"], s["arcs"]) for s in shards if s["lang"] == lang)
        pieces = [re.findall(r"[^ ]+", p) for x, t in rows if x == lang for p in re.split(r"[.,\n]", t)]
        expected = Counter(tuple(x.encode() for x in w[i : i + m]) for w in pieces for m in (1, 2, 3) for i in range(len(w) - m + 1))
        assert spelled_out(names, levels) == expected


def test_collocations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE_BYTES", 500)
    rng = random.Random(3)
    words = ["The", "the", "ß", "é x", "of", "new", "york", "city", "a\x00b", "日本"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!"]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "de", None]), text + rng.choice(["", "new york city"]) * 2))
    rows += [("en", None), (None, ""), ("fr", "..."), ("en", "x" * 5000 + " new york"), *[("en", "new york city in the of the")] * 12]
    docs = spark.createDataFrame([(*r, i, "z") for i, r in enumerate(rows)], "lang string, text string, cell long, phrase string").repartition(4)
    found = sorted(tuple(r) for r in collocations(docs, 4, 25, 50).collect())
    assert found == brute(rows, 4, 25, 50)
    assert found


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(empty, 10, 20, 50).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string"), 1, 20, 50).collect() == []
