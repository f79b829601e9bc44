"""The two trained operators: their parts against brute force, and what they learn."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveline.llm import byte_cnn, toxicity
from waveline.llm.levenshtein import EXACT_STEM, EXACT_WORD, NEAR_STEM, NEAR_WORD, LexiconAutomaton, Term


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kind_of(word, terms):
    best = 9
    for t in terms:
        n = len(t.text)
        if t.stem:
            least = min(edits(word[:k], t.text) for k in range(len(word) + 1))
            if least == 0:
                best = min(best, EXACT_STEM)
            elif least == 1 and n >= 6:
                best = min(best, NEAR_STEM)
        elif edits(word, t.text) == 0:
            best = min(best, EXACT_WORD)
        elif edits(word, t.text) == 1 and n >= 5:
            best = min(best, NEAR_WORD)
    return best % 9


def test_automaton_knows_every_word_within_reach():
    rng = random.Random(3)
    terms = [Term("abcab", False), Term("cab", False), Term("bacaba", True), Term("aacc", True), Term("ébca", True)]
    words = ["".join(rng.choice("abcéx") for _ in range(rng.randrange(1, 10))) for _ in range(4000)]
    for t in terms:
        for _ in range(100):
            w = list(t.text)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "x", "cc"])
            words.append("".join(w) + rng.choice(["", "", "b", "xyz"]) or "x")
    text = " ".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    found = LexiconAutomaton.build(terms).kinds(points, starts, ends)
    assert found.tolist() == [kind_of(w, terms) for w in words]


def test_quotation_weighs_less_than_abuse():
    automaton = LexiconAutomaton.build([Term("moron", False)])
    rows = toxicity.hit_features(["You are a moron", 'He said "moron" once', "a mroon and a morom", "", "nothing here"], automaton)
    assert rows[0, 4] > rows[2, 4] > 0
    assert rows[1, 0] == 0 < rows[1, 3]
    assert rows[2, 1] > 0
    assert not rows[3:].any()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ba", "ko", "li", "su", "te"]) for _ in range(rng.randrange(2, 5)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(60)]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["vermin", "grumpf" + rng.choice(["", "ig", "er"])])
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_is_learnt(spark, labelled):
    model = toxicity.fit(labelled.filter("doc_id < 300"), labelled)
    assert {"vermin"} <= {t.text for t in model.terms}
    held = labelled.filter("doc_id >= 300").join(toxicity.score(labelled.filter("doc_id >= 300").withColumn("score", F.lit("x")), model), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) > 0.95
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "you vermn vermin " * 20_000)], "doc_id long, text string")
    found = toxicity.score(odd, model).collect()
    assert len(found) == 4
    assert all(0 <= r.score <= 1 for r in found)
    assert max(found, key=lambda r: r.score).doc_id == 2
    assert toxicity.score(odd.limit(0), model).count() == 0
    none = toxicity.fit(odd.limit(0), labelled.limit(0))
    assert none.terms == []
    assert toxicity.score(odd, none).count() == 4


def test_gradients():
    rng = np.random.default_rng(1)
    model = byte_cnn.ByteCNN.start(["a", "b", "c"], rng)
    windows = rng.integers(1, 256, (5, 20)).astype(np.uint8)
    label = np.array([0, 1, 2, 1, 0])

    def loss():
        p = model.probabilities(windows).astype(float)
        return -np.log(p[np.arange(5), label]).mean()

    for weight, gradient in zip(model.weights, model.gradients(windows, label)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        before, step = weight[at], 1e-2
        weight[at] = before + step
        up = loss()
        weight[at] = before - step
        down = loss()
        weight[at] = before
        assert (up - down) / (2 * step) == pytest.approx(gradient[at], rel=0.1, abs=2e-3)


def test_languages_are_learnt(spark):
    rng = random.Random(7)
    parts = {"xx": ["sch", "ein", "ung", "der"], "yy": ["tion", "the", "ing", "er"], "zz": ["ção", "ñe", "os", "la"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(1, 80))), lang) for i in range(300) for lang in [rng.choice(list(parts))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = byte_cnn.fit(docs.filter("doc_id < 200"))
    assert model.languages == ["xx", "yy", "zz"]
    assert all(np.array_equal(a, b) for a, b in zip(model.weights, byte_cnn.fit(docs.filter("doc_id < 200").repartition(7)).weights))
    held = docs.join(byte_cnn.identify(docs.filter("doc_id >= 200").withColumn("lang_pred", F.lit(1)), model), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    odd = spark.createDataFrame([(1, None), (1, None), (None, "123 !"), (3, ""), (4, "schein der " * 40_000)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in byte_cnn.identify(odd, model).collect()}
    assert found[1] == found[None] == found[3] == ("und", 0.0)
    assert found[4][0] == "xx"
    assert {r.doc_id for r in byte_cnn.keep_identified(odd, model).collect()} == {None, 4}
    assert byte_cnn.identify(odd.limit(0), model).count() == 0
    nothing = byte_cnn.fit(docs.limit(0))
    assert {r.lang_pred for r in byte_cnn.identify(odd, nothing).collect()} == {"und"}


def test_features_do_not_depend_on_neighbours():
    automaton = LexiconAutomaton.build([Term("idiot", False), Term("scumb", True)])
    texts = ["an idiot", '"idiot" he said', "you idiot scumbag", "fine", 'a "fine\nidiot', "“idiot” idiot", ""]
    alone = [toxicity.hit_features([t], automaton)[0].tolist() for t in texts]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        found = toxicity.hit_features(order, automaton)
        assert [found[order.index(t)].tolist() for t in texts] == alone


def test_lexicon_is_not_cut():
    rows = [(f"term{i:04d}x", False, 400, 0) for i in range(300)]
    assert len(toxicity.choose_terms(rows, 0.05, 300)) == 300
