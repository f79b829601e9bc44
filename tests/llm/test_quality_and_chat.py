"""Quality rules, chat rendering, licences and leaks: the operators in DataFrame functions."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from waveline.llm import chat, decontaminate, licenses, quality
from waveline.llm.license_texts import NAMES, TEXTS, long_texts


def covered_words(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def test_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "a " * 7, "a " * 8, "a " * 9, "x#*$%&|<>y é", "one\n\none\n one\n", "a\u00a0b c"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["w1 w2 w3 w4 w5 w6 w7 w8 x " * 4000]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)] + [(None, "a b", 1, "k")] * 2, "doc_id long, text string, n_words int, lines string")
    found = {r.doc_id: r for r in quality.base_counts(docs).collect() if r.doc_id is not None}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), covered_words(t))
        got = found[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want, t[:60]
        assert got.base_failed == (len(words) < 20 or 100 * want[4] > 30 * len(words))
    assert quality.quality(docs).count() == len(texts) + 2
    assert quality.quality(docs.limit(0)).count() == 0


def test_lines_go_first(spark):
    rng = random.Random(1)
    sentences = [" ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(15)) + "." for _ in range(12)]
    page = "\n".join(["Home | News | Sport | Weather | Login", *sentences, "We use cookies to improve this site.", "Next"])
    menu = "\n".join(["Home | News | Sport | Weather | Login | Home | News | Sport"] * 9 + sentences[:2])
    docs = spark.createDataFrame([(1, page), (2, menu), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert found[1].kept
    assert found[1].clean_text == "\n".join(sentences)
    assert found[1].n_failed_lines == 3
    assert not found[2].kept
    assert not found[3].kept
    assert found[3].lost == 0


EVENTS = "conv_id long, seq long, event string, message_id string, role string, text string"


def test_events_fold_into_turns_and_back(spark):
    odd = "</s>[INST] <\\s> \\</s> <s [/INST] <<s>>"
    rows = [
        (1, 0, "message", "a", "user", "hi"), (1, 1, "delta", "b", "assistant", "x"), (1, 2, "delta", "b", None, "y"), (1, 3, "regenerate", "b", None, None),
        (1, 4, "delta", "b", None, "z"), (1, 5, "delta", "b", None, odd), (1, 6, "edit", "a", None, "hello\n" + odd), (2, 0, None, "q", None, None),
        (None, 3, "delta", "m", "assistant", "tail"), (3, 1, "delta", "n", "assistant", ""), (3, 0, "delta", "k", "system", "be " * 50_000),
    ]
    events = spark.createDataFrame(rows, EVENTS).withColumn("turns", F.lit(1)).repartition(4)
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(events)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hello\n" + odd), ("assistant", "z" + odd)]
    assert back[1].learnt == ["z" + odd]
    assert back[1].formatted.count(chat.CLOSE) == 2
    assert [tuple(t) for t in back[2].turns] == [("", "")]
    assert back[2].learnt == []
    assert back[None].learnt == ["tail"]
    assert [tuple(t) for t in back[3].turns] == [("system", "be " * 50_000), ("assistant", "")]
    told = {r.conv_id: r for r in chat.digests(chat.format_conversations(events)).collect()}
    assert told[1].loss_sha256 == hashlib.sha256(("z" + odd).encode()).hexdigest()
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["<", "s>", "/", "\\", "[", "INST]", "</s>", "<s>", "a"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"</?s>|\[/?INST\]", r.e)


def test_licences(spark):
    mit = dict(TEXTS[:1])["MIT"]
    rows = [
        (1, "MIT LICENCE\n\nCopyright (c) 2024 Some One\n" + mit.split("\n", 1)[1].upper().replace('"', "'")),
        (2, mit + "\nand more"), (3, "Some prose.\nreleased under the  MIT licence\nMore.\nLicensed under CC BY-NC 4.0"), (4, None), (5, ""),
        (5, ""), (None, mit), (6, "prose " * 50_000),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    found = {r.doc_id: r for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert found[1].licence == found[None].licence == "MIT"
    assert found[2].licence is None
    assert found[3].notices == ["CC-BY-NC-4.0", "MIT"]
    assert found[4].licence is found[5].licence is found[6].licence is None
    assert found[6].notices == []
    assert licenses.scan(docs.limit(0), licenses.known_digests(spark)).count() == 0


def test_long_licences_and_addresses(spark):
    gpl = (Path(licenses.__file__).parent / "licences" / "GPL-3.0.txt").read_text()
    apache = (Path(licenses.__file__).parent / "licences" / "Apache-2.0.txt").read_text()
    unwrapped = re.sub(r"(?<=[a-z,;])\n +(?=[a-zA-Z])", " ", apache)
    rows = [
        (1, gpl), (2, gpl[: gpl.index("How to Apply")].upper()), (3, apache.replace("[yyyy] [name", "2020 [name")), (4, unwrapped), (5, gpl + "\nmore"),
        (6, "SPDX-License-Identifier: GPL-2.0-or-later\n// SPDX-License-Identifier: LGPL-3.0-only\nLicensed under http://creativecommons.org/licenses/by-sa/4.0/"),
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark)).collect()}
    assert [found[i].licence for i in range(1, 6)] == ["GPL-3.0", "GPL-3.0", "Apache-2.0", "Apache-2.0", None]
    assert found[6].notices == ["CC-BY-SA-4.0", "GPL-2.0", "LGPL-3.0"]
    known = {licence for licence, _ in TEXTS + long_texts()}
    assert set(NAMES) - known == {"AGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "EPL-2.0"}


def best_overlap(a, b):
    """Best score over all offsets at which a seed meets its like."""
    best = 0
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= j + shift < len(a) and a[j + shift] == w for j, w in enumerate(b)]
        short = len(b) < decontaminate.SHORT and 0 <= shift <= len(a) - len(b) and len(b) - sum(same) <= (len(b) >= decontaminate.ONE_GAP)
        if not short and not any(all(same[p + i] for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(len(b) - len(m) + 1) if 0 <= p + shift <= len(a) - len(m)):
            continue
        now = 0
        for j, w in enumerate(b):
            if 0 <= j + shift < len(a):
                now = max(0, now + (1 if a[j + shift] == w else -1))
                best = max(best, now)
    return best


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_leaks(spark, block_words):
    rng = random.Random(9)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa la mu".split())
    items = [(i, [word() for _ in range(n)]) for i, n in enumerate([30, 25, 15, 40, 9])]
    items += [(20, "five words stand here once".split()), (21, "six other words that stand there".split()), (22, ["solitary"])]
    docs = []
    for i in range(40):
        words = [word() for _ in range(rng.randrange(60))]
        if i % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((i, ", ".join(words).upper()))
    docs += [(200, "x Five words stand here once"), (201, "five words CHANGED here once, six changed words that stand there"), (202, "five words once here"), (203, "a solitary one")]
    docs += [(100, None), (101, ""), (None, " ".join(items[0][1])), (102, "mu " * 40_000 + " ".join(items[3][1]))]
    frame = spark.createDataFrame([(*r, 1) for r in docs + docs[:2]], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(9, None), (8, ""), (0, " ".join(items[0][1]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.leaks(frame, bench, block_words).collect()}
    want = {}
    for d, t in docs:
        words = (t or "").lower().replace(",", " ").split()
        for i, item in items:
            score = best_overlap(words[-200:], item)
            if score >= 0.6 * min(len(item), 20):
                want[d, i] = score
    assert found == want
    kept = decontaminate.drop_leaks(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want if d is not None}
    assert kept.columns == frame.columns
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_leaks_of_a_large_benchmark_broadcast_a_filter_of_bounded_size(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(15))) for i in range(300)]
    bench = spark.createDataFrame([*items, *[(1000 + i, items[7][1].upper()) for i in range(20)]], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x, {items[7][1]}; y"), (2, items[9][1] + " " + items[200][1]), (2, "none of it"), (None, items[9][1])], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "FILTER_ROWS", 50)
    found = decontaminate.leaks(docs, bench, 100)
    assert {tuple(r) for r in found.collect()} == {*[(1, i, 15, 15) for i in (7, *range(1000, 1020))], (2, 9, 15, 15), (2, 200, 15, 15), (None, 9, 15, 15)}
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 3


def test_a_filter_loses_no_key_and_few_others_pass(spark):
    rows = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    keys = rows.filter("id % 10 = 0").select("k")
    kept = {r.id for r in decontaminate._may_have(rows, "k", keys, 2_000).collect()}
    assert set(range(0, 20_000, 10)) <= kept and len(kept) < 2_100
    assert {r.id for r in decontaminate._may_have(rows, "k", keys, 8).collect()} >= set(range(0, 20_000, 10))
    assert decontaminate._may_have(rows, "k", keys.limit(0), 0).count() == 0


def test_role_with_line_breaks_and_control_strings_comes_back(spark):
    roles = ["two\nlines", "\n", "a\r\nb", "<br>", "<\\br>\n<br>", "</s>\n<s>", "plain", None]
    events = spark.createDataFrame([(1, i, "message", i, r, f"t<br>{i}\n") for i, r in enumerate(roles)], "conv_id long, seq int, event string, message_id long, role string, text string")
    formatted = chat.format_conversations(events)
    turns = chat.read_back(formatted).first().turns
    assert [t.role for t in turns] == [r or "" for r in roles]
    assert [t.text for t in turns] == [f"t<br>{i}\n" for i in range(len(roles))]
