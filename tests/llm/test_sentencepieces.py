"""Pieces: the best path against all paths, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waveline.llm.sentencepieces import MARK, DoubleArray, Pieces, decode, digests, encode, encode_and_decode, share_pieces

BYTES = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]


def small() -> Pieces:
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(40)} | {"a", MARK, MARK + "a", MARK + "ab", MARK * 2, "日"})
    return Pieces.of([("<unk>", 0.0, "none"), ("<s>", 0.0, "none"), *BYTES, *((t, -rng.random() * 9 - 0.01, "text") for t in texts)])


def best_score(own: Pieces, word: str) -> float:
    """By trying every piece in front of the best rest."""
    known = {k: s for k, s in own.pieces_for_test}
    best = {len(word): 0.0}
    for i in range(len(word) - 1, -1, -1):
        options = [known[word[i:j]] + best[j] for j in range(i + 1, len(word) + 1) if word[i:j] in known]
        if word[i] not in known:
            options.append(own.unknown + best[i + 1])
        best[i] = max(options)
    return best[0]


def test_best_path_is_the_best_of_all():
    rng = random.Random(1)
    texts = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 5))) for _ in range(40)} | {"a", MARK, MARK + "a", MARK + "ab", MARK * 2, "日"})
    scores = [(t, -rng.random() * 9 - 0.01) for t in texts]
    own = Pieces.of([*BYTES, *((t, s, "text") for t, s in scores)])
    own.pieces_for_test = scores
    words = ["".join(rng.choice("abéc日") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for word in words:
        ids, sizes = own.best([MARK + word])
        total, i = 0.0, 0
        while i < len(ids):
            if ids[i] >= 256:
                total, i = total + own.score[ids[i]], i + 1
            else:  # the bytes of a character without a piece
                lead = int(ids[i])
                total, i = total + own.unknown, i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3)
        assert sizes.tolist() == [len(ids)]
        assert total == pytest.approx(best_score(own, MARK + word))


def test_double_array_finds_its_keys_and_no_others():
    rng = random.Random(3)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 6))): i for i in range(500)}
    keys = dict.fromkeys(keys)
    numbered = [(k, i) for i, k in enumerate(keys)]
    trie = DoubleArray.build(numbered)
    assert all(trie.get(k) == i for k, i in numbered)
    others = [bytes(rng.randrange(256) for _ in range(3)) for _ in range(500)]
    assert all(trie.get(k) == -1 for k in others if k not in keys)


OWN = small()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tabé日🎉") + [MARK, "\0"]), max_size=25), max_size=4))
def test_round_trip(texts):
    assert [OWN.decode(x).decode() if len(x) else "" for x in OWN.encode(texts)] == texts


def test_texts_as_a_whole_and_word_by_word_agree():
    own = small()
    apart = own.encode(["ab a é b", "ab a"])
    own.marked_inside = True  # no cuts then
    own.forget()
    assert [x.tolist() for x in own.encode(["ab a é b", "ab a"])] == [x.tolist() for x in apart]


def test_frames(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = [(1, "hello  world\n" + MARK), (2, ""), (3, None), (1, "hello  world\n" + MARK), (None, "x" * 10_000 + " word" * 20_000)]
    docs = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    pieces = share_pieces(docs, str(public.path("piece_bpe_32k.model")))
    encoded = encode(docs, pieces)
    assert sorted(map(str, ((r.doc_id, r.text) for r in decode(encoded, pieces).collect()))) == sorted(map(str, ((d, t or "") for d, t in rows)))
    both = sorted(map(str, encode_and_decode(docs, pieces).collect()))
    assert both == sorted(map(str, decode(encoded, pieces).collect()))
    assert {r.decoded_sha256 for r in digests(encoded, pieces).collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert encode(docs.limit(0), pieces).count() == 0
