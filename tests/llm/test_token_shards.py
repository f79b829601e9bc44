"""Token shards: ids against the tokenizer itself, places, and the perfect hash."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from waveline.llm.perfect_hash import PerfectHash, fingerprint
from waveline.llm.token_shards import NO_KEY, WordEncoder, look_up, read_shards, write_shards

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def plain():
    own = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: own.encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_numbers_its_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n))
    index = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert (PerfectHash.build(np.arange(n)).slots(np.arange(n, 2 * n)) < max(n, 1)).all()
    assert len(np.unique(fingerprint(keys))) >= 0.99 * len(keys)


def test_words_are_encoded_as_texts_are(plain):
    rng = random.Random(2)
    signs = " \n\t   aé'sß日​\x1c1!\r.,_"
    own = WordEncoder(PATH)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(16))) for _ in range(1500)]
    name = "<|endoftext|>"
    texts += [f"{name} x", name, name * 2, f"a {name}", f"a{name}b", f"  {name}  \n{name}\n", f"x.{name}!", f"{name[:-1]} {name} {name[1:]}", f" {name}"]
    texts += [ "don't DON'T we'll", "a" * 5000, "word " * 5000]
    assert [x.tolist() for x in own.encode(texts, 0)] == [plain(x) for x in texts]
    own.forget(times=2)
    assert [x.tolist() for x in own.encode(texts[:50], 0)] == [plain(x) for x in texts[:50]]


def test_files_give_back_places_and_ids(spark, tmp_path, plain):
    rows = [(7, "one two"), (3, None), (5, ""), (None, "no id"), (9, "nine " * 4000), (9, "again"), (9, "again"), (-4, "minus")]
    docs = spark.createDataFrame([(*r, b"z") for r in rows], "doc_id long, text string, ids binary")
    path = str(tmp_path / "shards")
    write_shards(docs, path, PATH, end=0, shard_ids=50)
    found = read_shards(spark, path).collect()
    assert len(found) == len(rows)
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, -4, 3, 5, 7, 9, 9, 9]
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    want = sorted((d is not None, d or 0, len(plain(t or "")), zlib.crc32(np.array(plain(t or ""), "<u4").tobytes())) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == want
    one = look_up(spark, path, [5, 7, 8]).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in one} == {(5, (0,)), (7, tuple(plain("one two")))}
    assert NO_KEY < -(2**62)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_shards(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_shards(spark, path).count() == 0
