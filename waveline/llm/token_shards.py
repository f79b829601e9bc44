"""Token ids as shards with a perfect-hash index from document keys.

A file holds shards in ascending order of doc_id. Each has the raw ids of its
documents, the offsets of the documents in it, and an index: a minimal perfect
hash of the keys whose slots hold a fingerprint of the key and the place of its
first document. A key is found in constant time, without its neighbours.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waveline.llm.common import Numbers, crc32, id_and_text, text_bytes
from waveline.llm.perfect_hash import PerfectHash, fingerprint

#: Ids of a shard, about; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Words whose ids a Python worker remembers, and bytes of text that it cuts at once.
REMEMBERED = 600_000
PART = 8_000_000
#: Where a document has no id.
NO_KEY = -(1 << 63)

SHARD = "part int, seq int, first_key long, last_key long, n_docs long, n_ids long, before long, width int, keys binary, offsets binary, hash binary, slots binary, ids binary"

_CLEAN = re.compile(r" ?\S+")
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes that surely begin a character other than white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), 0xC3, *range(0xC4, 0xE1), *range(0xE4, 0xF5)]] = True


class WordEncoder:
    """Ids of byte-level BPE texts, word by word.

    The splitting pattern of this kind of vocabulary never joins a character to
    white space behind it, and a blank or line break before a visible character
    always begins a new piece. So a text can be cut there, on its bytes and for
    many texts at once, and each distinct word is encoded once.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Names of added tokens in a text are those tokens; the text between them is split on its own.
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("this vocabulary has added tokens that reach beyond their names")
        self.names = frozenset(t.content.encode() for t in added)
        longest_first = sorted(self.names, key=len, reverse=True)
        self.name = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self.newline = self._plain(["\n"])[0][0]
        self.known = Numbers()
        self.flat, self.starts, self.sizes = (np.zeros(0, np.int32) for _ in range(3))
        self.used = np.zeros(0, np.int64)

    @property
    def width(self) -> int:
        """Bytes of an id in a shard."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def cuts(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Where words begin in texts that lie one behind the other and begin at ``starts``."""
        raw = np.frombuffer(data, np.uint8)
        begins = np.zeros(len(raw) + 1, bool)
        begins[starts] = True
        at = np.flatnonzero((raw[:-1] == 32) | (raw[:-1] == 10))
        # White space at the end of a text is one piece, whatever the next text begins with.
        at = at[_VISIBLE[raw[at + 1]] & ~begins[at + 1]]
        words = begins.copy()
        words[at] = True
        words[at[raw[at] == 10] + 1] = True
        for found in self.name.finditer(data) if self.name else ():
            i, j = found.span()
            if begins[i + 1 : j].any():
                continue
            # So is white space before the name of an added token.
            words[max(i - 1, 0) : j] = begins[max(i - 1, 0) : j]
            words[[i, j]] = True
        return np.flatnonzero(words[:-1])

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words; signs behind a letter are pieces of their own."""
        tails = {}
        for w in words:
            head = w.rstrip(_SIGNS)
            if len(head) < len(w) and head[-1:].isalpha() and w not in self.names:
                tails[w] = head, w[len(head) :]
        whole = set(words) - tails.keys()
        whole.update(part for parts in tails.values() for part in parts)
        self._remember([w for w in whole if w not in self.known])
        pairs = np.array([[self.known[a], self.known[b]] for a, b in tails.values()], np.int64).reshape(-1, 2)
        n = self.sizes[pairs].ravel()
        index = np.repeat(self.starts[pairs].ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self._append(list(tails), self.flat[index], n.reshape(-1, 2).sum(axis=1).astype(np.int32))

    def _remember(self, words: list[bytes]) -> None:
        texts = {w: w.decode("utf-8", "replace") for w in words}
        clean = [w for w, t in texts.items() if w not in self.names and _CLEAN.fullmatch(t)]
        other = list(texts.keys() - set(clean))
        # A line break between two words is always a piece of its own.
        parts = [clean[i : i + 200] for i in range(0, len(clean), 200)]
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for part, found in zip(parts, self._plain(["\n".join(texts[w] for w in p) for p in parts])):
            got = np.array(found, np.int32)
            breaks = np.flatnonzero(got == self.newline)
            if len(breaks) != len(part) - 1:
                raise ValueError("this vocabulary does not keep line breaks apart")
            ids.append(np.delete(got, breaks))
            sizes.append(np.diff(np.r_[-1, breaks, len(got)]).astype(np.int32) - 1)
        for found in self._plain([texts[w] for w in other]):
            ids.append(np.array(found, np.int32))
            sizes.append(np.array([len(found)], np.int32))
        self._append(clean + other, np.concatenate(ids), np.concatenate(sizes))

    def _append(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])

    def forget(self, times: int = 1 << 62) -> None:
        """Forget words that were used fewer times, and of many others those used least."""
        keep = self.used >= times
        if 2 * keep.sum() > REMEMBERED:
            keep = self.used > np.partition(self.used, -(REMEMBERED // 2))[-(REMEMBERED // 2)]
        n = self.sizes[keep]
        index = np.repeat(self.starts[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        words = [w for w, k in zip(self.known, keep.tolist()) if k]
        self.known, self.flat = Numbers(zip(words, range(len(words)))), self.flat[index]
        self.starts, self.sizes, self.used = np.cumsum(n, dtype=np.int32) - n, n, self.used[keep] // 2

    def encode(self, texts: Sequence[str | bytes], end: int) -> Iterator[np.ndarray]:
        """Ids of each text, ``end`` behind them."""
        raw = [t.encode() if isinstance(t, str) else t for t in texts]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= PART):
                size += len(raw[to])
                to += 1
            yield from self._encode(raw[at:to], end)
            at = to

    def _encode(self, raw: list[bytes], end: int) -> Iterator[np.ndarray]:
        data, borders = b"".join(raw), np.cumsum([0, *map(len, raw)])
        cuts = self.cuts(data, borders)
        offsets = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget(times=3)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            self.learn([distinct[i] for i in missing])
            numbers[missing] = [self.known[distinct[i]] for i in missing]
        self.used[numbers] += np.bincount(codes, minlength=len(distinct))
        n = self.sizes[numbers][codes]
        ends = np.r_[0, np.cumsum(n)]
        ids = self.flat[np.repeat(self.starts[numbers][codes] - ends[:-1], n) + np.arange(ends[-1])]
        places = ends[np.searchsorted(cuts, borders)]
        for i, j in zip(places[:-1], places[1:]):
            yield np.append(ids[i:j], np.int32(end))


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _shard(part: int, seq: int, before: int, width: int, keys: list[int], ids: list[np.ndarray]) -> dict:
    keys_ = np.array(keys, np.int64)
    offsets = np.cumsum([0, *map(len, ids)])
    distinct, first, run = np.unique(keys_, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), [("mark", "<u4"), ("doc", "<u4"), ("docs", "<u4")])
    at = index.slots(distinct)
    slots["mark"][at], slots["doc"][at], slots["docs"][at] = fingerprint(distinct), first, run
    return {
        "part": part, "seq": seq, "first_key": keys[0], "last_key": keys[-1], "n_docs": len(keys),
        "n_ids": int(offsets[-1]), "before": before, "width": width, "keys": keys_.astype("<i8").tobytes(),
        "offsets": offsets.astype("<i8").tobytes(), "hash": index.to_bytes(), "slots": slots.tobytes(),
        "ids": np.concatenate(ids).astype(f"<u{width}").tobytes(),
    }


_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), *((c, pa.int64()) for c in ("first_key", "last_key", "n_docs", "n_ids", "before")),
     ("width", pa.int32()), *((c, pa.binary()) for c in ("keys", "offsets", "hash", "slots", "ids"))]
)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts and write them as shards, in ascending order of doc_id.

    An absent text is empty; ``end`` follows each document. Documents without
    doc_id come first. Rows that share a doc_id are documents of their own,
    next to each other and ordered by a hash of their text. Other columns are
    not read. An empty table gives an empty file.
    """
    rows = id_and_text(docs).selectExpr(f"coalesce(doc_id, {NO_KEY + 1}L - 1L) as doc_id", "text", "xxhash64(text) as tie")
    # The ids are made behind the only shuffle, so they are never moved.
    order = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _encoder(tokenizer), TaskContext.get().partitionId()
        keys: list[int] = []
        ids: list[np.ndarray] = []
        seq = before = held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                for key, got in zip(batch.column(0).to_pylist(), own.encode(list(text_bytes(batch.column(1))), end)):
                    if held and held + len(got) > shard_ids:
                        yield pa.RecordBatch.from_pylist([_shard(part, seq, before, own.width, keys, ids)], _ARROW)
                        seq, before, held, keys, ids = seq + 1, before + held, 0, [], []
                    keys.append(key)
                    ids.append(got)
                    held += len(got)
        if held:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, before, own.width, keys, ids)], _ARROW)

    order.select("doc_id", "text").mapInArrow(pack, SHARD).write.parquet(path)


def _found(shard: dict, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each document of ``keys`` that the shard's index knows."""
    slots = np.frombuffer(shard["slots"], [("mark", "<u4"), ("doc", "<u4"), ("docs", "<u4")])
    offsets = np.frombuffer(shard["offsets"], "<i8")
    at = PerfectHash.from_bytes(shard["hash"]).slots(keys)
    ok = (at >= 0) & (slots["mark"][at] == fingerprint(keys))
    for key, slot in zip(keys[ok].tolist(), slots[at[ok]]):
        for doc in range(int(slot["doc"]), int(slot["doc"]) + int(slot["docs"])):
            yield key, int(offsets[doc]), int(offsets[doc + 1])


def _documents(shards: DataFrame, wanted: np.ndarray | None, with_ids: bool) -> DataFrame:
    extra = "ids array<int>" if with_ids else "ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.slice(row, 1).to_pylist()[0]
                ids = np.frombuffer(shard["ids"], f"<u{shard['width']}")
                # The keys of a shard are asked of its own index, once each.
                found = list(_found(shard, np.unique(np.frombuffer(shard["keys"], "<i8")) if wanted is None else wanted))
                parts = [ids[a:b].astype("<u4") for _, a, b in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if k == NO_KEY else k for k, _, _ in found], pa.int64()),
                        pa.array([shard["base"] + shard["before"] + a for _, a, _ in found], pa.int64()),
                        pa.array([b - a for _, a, b in found], pa.int64()),
                        pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())) if with_ids else pa.array([crc32(p) for p in parts], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"],
                )

    return shards.mapInArrow(read, f"doc_id long, start long, n_tokens long, {extra}")


def _with_base(shards: DataFrame) -> DataFrame:
    """Each shard with the ids of all parts before its own; a row for each part is all that is broadcast."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return shards.join(F.broadcast(base), "part")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, found through the indexes of their shards."""
    return _documents(_with_base(spark.read.parquet(path)), None, with_ids=False)


def look_up(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a few documents; shards outside their range are not read."""
    near = F.lit(False)
    for key in keys:
        near |= F.lit(key).between(F.col("first_key"), F.col("last_key"))
    return _documents(_with_base(spark.read.parquet(path)).filter(near), np.array(sorted(set(keys)), np.int64), with_ids=True)
