"""Unigram pieces: best segmentation on a double-array trie, and its inverse.

The best path is found for all distinct words of a batch at once: step i
extends every word from its byte i, so one numpy call serves all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import Numbers, give_back, id_and_text, in_parts, text_bytes

MARK = "▁"
#: Stands for a marker in the text itself; no decoded text holds a lone high surrogate.
LITERAL = "\ud800"
#: Words whose pieces a Python worker remembers, and bytes of text that it cuts at once.
REMEMBERED = 150_000
PART = 2_000_000

_SLOW = re.compile(f"{MARK}|\n| *[^ \n{MARK}]+| +")


@dataclass(frozen=True)
class DoubleArray:
    """Trie over bytes: from state s byte b leads to base[s] + b, if check there is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: Iterable[tuple[bytes, int]]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys:
            node = 0
            for byte in key:
                step = children[node].get(byte)
                if step is None:
                    step = children[node][byte] = len(children)
                    children.append({})
                    values.append(-1)
                node = step
            values[node] = value
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        place = [0] * len(children)
        value[0] = values[0]
        floor = 1
        for node, down in enumerate(children):  # a parent comes before its children
            if not down:
                continue
            codes = sorted(down)
            while taken[floor]:
                floor += 1
            at, tries = max(1, floor - codes[0]), 0
            while any(taken[at + c] for c in codes):
                at += 1
                tries += 1
            if tries > 64:  # the crowded front is not searched again
                floor += 32
            if at + 512 > size:
                grow = size
                base, check, value = (np.r_[x, np.full(grow, f, np.int32)] for x, f in ((base, 0), (check, -1), (value, -1)))
                taken.extend(bytes(grow))
                size += grow
            base[place[node]] = at
            for c in codes:
                taken[at + c] = 1
                check[at + c] = place[node]
                value[at + c] = values[down[c]]
                place[down[c]] = at + c
        return cls(base, check, value)

    def get(self, key: bytes) -> int:
        state = 0
        for byte in key:
            to = int(self.base[state]) + byte
            if self.check[to] != state:
                return -1
            state = to
        return int(self.value[state])


@dataclass
class Pieces:
    """A vocabulary of pieces with log scores and one piece per byte."""

    trie: DoubleArray
    score: np.ndarray
    byte_id: np.ndarray
    unknown: float
    #: Bytes of each piece as text: markers are spaces, control pieces nothing.
    out: np.ndarray
    out_start: np.ndarray
    marked_inside: bool
    with_newline: bool
    known: Numbers = field(default_factory=Numbers, repr=False)
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a model file with byte pieces; scores are taken as they stand there."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return cls.of(
            [
                (model.id_to_piece(i), model.get_score(i), "byte" if model.is_byte(i) else "none" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "text")
                for i in range(model.get_piece_size())
            ]
        )

    @classmethod
    def of(cls, pieces: list[tuple[str, float, str]]) -> Pieces:
        """From (piece, score, kind) in the order of ids; kind is text, byte or none."""
        texts = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind == "text" and p]
        byte_id = np.full(256, -1, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                byte_id[int(p[3:5], 16)] = i
        if (byte_id < 0).any():
            raise ValueError("the vocabulary needs a piece for each byte")
        score = np.array([s for _, s, _ in pieces], np.float64)
        plain = [p.replace(MARK, " ").encode() if kind == "text" else bytes([int(p[3:5], 16)]) if kind == "byte" else b"" for p, _, kind in pieces]
        return cls(
            trie=DoubleArray.build((p.encode(), i) for p, i in texts),
            score=score,
            byte_id=byte_id,
            # A character outside the vocabulary costs more than any piece.
            unknown=float(min(score[i] for _, i in texts)) - 10,
            out=np.frombuffer(b"".join(plain), np.uint8),
            out_start=np.cumsum([0, *map(len, plain)]),
            marked_inside=any(MARK in p.lstrip(MARK) for p, _ in texts),
            with_newline=any("\n" in p for p, _ in texts),
        )

    # Cutting a text where no piece can reach across.

    def cut(self, text: str) -> list[str]:
        """Words of ``text`` as keys of ``known``; spaces are markers, a marker in the text is ``LITERAL``."""
        if not text:
            return []
        if self.marked_inside or self.with_newline:
            return [LITERAL if part == MARK else part.replace(" ", MARK) for part in re.split(f"({MARK})", " " + text) if part]
        if "  " in text or MARK in text:
            return [LITERAL if part == MARK else part.replace(" ", MARK) for part in _SLOW.findall(" " + text)]
        words: list[str] = []
        for line in (" " + text).split("\n") if text[0] != " " else ("  " + text[1:]).split("\n"):
            if words:
                words.append("\n")
            head, *rest = line.split(" ")
            if head:
                words.append(head)
            words += [MARK + w for w in rest]
        return words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= PART):
                size += len(texts[to])
                to += 1
            cuts = [self.cut(t) for t in texts[at:to]]
            if len(self.known) > REMEMBERED:
                self.forget()
            seen = list(chain.from_iterable(cuts))
            words = np.fromiter(map(self.known.__getitem__, seen), np.int32, len(seen))
            missing = np.flatnonzero(words < 0).tolist()
            if missing:
                self.learn(list({seen[i] for i in missing}))
                words[missing] = [self.known[seen[i]] for i in missing]
            n = self.sizes[words]
            index = np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum(), dtype=np.int32)
            ids = self.flat[index]
            ends = np.r_[0, np.cumsum(n)][np.cumsum([0, *map(len, cuts)])]
            out += [ids[i:j] for i, j in zip(ends[:-1], ends[1:])]
            at = to
        return out

    def forget(self) -> None:
        self.known.clear()
        self.flat, self.starts, self.sizes = (np.zeros(0, np.int32) for _ in range(3))

    def learn(self, words: list[str]) -> None:
        """Remember the best pieces of new words."""
        words.sort(key=len, reverse=True)
        flat, sizes = self.best(words)
        if LITERAL in words:
            at = words.index(LITERAL)
            flat, sizes = np.insert(flat, sizes[:at].sum(), self.byte_id[list(MARK.encode())]), sizes.copy()
            sizes[at] = 3
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        starts = len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes
        self.flat = np.concatenate([self.flat, flat])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has.

        They are the path with the highest sum of scores; of equal sums the one
        whose last piece begins first.
        """
        raw = [b"" if w == LITERAL else w.encode("utf-8", "surrogateescape") for w in words]
        n_bytes = np.fromiter(map(len, raw), np.int32, len(raw))
        order = np.argsort(-n_bytes, kind="stable")
        size = n_bytes[order]
        text = np.frombuffer(b"".join(raw[i] for i in order), np.uint8).astype(np.int32)
        start = np.cumsum(size, dtype=np.int32) - size
        node = start + np.arange(len(size), dtype=np.int32)  # a word has a node more than bytes
        best = np.full(len(text) + len(size), -np.inf)
        best[node] = 0
        came = np.zeros(len(best), np.int32)  # the piece that ends here, or -1 for an unknown character
        back = np.zeros(len(best), np.int32)  # its bytes
        width = np.ones(256, np.int32)
        width[0xC2:0xE0], width[0xE0:0xF0], width[0xF0:0xF5] = 2, 3, 4
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))  # words that have a byte i
            live = np.flatnonzero(best[node[:n] + i] > -np.inf)
            here, left, at_node, at_text = best[node[live] + i], size[live] - i, node[live] + i, start[live] + i
            reach = np.minimum(width[text[at_text]], left)
            single = np.zeros(len(live), bool)
            at, state = np.arange(len(live)), np.zeros(len(live), np.int32)
            spot, rest = at_text, left
            k = 0
            while len(at):
                to = base[state] + text[spot]
                ok = np.flatnonzero(check[to] == state)
                at, state, spot, rest = at[ok], to[ok], spot[ok], rest[ok]
                k += 1
                piece = value[state]
                ends = np.flatnonzero(piece >= 0)
                if len(ends):
                    w, p = at[ends], piece[ends]
                    if k <= 4:
                        single[w[reach[w] == k]] = True
                    total, end = here[w] + score[p], at_node[w] + k
                    better = np.flatnonzero(total > best[end])
                    end = end[better]
                    best[end], came[end], back[end] = total[better], p[better], k
                more = np.flatnonzero(rest > k)
                if len(more) < len(at):
                    at, state, spot, rest = at[more], state[more], spot[more], rest[more]
                spot = spot + 1
            w = np.flatnonzero(~single)
            if len(w):
                total, end = here[w] + self.unknown, at_node[w] + reach[w]
                better = total > best[end]
                w, end = w[better], end[better]
                best[end], came[end], back[end] = total[better], -1, reach[w]
        # Back from the ends, one piece of every word at a time; an unknown
        # character gives one id for each of its bytes.
        word, at = np.arange(len(size)), node + size
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            go = np.flatnonzero(at > node[word])
            word, at = word[go], at[go]
            steps.append((word, at, came[at]))
            at = at - back[at]
        who, end, piece = (np.concatenate([s[i] for s in steps]) for i in range(3)) if steps else (np.zeros(0, np.int32),) * 3
        lost = np.flatnonzero(piece < 0)
        if len(lost):
            n = back[end[lost]]
            who = np.r_[np.delete(who, lost), np.repeat(who[lost], n)]
            byte_end = np.repeat(end[lost] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            byte = text[byte_end - 1 - who[len(who) - len(byte_end) :]]
            end = np.r_[np.delete(end, lost), byte_end]
            piece = np.r_[np.delete(piece, lost), self.byte_id[byte]]
        mine = order[who]
        sort = np.lexsort((end, mine))
        ids, sizes = piece[sort].astype(np.int32), np.bincount(mine, minlength=len(raw)).astype(np.int32)
        return ids, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space that encoding puts in front."""
        n = (self.out_start[1:] - self.out_start[:-1])[ids]
        index = np.repeat(self.out_start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.out[index].tobytes()[1:]


def share_pieces(docs: DataFrame, path: str) -> Broadcast:
    """The vocabulary for the tasks; its size hangs on the file and not on the data."""
    return docs.sparkSession.sparkContext.broadcast(Pieces.load(path))


def encode(docs: DataFrame, pieces: Broadcast) -> DataFrame:
    """(doc_id, ids): the best pieces of each whole text.

    An absent or empty text has no ids. Each input row gives one row, repeated
    rows and absent ids too; other columns are not read. A marker that stands
    in the text itself is written as bytes, and so is all that no piece covers,
    so that decoding gives back every text, byte for byte.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = own.encode([b.decode("utf-8", "surrogateescape") for b in text_bytes(batch.column(1))])
                starts = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(starts, pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])
        give_back()

    return id_and_text(docs).mapInArrow(of, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, pieces: Broadcast) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids); absent or no ids give the empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.value
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [own.decode(flat[a:b]) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], there)]
            plain = pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, plain], names=["doc_id", "ids", "text"])
        give_back()

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(of, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, pieces: Broadcast) -> DataFrame:
    """(doc_id, ids, text) of whole texts, as ``decode`` of ``encode`` gives them, by one Python worker a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.value
        for batch in in_parts(batches):
            found = own.encode([b.decode("utf-8", "surrogateescape") for b in text_bytes(batch.column(1))])
            starts = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(starts, pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
            plain = pa.array([own.decode(x).decode("utf-8", "replace") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, plain], names=["doc_id", "ids", "text"])
        give_back()

    return id_and_text(docs).mapInArrow(of, "doc_id long, ids array<int>, text string")


def digests(encoded: DataFrame, pieces: Broadcast) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256) of encoded texts, read from their ids alone."""
    import hashlib
    import zlib

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.value
        is_byte = np.zeros(len(own.score), bool)
        is_byte[own.byte_id] = True
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy().astype("<u4", copy=False), lists.offsets.to_numpy()
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([int(is_byte[x].sum()) for x in rows], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in rows]),
                ],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256"],
            )
        give_back()

    return encoded.mapInArrow(of, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string")
