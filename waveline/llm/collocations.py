"""Phrases whose words stand together more often than apart.

Each task counts the phrases of its texts and writes them, sorted, into weighted
automata, one for each language and range of prefixes. Ranges are those of a
hash order of the first and of the second word, so they are even without a look
at the data, and the phrases behind one very common word spread over many. The
automata of a range are united and their counts added. Counts of the parts of a
phrase are looked up by sending the parts to the automaton of their range.

Absent texts are empty, an absent language is ``und``. Repeated rows count each
time. Documents need no id. Texts of any length are read in pieces; phrases
across a cut are counted. Ties of the score go by count, then by the bytes of the
phrase. An empty table, or one without a phrase of the least count, gives no rows.
Further columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from copy import copy
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveline.llm.common import Scratch, give_back, in_parts, text_bytes
from waveline.llm.count_automata import BITS, LONGEST, MASK, MOST_WORDS, CountAutomaton, Level, add, renamed, spelled, summed, united

#: Bytes of text to a range of prefixes, about.
RANGE_BYTES = 4_000_000
#: Phrases that a task holds before it writes them as automata.
HELD = 1_500_000
#: Bytes of text that are taken apart at a time.
STEP = 1_000_000

_BREAK, _NOTHING, _FIRST_WORD = 0, 1, 2
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")
_SHARD = "lang string, cell long, words binary, starts binary, arcs binary"


class _Counts:
    """Phrases of one language, by length."""

    def __init__(self, words: Iterable[bytes] = ()) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        for word in (b"\n", b"", *words):
            self.number[word]
        self.levels: list[list[Level]] = [[] for _ in range(LONGEST)]

    def add(self, text: bytes) -> Iterator[_Counts]:
        """Count the phrases of texts that are parted by line breaks; what is full is handed out and begun anew."""
        text = text.translate(_FOLD)
        at, tail = 0, np.zeros(0, np.int64)
        while at < len(text):
            end = at + STEP
            if end < len(text):
                ends = [x for x in (text.find(b" ", end), text.find(b"\n", end)) if x >= 0]
                end = min(ends, default=len(text))
            tokens = text[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
            ids = np.concatenate([tail, ids[ids != _NOTHING]])
            self._count(ids, len(tail))
            tail, at = ids[-(LONGEST - 1) :], end
            # A step adds fewer words than the half of the numbers that is left.
            if self.size > HELD or len(self.number) > MOST_WORDS // 2:
                known = list(self.number)
                full, words = copy(self), [known[i] for i in tail.tolist()]
                self.__init__(words)
                tail = np.array([self.number[w] for w in words], np.int64)
                yield full

    def _count(self, ids: np.ndarray, known: int) -> None:
        """Count the windows that end behind the first ``known`` words."""
        keys, whole = ids, ids >= _FIRST_WORD
        for i in range(LONGEST):
            if i:
                keys = keys[: len(ids) - i] << BITS | ids[i:]
                whole = whole[: len(ids) - i] & (ids[i:] >= _FIRST_WORD)
            new = max(known - i, 0)
            found, counts = np.unique(keys[new:][whole[new:]], return_counts=True)
            add(self.levels[i], (found, counts))

    @property
    def size(self) -> int:
        return sum(len(keys) for level in self.levels for keys, _ in level)

    def automata(self, a: int, b: int) -> Iterator[tuple[int, CountAutomaton]]:
        """(range, automaton) of all phrases counted so far."""
        names = list(self.number)
        crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
        first, second = (crc * a >> 32) * b, crc * b >> 32
        parts, cells = [], a * b
        for i, level in enumerate(self.levels):
            keys, counts = summed(level)
            cell = first[keys >> BITS * i] + (second[keys >> BITS * (i - 1) & MASK] if i else 0)
            # The phrases stay sorted within a range.
            order = np.argsort(cell.astype(np.uint16) if cells <= 1 << 16 else cell, kind="stable")
            parts.append((np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=cells))]), keys[order], counts[order]))
        local, used_here = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for cell in np.flatnonzero(sum(np.diff(p[0]) for p in parts)).tolist():
            levels = [(keys[at[cell] : at[cell + 1]], counts[at[cell] : at[cell + 1]]) for at, keys, counts in parts]
            for i, (keys, _) in enumerate(levels):
                for j in range(i + 1):
                    used_here[keys >> BITS * j & MASK] = True
            used = np.flatnonzero(used_here)
            used_here[used] = False
            local[used] = np.arange(len(used))
            yield cell, CountAutomaton.build([names[w] for w in used.tolist()], [(renamed(keys, i + 1, local), n) for i, (keys, n) in enumerate(levels)])


def _shards(batches: Iterator[pa.RecordBatch], a: int, b: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Counts] = {}

    def written(lang: str, counts: _Counts) -> Iterator[pa.RecordBatch]:
        for cell, automaton in counts.automata(a, b):
            yield _row([lang, cell, *automaton.to_bytes()], ["lang", "cell", "words", "starts", "arcs"])

    for whole in batches:
        for batch in in_parts([whole]):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                for full in held.setdefault(lang, _Counts()).add(b"\n".join(some)):
                    yield from written(lang, full)
            while sum(c.size for c in held.values()) > HELD:
                lang = max(held, key=lambda x: held[x].size)
                yield from written(lang, held.pop(lang))
    while held:
        yield from written(*held.popitem())
    give_back()


def _row(values: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else None) for v in values], names=names)


def _automata(table: pa.Table | pa.RecordBatch) -> Iterator[CountAutomaton]:
    for words, starts, arcs in zip(*(table.column(c) for c in ("words", "starts", "arcs")), strict=True):
        yield CountAutomaton.from_bytes(words.as_py(), starts.as_py(), arcs.as_py())


def _unite(shards: pa.Table, least: int) -> pa.Table:
    """One automaton of the phrases of the least count; all words are in ``total``."""
    words, levels = united(_automata(shards))
    total = int(levels[0][1].sum())
    kept = [(keys[counts >= least], counts[counts >= least]) for keys, counts in levels]
    automaton = CountAutomaton.build(words, kept)
    row = [shards.column("lang")[0].as_py(), shards.column("cell")[0].as_py(), total, *automaton.to_bytes()]
    give_back()
    return pa.Table.from_batches([_row(row, ["lang", "cell", "total", "words", "starts", "arcs"])])


def _phrases(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, automaton in zip(batch.column("lang").to_pylist(), _automata(batch), strict=True):
            for i, (keys, counts) in enumerate(automaton.levels()):
                if i + 1 < shortest or not len(keys):
                    continue
                text = pa.array(spelled(automaton.words, keys, i + 1), pa.binary()).cast(pa.string())
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n), text, pa.array(np.full(n, i + 1, np.int32)), pa.array(counts)], names=["lang", "phrase", "size", "a"])


def _look_up(asked: pa.Table, automata: pa.Table) -> pa.Table:
    """Compose the parts that were sent to a range with its automaton."""
    parts = asked.column("part")
    found = np.zeros(len(parts), np.int64)
    phrases = [p.encode().split(b" ") for p in parts.to_pylist()]
    for automaton in _automata(automata):
        found += automaton.weights(phrases)
    return pa.table({"lang": asked.column("lang"), "part": parts, "f": pa.array(found)})


def _cell(words: Column, a: int, b: int) -> Column:
    """Range of a phrase, as tasks compute it."""
    def part(i: int, n: int) -> Column:
        return F.shiftright(F.crc32(F.element_at(words, i).cast("binary")) * n, 32)

    return part(1, a) * b + F.when(F.size(words) > 1, part(2, b)).otherwise(F.lit(0).cast("long"))


def collocations(docs: DataFrame, least: int, top: int, covered: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    ``a`` counts a phrase of two or three words; cut into two parts with counts
    ``l`` and ``r`` it scores floor(10^6 a^2 / (l r)), and the cut of the lowest
    score counts. Phrases of fewer than ``least`` occurrences are left out, and so
    are those of which at least ``covered`` percent stand inside one longer phrase.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    a = b = math.ceil(math.sqrt(max(size / RANGE_BYTES, 1)))
    shards = texts.mapInArrow(partial(_shards, a=a, b=b), _SHARD)
    whole = scratch.put(shards.groupBy("lang", "cell").applyInArrow(lambda t: _unite(t, least), "lang string, cell long, total long, words binary, starts binary, arcs binary"))
    n = whole.groupBy("lang").agg(F.sum("total").alias("n"))
    found = scratch.put(whole.select("lang", "words", "starts", "arcs").mapInArrow(partial(_phrases, shortest=2), "lang string, phrase string, size int, a long"))

    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("first"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size"))).alias("rest"))
    parts = cuts.select("lang", F.explode(F.array("first", "rest")).alias("part")).distinct()
    asked = parts.withColumn("cell", _cell(F.split("part", " "), a, b))
    looked = asked.groupBy("lang", "cell").cogroup(whole.select("lang", "cell", "words", "starts", "arcs").groupBy("lang", "cell"))
    known = scratch.put(looked.applyInArrow(lambda x, y: _look_up(x, y), "lang string, part string, f long"))

    left, right = (known.select("lang", F.col("part").alias(p), F.col("f").alias(c)) for p, c in (("first", "l"), ("rest", "r")))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    score = F.call_function("div", (F.lit(1_000_000).cast("decimal(7,0)") * (wide["a"] * wide["a"]).cast("decimal(31,0)")).cast("decimal(38,0)"), (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))

    longer = found.filter("size > 2").select("lang", F.col("a").alias("longer"), words.alias("w"), "size")
    inner = longer.select("lang", "longer", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"), "size")
    inner = inner.select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", "longer", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("m"))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    # One row a language on the side that is sent around.
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", F.col("x.score").cast("long").alias("score"))
