"""Weighted acyclic automata over word sequences.

An automaton maps phrases of up to ``LONGEST`` words to counts. Its arcs carry a
word, the count of the phrase that ends there (0: no phrase ends there) and the
next state. It is built from sorted phrases: the arcs behind a prefix are
complete as soon as the next prefix begins, and a state with the same arcs as an
earlier one is that state. Phrases are integers inside: ``BITS`` bits a word,
the first word highest, so their order is that of the words, whichever that is
(tasks number words as they come).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

LONGEST, BITS = 3, 21
MASK = (1 << BITS) - 1
#: Words of one automaton at most.
MOST_WORDS = 1 << BITS
ARC = np.dtype([("word", "<i4"), ("next", "<i4"), ("weight", "<i8")])

#: Sorted distinct phrases of one length and their counts.
Level = tuple[np.ndarray, np.ndarray]


def summed(parts: Iterable[Level]) -> Level:
    """One sorted level of the sum of several."""
    none = np.zeros(0, np.int64)
    parts = [(none, none), *parts]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def add(runs: list[Level], run: Level) -> None:
    """Append a run and merge runs of like size, so that a phrase is sorted again a few times only."""
    runs.append(run)
    while len(runs) > 1 and len(runs[-2][0]) < 2 * len(runs[-1][0]):
        runs[-2:] = [summed(runs[-2:])]


def renamed(keys: np.ndarray, words: int, names: np.ndarray) -> np.ndarray:
    """Phrases of ``words`` words under other numbers of the words."""
    out = np.zeros(len(keys), np.int64)
    for i in reversed(range(words)):
        out = out << BITS | names[keys >> BITS * i & MASK]
    return out


def _frozen(known: dict[bytes, int], arcs: np.ndarray, first: np.ndarray, whole: bytes, words: int) -> np.ndarray:
    """The state of each run of arcs, in order; a run that is known already is that state."""
    ends = np.append(first[1:], len(arcs))
    states = np.zeros(len(first), np.int32)
    # Most runs are one arc of count 1 to the end: such states are known by their word.
    plain = (ends - first == 1) & (arcs["weight"][first] == 1) & (arcs["next"][first] == 0) if len(first) else np.zeros(0, bool)
    by_word = np.full(words, -1, np.int32)
    by_word[arcs["word"][first[plain]]] = 0
    of_word = np.flatnonzero(by_word == 0)
    alone = np.zeros(len(of_word), ARC)
    alone["word"], alone["weight"] = of_word, 1
    # setdefault sees the number of states before it adds one.
    by_word[of_word] = [known.setdefault(a, len(known)) for a in _split(alone.tobytes(), range(0, (len(of_word) + 1) * ARC.itemsize, ARC.itemsize))]
    states[plain] = by_word[arcs["word"][first[plain]]]
    other = np.flatnonzero(~plain)
    cuts = zip((first[other] * ARC.itemsize).tolist(), (ends[other] * ARC.itemsize).tolist(), strict=True)
    states[other] = [known.setdefault(whole[a:b], len(known)) for a, b in cuts]
    return states


def _split(data: bytes, cuts: Sequence[int]) -> Iterable[bytes]:
    return (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


@dataclass(frozen=True)
class CountAutomaton:
    """States from 1 on are runs of arcs; state 0 has none. The last state is the root."""

    words: list[bytes]
    starts: np.ndarray
    arcs: np.ndarray

    @classmethod
    def build(cls, words: Sequence[bytes], levels: Sequence[Level]) -> CountAutomaton:
        """From words in any fixed order and the phrases of 1, 2, ... of them, sorted in that order."""
        known: dict[bytes, int] = {b"": 0}
        keys, weights = levels[-1]
        targets = np.zeros(len(keys), np.int32)
        for length in reversed(range(len(levels))):
            arcs = np.empty(len(keys), ARC)
            arcs["word"], arcs["next"], arcs["weight"] = keys & MASK, targets, weights
            whole = arcs.tobytes()
            if not length:
                break
            above = keys >> BITS
            first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(above) else np.zeros(0, np.int64)
            states = _frozen(known, arcs, first, whole, len(words))
            prefixes, (keys, weights) = above[first], levels[length - 1]
            at = np.searchsorted(keys, prefixes)
            if not np.array_equal(keys[np.minimum(at, max(len(keys) - 1, 0))] if len(keys) else keys, prefixes):
                known_keys, known_weights = keys, weights
                keys = np.union1d(prefixes, known_keys)
                weights = np.zeros(len(keys), np.int64)
                weights[np.searchsorted(keys, known_keys)] = known_weights
                at = np.searchsorted(keys, prefixes)
            targets = np.zeros(len(keys), np.int32)
            targets[at] = states
        frozen = [*known, whole]
        sizes = np.fromiter(map(len, frozen), np.int64, len(frozen)) // ARC.itemsize
        return cls(list(words), np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(frozen), ARC))

    @property
    def root(self) -> int:
        return len(self.starts) - 2

    def levels(self) -> list[Level]:
        """All phrases with a count, by length."""
        out, keys, states = [], np.zeros(1, np.int64), np.array([self.root])
        for _ in range(LONGEST):
            sizes = self.starts[states + 1] - self.starts[states]
            at = np.repeat(self.starts[states] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            arcs = self.arcs[at]
            keys = np.repeat(keys, sizes) << BITS | arcs["word"]
            ends = arcs["weight"] > 0
            out.append((keys[ends], arcs["weight"][ends]))
            keys, states = keys[arcs["next"] > 0], arcs["next"][arcs["next"] > 0].astype(np.int64)
        return out

    def weights(self, phrases: Sequence[Sequence[bytes]]) -> np.ndarray:
        """Counts of phrases, 0 where there is none: all step through the automaton together."""
        number = {w: i for i, w in enumerate(self.words)}
        owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)) << BITS | self.arcs["word"]
        state, found = np.full(len(phrases), self.root), np.zeros(len(phrases), np.int64)
        length = np.fromiter(map(len, phrases), np.int64, len(phrases))
        for i in range(LONGEST):
            word = np.fromiter((number.get(p[i], -1) if len(p) > i else -1 for p in phrases), np.int64, len(phrases))
            at = np.minimum(np.searchsorted(owner, state << BITS | np.maximum(word, 0)), max(len(owner) - 1, 0))
            met = (word >= 0) & (owner[at] == (state << BITS | np.maximum(word, 0))) if len(owner) else np.zeros(len(phrases), bool)
            found[met & (length == i + 1)] = self.arcs["weight"][at[met & (length == i + 1)]]
            state = np.where(met, self.arcs["next"][at].astype(np.int64), 0) if len(owner) else state
        return found

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return b"\n".join(self.words), self.starts.astype("<i8").tobytes(), self.arcs.tobytes()

    @classmethod
    def from_bytes(cls, words: bytes, starts: bytes, arcs: bytes) -> CountAutomaton:
        return cls(words.split(b"\n") if words else [], np.frombuffer(starts, "<i8"), np.frombuffer(arcs, ARC))


def united(automata: Iterable[CountAutomaton]) -> tuple[list[bytes], list[Level]]:
    """Words and phrases of all automata, counts of equal phrases added; one automaton is open at a time."""
    number: dict[bytes, int] = {}
    held: list[list[Level]] = [[] for _ in range(LONGEST)]
    for automaton in automata:
        names = np.fromiter((number.setdefault(w, len(number)) for w in automaton.words), np.int64, len(automaton.words))
        for i, (keys, counts) in enumerate(automaton.levels()):
            add(held[i], (renamed(keys, i + 1, names), counts))
    return list(number), [summed(h) for h in held]


def spelled(words: Sequence[bytes], keys: np.ndarray, length: int) -> list[bytes]:
    """Phrases as text, words joined by blanks."""
    columns = [[words[w] for w in (keys >> BITS * i & MASK).tolist()] for i in reversed(range(length))]
    return list(map(b" ".join, zip(*columns, strict=True)))
