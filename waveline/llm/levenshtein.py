"""Levenshtein automata met with a trie of terms, as one table of states.

A state is the set of trie places that a misspelled beginning may stand for,
each with the edits that it took. The sets are numbered once, for the whole
lexicon; after that a word costs one table look-up a letter, and all words of
a batch take their steps together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: What a word is, from the surest down: 0 is none.
EXACT_WORD, EXACT_STEM, NEAR_WORD, NEAR_STEM = 1, 2, 3, 4
#: Letters from which a term may be misspelled.
NEAR_WORD_LETTERS, NEAR_STEM_LETTERS = 5, 6


@dataclass(frozen=True)
class Term:
    """A whole word, or the beginning of words."""

    text: str
    stem: bool


@dataclass(frozen=True)
class LexiconAutomaton:
    """``step[state, class]`` is the next state, 0 where nothing can follow; state 1 begins."""

    letters: np.ndarray  # code points that have a class of their own, sorted
    step: np.ndarray
    kind: np.ndarray

    @classmethod
    def build(cls, terms: list[Term], edits: int = 1) -> LexiconAutomaton:
        down: list[dict[str, int]] = [{}]
        ends: list[dict[bool, int]] = [{}]  # of a node: stem or word, and its letters
        for term in terms:
            node = 0
            for c in term.text:
                if c not in down[node]:
                    down[node][c] = len(down)
                    down.append({})
                    ends.append({})
                node = down[node][c]
            ends[node][term.stem] = len(term.text)
        letters = sorted({c for term in terms for c in term.text})

        def closed(places: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With letters left out, and with stems that are complete, as node -1."""
            todo = list(places)
            while todo:
                node, used = todo.pop()
                if node < 0:
                    continue
                more = [(-1, used)] if True in ends[node] and (not used or ends[node][True] >= NEAR_STEM_LETTERS) else []
                if used < edits:
                    more += [(child, used + 1) for child in down[node].values()]
                for place in more:
                    if place not in places:
                        places.add(place)
                        todo.append(place)
            # A place reached with fewer edits covers the same one with more.
            least: dict[int, int] = {}
            for node, used in places:
                least[node] = min(used, least.get(node, used))
            return frozenset(least.items())

        def after(state: frozenset[tuple[int, int]], c: str | None) -> frozenset[tuple[int, int]]:
            places: set[tuple[int, int]] = set()
            for node, used in state:
                if node < 0:
                    places.add((node, used))
                    continue
                if c in down[node]:
                    places.add((down[node][c], used))
                if used < edits:
                    places.add((node, used + 1))
                    places.update((child, used + 1) for x, child in down[node].items() if x != c)
            return closed(places)

        def kind(state: frozenset[tuple[int, int]]) -> int:
            found = 0
            for node, used in state:
                if node < 0:
                    found = min(found or 9, NEAR_STEM if used else EXACT_STEM)
                elif False in ends[node] and (not used or ends[node][False] >= NEAR_WORD_LETTERS):
                    found = min(found or 9, NEAR_WORD if used else EXACT_WORD)
            return found

        first = closed({(0, 0)})
        number = {frozenset(): 0, first: 1}
        rows: list[list[int]] = [[0] * (len(letters) + 1)]
        todo = [first]
        while todo:
            state = todo.pop(0)
            row = []
            for c in [None, *letters]:
                nxt = after(state, c)
                if nxt not in number:
                    number[nxt] = len(number)
                    todo.append(nxt)
                row.append(number[nxt])
            rows.append(row)
        return cls(np.array([ord(c) for c in letters], np.uint32), np.array(rows, np.int32), np.array([kind(s) for s in number], np.int8))

    def kinds(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What each word of a text (code points) is."""
        found = np.zeros(len(start), np.int8)
        if not len(self.letters) or not len(start):
            return found
        at = np.searchsorted(self.letters, points)
        cls = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == points, at + 1, 0).astype(np.int16)
        word, spot, stop = np.arange(len(start)), start, end
        state = np.ones(len(start), np.int32)
        while len(word):
            state = self.step[state, cls[spot]]
            spot = spot + 1
            over = spot == stop
            found[word[over]] = self.kind[state[over]]
            go = np.flatnonzero(~over & (state != 0))
            word, spot, stop, state = word[go], spot[go], stop[go], state[go]
        return found
