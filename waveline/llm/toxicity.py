"""Toxicity of texts: misspelled terms of a lexicon, weighed by their surroundings.

The lexicon and the weights are learnt from labelled texts. Terms are looked
up by Levenshtein automata met with the lexicon's trie. A hit in quotation
marks or behind a word of reporting counts as a quotation; hits close together
or beside an address count as abuse.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import Scratch, id_and_text, in_parts, text_bytes
from waveline.llm.levenshtein import NEAR_STEM, NEAR_WORD, LexiconAutomaton, Term

#: Labelled texts that the lexicon and the weights are learnt from at most.
SAMPLE = 16_000
MARGIN = 4
#: Letters of stems that are tried, and the chance, over all terms tried, that one is kept whose
#: texts are toxic without cause.
STEM_LETTERS = range(4, 9)
CHANCE = 0.1
MIN_TEXTS = 5
#: Words around a hit that are looked at.
WINDOW = 8
#: Code points that are looked at together.
PART = 1_000_000

REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes term terms word words dit écrit mot mots sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your yours u ur tu te toi vous votre du dich dir dein ihr euch usted ustedes ti vosotros".split())

_WORD = re.compile(r"[^\W_]+")


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    """A lexicon and the weights of what it finds."""

    terms: list[Term]
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    automaton: LexiconAutomaton = field(repr=False)

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


FEATURES = 7


def hit_features(texts: list[str], automaton: LexiconAutomaton) -> np.ndarray:
    """What the lexicon finds in each whole text, a row of numbers each."""
    out = np.zeros((len(texts), FEATURES))
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PART):
            size += len(texts[to]) + 1
            to += 1
        out[at:to] = _part_features(texts[at:to], automaton)
        at = to
    return out


def _part_features(texts: list[str], automaton: LexiconAutomaton) -> np.ndarray:
    out = np.zeros((len(texts), FEATURES))
    whole = "\n".join(x.lower() for x in texts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(x.lower()) + 1 for x in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    letter = _is_letter()[points]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kind = automaton.kinds(points, start, end)
    hits = np.flatnonzero(kind)
    if not len(hits):
        return out
    word_doc = np.searchsorted(ends, start, "right")
    n_words = np.bincount(word_doc, minlength=len(texts))
    # Quotation marks that are open where a hit stands, in its line.
    line = np.maximum.accumulate(np.where(points == 10, np.arange(len(points)), 0))
    straight = np.cumsum(points == 34)
    curved = np.cumsum(np.isin(points, [0x201C, 0x201E, 0xAB])) - np.cumsum(np.isin(points, [0x201D, 0xBB]))
    spot = start[hits]
    # The first line of a part begins without a line break.
    begin = line[spot]
    before = [np.where(points[begin] == 10, x[begin], 0) for x in (straight, curved)]
    quoted = ((straight[spot] - before[0]) % 2 == 1) | (curved[spot] - before[1] > 0)
    doc = word_doc[hits]
    # Only words of the same document are near.
    first_word = np.cumsum(n_words) - n_words
    low = np.maximum(hits - WINDOW, first_word[doc])
    high = np.minimum(hits + WINDOW, first_word[doc] + n_words[doc] - 1)
    near_hits = np.searchsorted(hits, high, "right") - np.searchsorted(hits, low, "left") - 1
    near = np.isin(kind[hits], [NEAR_WORD, NEAR_STEM])
    abuse = np.zeros(len(hits))
    for i, (w, d) in enumerate(zip(hits.tolist(), doc.tolist())):
        around = range(max(0, w - WINDOW), min(len(start), w + WINDOW + 1))
        words = [whole[start[j] : end[j]] if word_doc[j] == d else "" for j in around]
        said = any(x in REPORTING for x in words[max(0, len(words) - 2 * WINDOW - 1) : WINDOW]) if w >= WINDOW else any(x in REPORTING for x in words[:w])
        quoted[i] |= said
        abuse[i] = (0.5 if near[i] else 1.0) * (0.25 if quoted[i] else 1.0) + 0.25 * min(int(near_hits[i]), 4) + 0.5 * any(x in ADDRESS for x in words)
    exact = ~near & ~quoted

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, x.astype(float), len(texts))

    most = np.zeros(len(texts))
    np.maximum.at(most, doc, abuse)
    out[:, 0] = np.log1p(total(exact))
    out[:, 1] = np.log1p(total(near & ~quoted & (kind[hits] == NEAR_WORD)))
    out[:, 2] = np.log1p(total(near & ~quoted & (kind[hits] == NEAR_STEM)))
    out[:, 3] = np.log1p(total(quoted))
    out[:, 4] = most
    out[:, 5] = np.minimum(total(np.ones(len(hits))) * 100 / np.maximum(n_words, 1), 20)
    out[:, 6] = total(exact) > 0
    return out


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): texts of the sample that hold a word, or a word that begins so."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            counts: Counter[tuple[str, bool, int]] = Counter()
            for text, toxic in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                words = {w for w in _WORD.findall(text.decode("utf-8", "replace").lower()) if len(w) >= 3}
                terms = {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEM_LETTERS if len(w) >= k}
                counts.update((t, s, toxic) for t, s in terms)
            if counts:
                (term, stem, toxic), n = zip(*counts.keys()), list(counts.values())
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(stem), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())], names=["term", "stem", "toxic", "n"])

    rows = sample.select("text", "toxic").mapInArrow(of, "term string, stem boolean, toxic int, n long")
    return rows.groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))


def choose_terms(rows: list[tuple[str, bool, int, int]], share: float, tried: int) -> list[Term]:
    """Terms that say toxic, the most telling first, none that another one covers; ``tried`` terms were counted.

    A stem that is hardly more than one word is left to that word.
    """
    scored = []
    for term, stem, t, c in rows:
        n = t + c
        rate = t / n
        gain = n * (rate * np.log(rate / share) + (0 if rate == 1 else (1 - rate) * np.log((1 - rate) / (1 - share))))
        if t >= MIN_TEXTS and rate >= max(0.5, 3 * share) and gain >= np.log(tried / CHANCE):
            scored.append((-gain, stem, -len(term), term, t))
    chosen: list[Term] = []
    count: dict[str, int] = {}
    stems: set[str] = set()
    for _, stem, _, term, t in sorted(scored):
        if any(term[:k] in stems for k in range(1, len(term) + 1)):
            continue
        if stem and any(x.text.startswith(term) and count[x.text] >= 0.9 * t for x in chosen):
            continue
        chosen.append(Term(term, stem))
        count[term] = t
        if stem:
            stems.add(term)
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant first, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.r_[0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-3), gradient)
        # Where the sample can be told apart without error, full steps run away.
        step /= max(1.0, np.abs(step).max())
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _smallest(marked: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows with the smallest hashed ids.

    Only rows below a share that leaves about ``MARGIN`` times as many are
    sorted, so that the sort does not grow with the input.
    """
    draw = F.xxhash64("doc_id")
    share = min(1.0, MARGIN * sample / max(1, marked.count()))
    return marked.filter(draw / 2.0**64 + 0.5 <= share).orderBy(draw, "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic), learnt from ``sample`` labelled rows at most.

    They are those with the smallest hashed ids. Absent labels and ids teach
    nothing; a document labelled twice counts as toxic if one label says so.
    Near copies are counted once, so that a copied text does not make its words
    tell. Without any toxic text the lexicon is empty.
    """
    scratch = Scratch(docs.sparkSession)
    marked = scratch.put(labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    drawn = _smallest(marked, sample)
    # The size of the sample is bounded, so the documents stay where they are.
    learnt = scratch.put(id_and_text(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    scratch.drop(marked)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 3)))
    apart = learnt.withColumn("w", words).withColumn("sign", F.array_min(shingles)).drop("w").dropDuplicates(["sign", "toxic"])
    apart = scratch.put(apart.select("text", "toxic"))
    n = dict(apart.groupBy("toxic").count().collect())
    share = n.get(1, 0) / max(1, sum(n.values()))
    terms: list[Term] = []
    if 0 < share < 1:
        counted = scratch.put(_term_counts(apart).filter(F.col("t") + F.col("c") >= MIN_TEXTS))
        likely = counted.filter((F.col("t") >= MIN_TEXTS) & (F.col("t") >= F.col("c")))
        terms = choose_terms([tuple(r) for r in likely.collect()], share, counted.count())
        scratch.drop(counted)
    automaton = LexiconAutomaton.build(terms)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = hit_features([x.decode("utf-8", "replace") for x in text_bytes(batch.column(0))], automaton)
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, found.T)], names=["toxic", *(f"f{i}" for i in range(FEATURES))])

    schema = "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES))
    rows = np.array([tuple(r) for r in learnt.select("text", "toxic").mapInArrow(of, schema).collect()], float).reshape(-1, FEATURES + 1)
    scratch.drop(learnt, apart)
    y, x = rows[:, 0], rows[:, 1:]
    center, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    return Model(terms, _logistic((x - center) / scale, y), center, scale, automaton)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, abuse) of whole texts; absent and empty texts are scored like texts without a hit.

    Each input row gives one row, repeated rows and rows without doc_id too.
    Other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = hit_features([x.decode("utf-8", "replace") for x in text_bytes(batch.column(1))], model.automaton)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(found)), pa.array(found[:, 4])], names=["doc_id", "score", "abuse"])

    return id_and_text(docs).mapInArrow(of, "doc_id long, score double, abuse double")
