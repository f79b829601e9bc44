"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over a window, each keeps
its highest answer and a softmax layer weighs them. Training and prediction
are numpy; prediction runs over all windows of a text, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveline.llm.common import give_back, id_and_text, in_parts, own_columns, text_bytes
from waveline.sources.store import stored

#: Bytes of a window, sizes of the network.
WINDOW = 128
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 24
#: Documents of a language that the network learns from at most, and crops of each.
PER_LANGUAGE = 2_000
CROPS = 3
MARGIN = 4
EPOCHS = 3
MIN_STEPS = 300
BATCH = 128
RATE = 0.01
#: Windows that are convolved at once.
AT_ONCE = 512
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """Weights; byte 0 also fills windows that are not full."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], rng: np.random.Generator) -> ByteCNN:
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        n = len(languages)
        return cls(
            languages,
            normal(256, EMBEDDING, scale=0.5),
            [normal(w * EMBEDDING, FILTERS, scale=(2 / (w * EMBEDDING)) ** 0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            normal(len(WIDTHS) * FILTERS, n, scale=0.1),
            np.zeros(n, np.float32),
        )

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Highest answer of each filter, where it was, and the flattened strings that the filters saw."""
        embedded = self.embedding[windows].reshape(len(windows), -1)
        best, where, seen = [], [], []
        for width, weight, bias in zip(WIDTHS, self.filters, self.biases):
            places = windows.shape[1] - width + 1
            strings = np.lib.stride_tricks.as_strided(
                embedded, (len(windows), places, width * EMBEDDING), (embedded.strides[0], EMBEDDING * 4, 4), writeable=False
            )
            answer = (strings.reshape(-1, width * EMBEDDING) @ weight).reshape(len(windows), places, -1)
            at = answer.argmax(axis=1) if self._training else None
            best.append(np.maximum(answer.max(axis=1) + bias, 0))
            where.append(at)
            seen.append(strings)
        return np.concatenate(best, axis=1), where, seen

    _training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self._pooled(windows)[0] @ self.out + self.out_bias)

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Mean gradients of the cross-entropy, in the order of ``weights``."""
        self._training = True
        pooled, where, seen = self._pooled(windows)
        self._training = False
        wrong = _softmax(pooled @ self.out + self.out_bias)
        wrong[np.arange(len(label)), label] -= 1
        wrong /= len(label)
        back = (wrong @ self.out.T) * (pooled > 0)
        embedding = np.zeros_like(self.embedding)
        rows = np.arange(len(windows))[:, None]
        filters, biases = [], []
        for k, (width, weight, at, strings) in enumerate(zip(WIDTHS, self.filters, where, seen)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            chosen = strings[rows, at]  # window, filter, string
            filters.append(np.einsum("bf,bfs->sf", part, chosen))
            biases.append(part.sum(axis=0))
            down = (part[:, :, None] * weight.T[None]).reshape(len(windows), FILTERS, width, EMBEDDING)
            byte = windows[rows[:, :, None], at[:, :, None] + np.arange(width)]
            np.add.at(embedding, byte.reshape(-1), down.reshape(-1, EMBEDDING))
        return [embedding, *filters, *biases, pooled.T @ wrong, wrong.sum(axis=0)]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Most likely language of each whole text, and the mean probability over its windows, weighted by bytes."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        count = np.maximum(1, -(-sizes // WINDOW))
        data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        doc = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + within * WINDOW
        n = np.clip(sizes[doc] - within * WINDOW, 0, WINDOW)
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(doc), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            windows = data[np.minimum(start[part, None] + np.arange(WINDOW), len(data) - 1)]
            windows = np.where(np.arange(WINDOW) < n[part, None], windows, 0)
            np.add.at(total, doc[part], self.probabilities(windows) * np.maximum(n[part, None], 1))
        total /= np.maximum(sizes, 1)[:, None]
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(len(texts)), best], 0, 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def crops(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, crop): places all over the texts of ``per_language`` documents of each language at most.

    The documents are those with the smallest hashed ids, so the same at any
    partitioning; rows without id, text or language teach nothing. Of a
    language with many documents only those with a hash below a share that
    leaves about ``MARGIN`` times the sample are compared, so that what meets
    in a task does not grow with the input. Only crops are moved.
    """
    known = docs.filter("doc_id is not null and text is not null and lang is not null").withColumn("text", F.lower("text"))
    known = known.withColumn("draw", F.xxhash64("doc_id", F.xxhash64("text")))
    # A row for each language, as many as the network has answers.
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if sizes:
        share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, MARGIN * per_language / n))])
        known = known.filter(F.col("draw") / 2.0**64 + 0.5 <= F.element_at(share, F.col("lang")))
    pieces = known.select(
        "lang",
        "draw",
        F.array(
            *[
                F.expr(f"substring(text, cast(pmod(xxhash64(doc_id, {k}), greatest(length(text) - {WINDOW // 2}, 1)) as int) + 1, {WINDOW})")
                for k in range(CROPS)
            ]
        ).alias("crops"),
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    return pieces.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "draw", "crops")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 7) -> ByteCNN:
    """A network trained on (doc_id, text, lang), by Adam on crops of random length.

    The sample is bounded by ``per_language`` times the number of languages.
    """
    rows = sorted((r.lang, r.draw, *r.crops) for r in crops(docs, per_language).collect())
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    model = ByteCNN.start(languages, rng)
    if len(languages) < 2:
        return model
    texts = [c.encode("utf-8", "replace")[:WINDOW] for r in rows for c in r[2:]]
    label = np.repeat([languages.index(r[0]) for r in rows], CROPS)
    windows = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        windows[i, : len(t)] = np.frombuffer(t, np.uint8)
    # Rare languages are drawn as often as frequent ones.
    weight = 1 / np.bincount(label)[label]
    weight /= weight.sum()
    mean, square = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    steps = max(MIN_STEPS, EPOCHS * len(texts) // BATCH)
    for step in range(1, steps + 1):
        pick = rng.choice(len(texts), BATCH, p=weight)
        length = np.where(rng.random(BATCH) < 0.5, WINDOW, rng.integers(8, WINDOW + 1, BATCH))
        batch = np.where(np.arange(WINDOW) < length[:, None], windows[pick], 0)
        rate = RATE * (1 - (step - 1) / steps)
        for w, g, m, s in zip(model.weights, model.gradients(batch, label[pick]), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def identify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts; ``und`` and 0 where a text is absent or has no letter.

    Each input row gives one row, repeated rows and rows without doc_id too.
    A model that has seen no language answers ``und``. Other columns are not read.
    """
    learned = model.languages

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            lettered = batch.column(2).to_pylist()
            if learned:
                best, score = model.predict(text_bytes(batch.column(1)))
                pred = [learned[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered)]
                score = np.where(lettered, score, 0.0)
            else:
                pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
        give_back()

    rows = id_and_text(docs).select("doc_id", F.lower("text").alias("text"), has_letter(F.col("text")).alias("lettered"))
    return rows.mapInArrow(of, "doc_id long, lang_pred string, score double")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


#: Mean probability below which a text is taken for none of the languages.
LEAST = 0.3


def keep_identified(docs: DataFrame, model: ByteCNN, least: float = LEAST) -> DataFrame:
    """``docs`` without texts that have no letter, or in which no language is likely.

    Rows that share a doc_id go only if all of them are rejected.
    """
    # Written, as it is read twice.
    found = stored(identify(docs, model))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc_id").distinct()
    gone = found.select("doc_id").join(kept, "doc_id", "left_anti").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(own_columns(docs))
