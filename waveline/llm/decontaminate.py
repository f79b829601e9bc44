"""Benchmark passages in documents, found by spaced seeds, in DataFrame functions alone.

A seed hashes the words that a fixed mask selects, so words at its gaps may
differ. Where a seed of a document meets one of a benchmark item the two texts
are laid side by side at that offset, and the best stretch is scored: a word
for each that agrees, a word less for each that does not.

Only a filter of the benchmark's seeds is broadcast, of bounded size; the few
places of documents that pass it go on to joins.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.llm.common import own_columns
from waveline.sources.store import stored

#: Words of a seed: 1 counts, 0 may differ.
MASKS = ("111011", "1101011", "11001101")
SPAN = max(map(len, MASKS))
#: A leak scores as much as this many words of which four in five agree; an
#: item with fewer words must agree so as a whole.
OVERLAP = 20
SHARE = 80  # per cent
#: An item of fewer words has seeds of its own: all its words, and from
#: ONE_GAP words on all but one of them (four in five).
SHORT, ONE_GAP = 12, 5
#: Words of the benchmark up to which its filter lets one place in some thousands
#: through by chance; a larger benchmark has no larger filter, which lets more through.
BLOCK_WORDS = 1_300_000
#: Keys of a filter to a row of 256 bits, and its rows at most.
FILTER_KEYS, FILTER_ROWS = 8, 500_000


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; an absent text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _short_masks(words: int) -> tuple[str, ...]:
    """Masks of a short item: its whole sequence, and that with one gap anywhere."""
    gaps = range(words) if words >= ONE_GAP else ()
    return ("1" * words, *("1" * i + "0" + "1" * (words - 1 - i) for i in gaps))


def _seeds(words: str, at: str, masks: tuple[str, ...]) -> Column:
    """The seed of each mask at a place; what reaches past the end is no seed."""
    return F.array(
        *[
            F.when(F.col(at) + len(mask) <= F.size(words), F.xxhash64(F.lit(m), *[F.get(words, F.col(at) + i) for i in _places(mask)]))
            for m, mask in enumerate(masks)
        ]
    )


def _seeded(rows: DataFrame, words: str, at: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row for each place and mask, with the columns ``at``, ``mask`` and ``seed``."""
    # No filter on the words: the optimizer would make them once more for it.
    last = F.size(words) - min(map(len, masks))
    places = rows.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias(at))
    return places.select("*", F.posexplode(_seeds(words, at, masks)).alias("mask", "seed")).filter("seed is not null")


def _best_stretch() -> Column:
    """Highest score of neighbouring words, laid side by side."""
    step = F.zip_with("d_part", "b_part", lambda a, b: F.when(a == b, F.lit(1)).otherwise(F.lit(-1)))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def add(acc: Column, x: Column) -> Column:
        now = F.greatest(acc["now"] + x, F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(step, start, add, lambda acc: acc["best"])


def _may_have(rows: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """Rows whose ``key``, a hash, is one of ``keys``, and by chance a few others.

    What is broadcast is a Bloom filter for about ``n`` keys: 256 bits a row, of
    which a key sets four.
    """
    parts = max(1, min(FILTER_ROWS, math.ceil(n / FILTER_KEYS)))
    # Never null: else the optimizer would make the key once more to look for nulls.
    part = F.coalesce(F.pmod(F.col(key), F.lit(parts)), F.lit(0))
    places = [f"cast(shiftrightunsigned({key}, {40 + 6 * i}) & 63 as int)" for i in range(4)]
    bits = keys.groupBy(part.alias("part")).agg(*[F.bit_or(F.expr(f"shiftleft(1L, {p})")).alias(f"bits_{i}") for i, p in enumerate(places)])
    met = rows.withColumn("part", part).join(F.broadcast(bits), "part")
    return met.filter(" and ".join(f"getbit(bits_{i}, {p}) = 1" for i, p in enumerate(places))).select(rows.columns)


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, overlap, item_words): passages of the benchmark in whole documents.

    ``overlap`` is the best score of the pair. Items of fewer than SHORT words
    are also looked for by all their words, and by all but one where that is
    four in five. A substitution that leaves no seed whole is not seen: two in
    a short item, or one in every six words of a longer one. Absent and empty
    texts match nothing, an empty table gives no rows. Rows that repeat an
    item or a document give their pair once; documents without doc_id are
    matched as one document with a null id, items without item_id likewise.
    Other columns are not read. Items of equal words are looked for once. A
    filter of the seeds is broadcast, for ``block_words`` words at most; the
    documents are read twice, and only those with a hit are shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long"), _hashed(F.col("text").cast("string")).alias("d_words"))
    texts = texts.withColumn("doc", F.xxhash64("doc_id", "d_words"))
    items = benchmark.select("item_id", _hashed(F.col("text").cast("string")).alias("b_words")).withColumn("item", F.xxhash64("b_words"))
    passages = items.select("item", "b_words").distinct()
    beside = _beside(texts, passages, block_words)
    best = beside.groupBy("doc_id", "item").agg(F.max(_best_stretch()).alias("overlap"), F.max("item_words").alias("item_words"))
    least = (2 * SHARE - 100) * F.least(F.col("item_words"), F.lit(OVERLAP))
    found = best.filter(100 * F.col("overlap") >= least).join(items.select("item_id", "item").distinct(), "item")
    return found.groupBy("doc_id", "item_id").agg(F.max("overlap").cast("long").alias("overlap"), F.max("item_words").cast("long").alias("item_words"))


def _hits(texts: DataFrame, passages: DataFrame, block_words: int) -> DataFrame:
    """(doc, item, shift): where a seed of a document meets one of a passage."""
    length = F.size("b_words")
    sizes = passages.groupBy(F.least(length, F.lit(SHORT)).alias("n")).agg(F.count(F.lit(1)).alias("items"), F.sum(length).alias("words")).collect()
    words = min(block_words, sum(r.words for r in sizes))
    # At most SHORT lengths, and as a rule none; each has one more pass.
    sought = [(_short_masks(r.n), passages.filter(length == r.n), min(block_words, r.items)) for r in sorted(sizes) if 0 < r.n < SHORT]
    found = []
    for masks, some, n in [*sought, (MASKS, passages, words)]:
        seeds = _seeded(some, "b_words", "b_at", masks).select("item", "b_at", "seed")
        places = _seeded(texts.select("doc", "d_words"), "d_words", "d_at", masks).select("doc", "d_at", "seed")
        met = _may_have(places, "seed", seeds, n * len(masks)).join(seeds.hint("merge"), "seed")
        found.append(met.select("doc", "item", (F.col("d_at") - F.col("b_at")).alias("shift")))
    return reduce(DataFrame.unionAll, found).distinct()


def _beside(texts: DataFrame, passages: DataFrame, block_words: int) -> DataFrame:
    """The words of documents and passages that lie side by side at each hit.

    The hits are the left side of each join, as Spark holds the rows that match
    one row of the left; the hints keep it from broadcasts of any size.
    """
    hits = stored(_hits(texts, passages, block_words))
    hit = _may_have(texts, "doc", hits.select("doc"), hits.count()).dropDuplicates(["doc"])
    met = hits.join(passages.hint("merge"), "item").join(hit.hint("merge"), "doc")
    skip = F.greatest(-F.col("shift"), F.lit(0))
    first = F.greatest(F.col("shift"), F.lit(0))
    n = F.least(F.size("b_words") - skip, F.size("d_words") - first)
    parts = F.struct(F.slice("d_words", first + 1, n).alias("d_part"), F.slice("b_words", skip + 1, n).alias("b_part"))
    # From here on only the words beside the item are carried; in a plain
    # projection the optimizer would carry whole texts up to the score.
    return met.select("doc_id", "item", F.size("b_words").alias("item_words"), F.inline(F.array(parts)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of the benchmark; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(own_columns(docs))
