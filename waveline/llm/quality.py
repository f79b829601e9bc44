"""Line-first cleaning and document rules, in DataFrame functions alone.

Lines are judged first; those that fail are removed, and a document that loses
too much of its text is rejected. Counts over the whole text come beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as in the contract of the counts.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED = 30  # per cent of the words

#: Endings of a sentence, a list item or a quotation.
SENTENCE_END = r"""[.!?…。！？:;,"'”’»)\]]\s*$"""
#: The end of a sentence inside a line.
SENTENCE = r"[.!?…。！？]\s"
#: A line of separators between short labels, which has three of SEPARATORS at least.
SEPARATORS = "|›»>•·"
MENU = r"(\S+\s*[|›»>•·]\s*){3,}"
#: A line that leads elsewhere.
LINK = (
    r"(?i)^\s*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|"
    r"skip to content|read more|share|tweet|follow us|subscribe|contact us|about us|site map)\s*[|›»>.!]*\s*$"
)
NAVIGATION = f"(?i){MENU}|{LINK.removeprefix('(?i)')}"
#: Words of which each notice of BOILERPLATE has one.
NOTICE_WORDS = ("cookie", "privacy", "terms ", "rights", "javascript", "click", "lorem", "powered", "newsletter", "follow", "share")
#: Notices that many pages carry.
BOILERPLATE = (
    r"(?i)\b(cookies? (policy|settings)|uses? cookies|accept (all )?cookies|privacy policy|terms (of (use|service)|and conditions)|"
    r"all rights reserved|enable javascript|javascript (is|must be) |click here|lorem ipsum|powered by|"
    r"subscribe to our newsletter|follow us on|share this (article|page|post))\b"
)
#: More symbols than this share of its characters make a line machine text.
MAX_SYMBOLS = 0.1
#: Words of a line that may stand without an end of a sentence: titles, verse, code.
SHORT_LINE = 12
#: Share of its characters that a document may lose.
MAX_LOSS = 0.3


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that the text holds twice or more, the first of them included.

    Windows are hashed from hashed words and sorted by hash, so equal ones are
    neighbours; the places of those are sorted again and their lengths added up
    without counting a word twice.
    """

    def windows(h: Column) -> Column:
        n = F.size(h) - (window - 1)

        def one(i: Column) -> Column:
            return F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(window)]).alias("h"), i.alias("at"))

        return F.when(n < 2, F.lit(None)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one))

    def twice(s: Column) -> Column:
        return F.filter(
            s,
            lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) & (i > 0), F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.get(at, i + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(
        _let(hashed, lambda h: _let(F.sort_array(windows(h)), lambda s: _let(F.sort_array(F.transform(twice(s), lambda x: x["at"])), covered))),
        F.lit(0).cast("long"),
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts.

    An absent text has no words. Each input row gives one row; other columns
    are not read.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = text.withColumns(
        {
            "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "_c": _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))),
        }
    ).select("doc_id", "text", F.col("_c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_c.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def line_fails(line: Column) -> Column:
    """Whether a line with words is navigation, boilerplate, machine text or words without any end of a sentence.

    What is cheap and rules a pattern out comes before the pattern.
    """
    chars = F.length(line)
    symbols = chars - F.length(F.translate(line, SYMBOLS, ""))
    menu = (chars - F.length(F.translate(line, SEPARATORS, "")) > 2) & line.rlike(MENU)
    lower = F.lower(line)
    notice = reduce(lambda a, b: a | b, [lower.contains(w) for w in NOTICE_WORDS]) & line.rlike(BOILERPLATE)
    fragment = ~line.rlike(SENTENCE) & ~line.rlike(SENTENCE_END) & (F.size(F.split(F.trim(line), r"\s+")) > SHORT_LINE)
    return (symbols > MAX_SYMBOLS * chars) | menu | line.rlike(LINK) | notice | fragment


def clean_lines(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """(doc_id, clean_text, n_lines, n_failed_lines, lost, rejected): lines without a word stay as they are.

    ``lost`` is the share of the characters that stood on failed lines; a
    document that loses more than ``max_loss`` is rejected. A text without any
    character loses nothing.
    """
    lines = docs.select("doc_id", F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("lines"))
    judged = lines.withColumn(
        "lines", F.transform("lines", lambda x: F.struct(x.alias("line"), (x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x)).alias("fails")))
    )
    kept = F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"])
    count = F.aggregate(
        "lines",
        F.struct(*[F.lit(0).cast("long").alias(c) for c in ("all", "lost", "failed")]),
        lambda a, x: F.struct(
            (a["all"] + F.length(x["line"])).alias("all"),
            (a["lost"] + F.when(x["fails"], F.length(x["line"])).otherwise(0)).alias("lost"),
            (a["failed"] + x["fails"].cast("long")).alias("failed"),
        ),
    )
    share = F.when(F.col("_c.all") == 0, F.lit(0.0)).otherwise(F.col("_c.lost") / F.col("_c.all"))
    return judged.select(
        "doc_id", F.array_join(kept, "\n").alias("clean_text"), F.size("lines").cast("long").alias("n_lines"), count.alias("_c")
    ).select("doc_id", "clean_text", "n_lines", F.col("_c.failed").alias("n_failed_lines"), share.alias("lost"), (share > max_loss).alias("rejected"))


def quality(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Counts of whole texts, the verdict of the lines and both together in ``kept``.

    Absent and empty texts have no words, so they fail. Each input row gives
    one row, repeated rows and rows without doc_id too.
    """
    counts = base_counts(docs)
    # Both parts read the same row, so they need no join: the lines ride along.
    row = counts.select(F.struct("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").alias("doc_id"), "text")
    judged = clean_lines(row, max_loss)
    return judged.select("doc_id.*", "clean_text", "n_lines", "n_failed_lines", "lost", (~F.col("doc_id.base_failed") & ~F.col("rejected")).alias("kept"))
