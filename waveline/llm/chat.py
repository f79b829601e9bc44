"""Chat logs folded into messages and rendered with a loss mask, in DataFrame functions alone.

A log holds events of messages: a ``message`` or an ``edit`` sets the text, a
``delta`` adds to it, a ``regenerate`` starts it again. A conversation is the
fold of its events, in the order of ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.llm.quality import _let

#: Events that put aside what a message said before.
RESETS = ("message", "edit", "regenerate")
#: A turn is OPEN, role, line break, text, CLOSE.
OPEN, CLOSE = "<s>", "</s>"
#: Control strings, here and in templates of the same family; one more
#: backslash behind the first sign keeps them apart from those of the template.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\])|br>)"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\])|br>)"
#: Stands for a line break in a role, which ends at the first one.
BREAK = "<br>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, first_seq, role, text) of (conv_id, seq, event, message_id, role, text).

    The text is what the events from the last reset on say together, in the
    order of seq; events of one seq go by kind and text. Absent text adds
    nothing, an unknown or absent kind is a delta. The role is that of the
    earliest event that has one, or empty. Messages are folded one by one, so a
    conversation of any size is dealt out over the tasks.
    """
    entry = F.struct("seq", F.coalesce("event", F.lit("delta")).alias("event"), F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct(F.col("seq"), F.col("role")))).alias("role"),
        F.array_sort(F.collect_list(entry)).alias("events"),
    )
    resets = F.filter(F.transform("events", lambda e, i: F.when(e["event"].isin(*RESETS), i)), lambda i: i.isNotNull())
    live = F.slice("events", F.coalesce(F.array_max(resets), F.lit(0)) + 1, F.size("events"))
    text = F.array_join(F.transform(live, lambda e: e["text"]), "")
    return folded.select("conv_id", "message_id", "first_seq", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) of folded messages, one row for each conversation.

    Turns go by first_seq, then role, text and message_id. ``loss`` has the
    turn number, the first character in the turn and the number of characters
    of each text that is to be learnt. Line breaks in a role become BREAK. A
    conversation is one string in the end, so it is one row of one task; it
    meets there after its messages have been folded.
    """
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "role", "text", "message_id"))).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role")
        ),
    )
    spans = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.when(
                p["role"] == LOSS_ROLE, F.struct(i.alias("turn"), F.length(p["head"]).alias("start"), F.length(p["body"]).alias("length"))
            ),
        ),
        lambda s: s.isNotNull(),
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return turns.select("conv_id", parts.alias("parts")).select(
        "conv_id", F.size("parts").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss")
    )


def format_conversations(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learnt, formatted) from rendered strings and masks: the turns with role and text, and the texts under the mask, unescaped."""

    def cut(pieces: Column) -> Column:
        def turn(p: Column) -> Column:
            return _let(
                F.locate("\n", p),
                lambda at: F.struct(
                    unescape_role(p.substr(F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))).alias("role"), unescape(p.substr(at + 1, F.length(p))).alias("text")
                ),
            )

        return F.transform(pieces, turn)

    def learnt(pieces: Column) -> Column:
        return F.transform(F.col("loss"), lambda s: unescape(F.get(pieces, s["turn"]).substr(s["start"] + 1, s["length"])))

    # Behind the last turn there is nothing.
    split = F.split("formatted", CLOSE)
    pieces = F.slice(split, 1, F.size(split) - 1)
    both = _let(pieces, lambda p: F.struct(cut(p).alias("turns"), learnt(p).alias("learnt")))
    return formatted.select("conv_id", "formatted", both.alias("_b")).select("conv_id", "_b.turns", "_b.learnt", "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the rendered strings."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
