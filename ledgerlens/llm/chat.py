"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted, and neighbours of
one role are merged into one message; a message keeps the seams between its
turns, so the formatted string reads back to the very rows it came from.

Template (fixed values): ``<s>`` message... ``</s>``, a message being
``[ROLE]`` role ``[/ROLE]`` turn (``[AND]`` turn)* ``[END]``. ``&``, ``[`` and
``<`` inside roles and texts are written as entities, so no control string
can come from a text, and the escape is reversible.

Defined cases: a null text or role is empty; a null conversation id is a
conversation; turns are ordered by (turn, role, text), null turn first, so
ties and repeated rows have one result; an empty table gives no rows; a
conversation is one output row, however long; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"
ROLE, ROLE_END, AND, END = "[ROLE]", "[/ROLE]", "[AND]", "[END]"
# Escapes in the order they are applied; undone in reverse.
ESCAPES = (("&", "&amp;"), ("[", "&lsb;"), ("<", "&lt;"))


def escape(c: Column) -> Column:
    for plain, entity in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in reversed(ESCAPES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` are (start, length) ranges of code points of ``formatted``
    that carry the training loss: one per turn of ``loss_role``.
    """
    turn = F.struct(F.col(turn_col).alias("turn"),
                    escape(F.coalesce(F.col(role_col), F.lit(""))).alias("role"),
                    escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    grouped = (turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t"))
               .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))

    def piece(t: Column, i: Column) -> Column:
        # What stands before and after a turn's text: a message opens where
        # the role changes, and closes before the next change.
        before, after = F.get("turns", i - 1), F.get("turns", i + 1)
        opens = (i == 0) | (before["role"] != t["role"])
        merged = F.coalesce(after["role"] == t["role"], F.lit(False))
        return F.struct(
            F.when(opens, F.concat(F.lit(ROLE), t["role"], F.lit(ROLE_END)))
             .otherwise(F.lit("")).alias("head"),
            t["text"].alias("text"),
            F.when(merged, F.lit(AND)).otherwise(F.lit(END)).alias("tail"),
            (t["role"] == loss_role).alias("loss"))

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    span = "array<struct<start:bigint,length:bigint>>"

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        size = F.length(p["text"]).cast("long")
        here = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + F.length(p["tail"])).alias("at"),
                        F.when(p["loss"], F.concat(acc["spans"], here))
                         .otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(len(BOS)).cast("long").alias("at"),
                                           F.array().cast(span).alias("spans")),
                        advance, lambda acc: acc["spans"])
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], p["tail"])), "")
    return pieces.select("conv_id", F.concat(F.lit(BOS), body, F.lit(EOS)).alias("formatted"),
                         spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text, read from ``formatted`` and ``loss_spans``:
    ``conv_id, turns array<struct<role, text>>, loss_text, formatted``."""
    body = F.substring("formatted", F.lit(len(BOS) + 1),
                       F.length("formatted") - len(BOS) - len(EOS))
    # Every message ends with END, so the last element of the split is empty.
    messages = F.split(body, r"\[END\]")
    messages = F.slice(messages, F.lit(1), F.size(messages) - 1)

    def turns_of(message: Column) -> Column:
        parts = F.split(message, r"\[/ROLE\]", 2)
        role = unescape(F.substring(parts[0], F.lit(len(ROLE) + 1), F.length(parts[0])))
        return F.transform(F.split(parts[1], r"\[AND\]"),
                           lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    under = F.transform("loss_spans", lambda s: F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return formatted.select("conv_id", F.flatten(F.transform(messages, turns_of)).alias("turns"),
                            unescape(F.array_join(under, "")).alias("loss_text"), "formatted")


def digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
