"""Chat formatting by event-sourced reconstruction.

Events (conv_id, seq, message, role, kind, text) are folded per conversation
in order of ``seq``:

* ``message``: starts the message with this text,
* ``delta``: appends to the message,
* ``edit``: replaces the message's text,
* ``regenerate``: drops the message's text and starts anew with this text.

A message stands at its first event; its role is that of its first event with
a role. The folded messages are rendered with the template

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside roles and texts are escaped reversibly: ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (and a line feed in a role ``&#10;``).
``loss_mask`` lists the assistant texts: (start, length) in the formatted
string, in code points, without the markers; and (turn, at), the turn's number
and where the text starts behind its start marker.

Only DataFrame and SQL functions are used. The result of a conversation is one
string, so a conversation's events are gathered for its row; deltas are
concatenated once per message, not step by step.

Edge cases: a null text is empty, a null role is an empty role, a null kind is
``message``; ties in ``seq`` are ordered by message, kind, role and text;
repeated rows are events of their own (a repeated ``message`` row restarts its
message; rows with message ids of their own make a turn each); conversations
without events don't exist; a null conv_id is one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, seq, message, role, text)."""
    log = events.select("conv_id", "seq", "message", "role",
                        F.coalesce(F.lower("kind"), F.lit("message")).alias("kind"),
                        F.coalesce("text", F.lit("")).alias("text"))
    ordered = (log.groupBy("conv_id", "message")
               .agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log")))
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i).otherwise(F.lit(0)))
    last = F.array_max(resets)
    tail = F.slice("log", last + 1, F.size("log") - last)
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return ordered.select("conv_id", F.col("log")[0]["seq"].alias("seq"), "message",
                          F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"),
                          F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of folded messages.

    Every turn is rendered on its own row; where it starts is a running sum of
    the lengths before it, so that work grows with the events of a conversation
    and a conversation's row is put together once."""
    order = Window.partitionBy("conv_id").orderBy("seq", "message", "role", "text")
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    sized = (messages.select("conv_id", "seq", "message", "role", "text", head.alias("head"), body.alias("body"))
             .withColumn("size", F.char_length("head") + F.char_length("body") + len(END) + 1)
             .withColumn("place", F.row_number().over(order) - 1)
             .withColumn("start", F.sum(F.col("size").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
                         - F.col("size")))
    turn = F.struct("place", F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
                    (F.col("role") == ASSISTANT).alias("learn"),
                    F.struct((F.col("start") + F.char_length("head")).alias("start"),
                             F.char_length("body").cast("long").alias("length"), F.col("place").alias("turn"),
                             (F.char_length("head") - len(START)).alias("at")).alias("mask"))
    turns = sized.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"),
                        F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: x["mask"]).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: adds turns (role, text) and loss_text
    (unescaped text under the loss mask). The string is split once; the text
    under a mask entry is cut from the piece of its turn."""
    others = [F.col(f"`{c}`") for c in formatted.columns]
    pieces = formatted.select(*others, F.split("formatted", r"\Q" + START + r"\E", -1).alias("_pieces"))
    turn = F.transform(F.slice("_pieces", F.lit(2), F.size("_pieces") - 1), lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring_index(F.substr(p, F.instr(p, "\n") + 1), END, 1)).alias("text")))
    seen = F.transform("loss_mask", lambda m: unescape(
        F.substr(F.get("_pieces", m["turn"] + 1), (m["at"] + 1).cast("int"), m["length"].cast("int"))))
    return pieces.select(*others, turn.alias("turns"), F.array_join(seen, "").alias("loss_text"))


def chat_format(events: DataFrame) -> DataFrame:
    """Events to (conv_id, formatted, loss_mask)."""
    return render(fold(events))
