"""Chat logs folded into final conversations and rendered for training.

A log row is an event of one conversation: ``message`` states a message,
``delta`` appends to it as it streams, ``edit`` replaces its text, and
``regenerate`` withdraws a message and all later ones, which following events
may state again. Sorted by sequence number, the events fold into the final
messages. Only DataFrame functions are used.

An event is alive if it is later than every withdrawal that reaches its message, and a
text is the deltas since the last statement or edit of its message. Events meet per
message first, in parallel inside a conversation; one pass over the messages of a conversation in
their order then carries the latest withdrawal along, in constant memory. Only the finished, rendered conversation, which
is one string, meets in one row.

Defined results: a missing text is empty, a missing role is written as an empty
role, a missing conversation id is a conversation of its own. Events with the same
place are ordered by kind and text. A log without surviving messages gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the template writes around a turn.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Characters that control strings are made of, and what stands for them inside
#: texts and roles. The first is the escape itself.
ESCAPES = (("&", "&amp;"), ("#", "&num;"), (":", "&colon;"), ("<", "&lt;"))


def escape(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def fold_events(events: DataFrame, message: Sequence[str] = ("message",)) -> DataFrame:
    """Final messages (conv_id, message, role, text) of an event log.

    Columns of the log: conv_id, seq (place in the log), kind, role, text, and those named by ``message``, which are
    together any sortable place of the message in its conversation (several give a struct). A
    ``regenerate`` at ``seq`` withdraws everything before it that belongs to its
    message or to later ones.

    Each message is reduced by its own events before the conversation is looked at: what its own withdrawal
    or last statement makes void does not travel on. A log that is already dealt by the
    conversation, or by it and some columns of ``message``, is not shuffled for that step.
    """
    withdrawal = F.col("kind") == "regenerate"
    states = F.col("kind") != "delta"
    event = F.struct("seq", states.alias("states"), F.coalesce("text", F.lit("")).alias("text"), "role")
    folded = events.groupBy("conv_id", *message).agg(
        F.array_sort(F.collect_list(F.when(~withdrawal, event))).alias("_events"), F.max(F.when(withdrawal, F.col("seq"))).alias("_withdrawn")
    )

    def after(cut: str):
        return lambda e: F.col(cut).isNull() | (e["seq"] > F.col(cut))

    folded = folded.withColumn("_events", F.filter("_events", after("_withdrawn")))
    roles = F.filter("_events", lambda e: e["role"].isNotNull())
    folded = folded.withColumns({
        "_last": F.array_max(F.transform(F.filter("_events", lambda e: e["states"]), lambda e: e["seq"])),
        "_role": F.get(F.transform(roles, lambda e: F.struct(e["seq"].alias("seq"), e["role"].alias("role"))), F.size(roles) - 1),
    })
    since = F.filter("_events", lambda e: F.col("_last").isNull() | (e["seq"] > F.col("_last")) | ((e["seq"] == F.col("_last")) & e["states"]))
    parts = F.transform(since, lambda e: F.struct(e["seq"].alias("seq"), e["states"].alias("states"), e["text"].alias("text")))
    folded = folded.select("conv_id", *message, "_withdrawn", "_role", parts.alias("_parts"))

    so_far = Window.partitionBy("conv_id").orderBy(*message).rowsBetween(Window.unboundedPreceding, 0)
    folded = folded.withColumn("_cut", F.max("_withdrawn").over(so_far))
    folded = folded.withColumn("_parts", F.filter("_parts", after("_cut"))).where(F.size("_parts") > 0)
    # two statements with the same place: the last one holds
    held = F.filter("_parts", lambda e: e["states"])
    return folded.select(
        "conv_id", F.struct(*message).alias("message") if len(message) > 1 else F.col(message[0]).alias("message"),
        F.when(after("_cut")(F.col("_role")), F.col("_role.role")).alias("role"),
        F.concat(
            F.coalesce(F.get(held, F.size(held) - 1)["text"], F.lit("")),
            F.array_join(F.transform(F.filter("_parts", lambda e: ~e["states"]), lambda e: e["text"]), ""),
        ).alias("text"),
    )


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_turns.

    ``loss_turns`` is the mask: for each turn in order, whether the text between its
    marker and its closing tag is trained on.
    """
    turn = F.concat(
        F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(MIDDLE),
        escape(F.coalesce("text", F.lit(""))), F.lit(CLOSE),
    )
    rendered = messages.select("conv_id", F.struct(
        F.col("message").alias("at"), turn.alias("turn"), F.coalesce(F.col("role").isin(*trained_roles), F.lit(False)).alias("loss")
    ).alias("t"))
    whole = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("_turns"))
    return whole.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("_turns", lambda t: t["loss"]).alias("loss_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``: array of (role, text, loss), parsed from ``formatted`` and the mask."""
    pieces = F.split("formatted", CLOSE)  # the text after the last tag is empty
    body = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    opened = F.lit(len(OPEN) + 1)
    parsed = F.transform(F.arrays_zip(body.alias("piece"), F.col("loss_turns").alias("loss")), lambda p: F.struct(
        unescape(F.substr(F.substring_index(p["piece"], MIDDLE, 1), opened)).alias("role"),
        unescape(F.substr(p["piece"], F.instr(p["piece"], MIDDLE) + len(MIDDLE))).alias("text"),
        p["loss"].alias("loss"),
    ))
    return formatted.withColumn("turns", parsed)


def digests(parsed: DataFrame) -> DataFrame:
    """Digests of what was read back: all turns, and the texts under the mask."""
    everything = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(everything.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """An event log of stored turns: each row states one message.

    Rows with the same turn are messages of their own, ordered by role and text.
    """
    return _placed(rows, conv_id, turn, role, text).select(
        "conv_id", F.struct("turn", "tie").alias("seq"), F.lit("message").alias("kind"),
        F.struct("turn", "tie").alias("message"), "role", "text",
    )


#: Columns that place a message of ``streamed_log``.
STREAMED = ("turn", "tie", "answer")


def streamed_log(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 delta_chars: int = 200) -> DataFrame:
    """An event log whose fold gives the stored turns back, told the way a client would have written it.

    Each row's message is started, a wrong draft streams in (some characters, backwards), an answer follows, and
    both are withdrawn by a regeneration. Then the draft is stated again, edited to the first
    ``delta_chars`` characters of the text, and the rest arrives as deltas by position. The place of a message is (turn, tie, answer).
    """
    said = F.coalesce("text", F.lit(""))
    late = F.sequence(F.lit(2), F.greatest(F.ceil(F.char_length(said) / delta_chars), F.lit(2)).cast("int"))

    def event(step, kind: str, words: Column, answer: int = 0, by: Column | None = None) -> Column:
        return F.struct(
            F.lit(step).cast("int").alias("step"), F.lit(answer).alias("answer"), F.lit(kind).alias("kind"),
            (F.lit(None).cast("string") if by is None else by).alias("role"), words.alias("text"),
        )

    def part(k: Column) -> Column:
        return F.substr(said, (k - 1) * delta_chars + 1, F.lit(delta_chars))

    wrong, none = F.reverse(F.substr(said, F.lit(1), F.lit(20))), F.lit(None).cast("string")
    first = F.array(
        event(0, "message", none, by=F.col("role")), event(1, "delta", wrong),
        event(2, "message", wrong, answer=1, by=F.col("role")), event(3, "regenerate", none),
        event(4, "message", wrong, by=F.col("role")), event(5, "edit", part(F.lit(1))),
    )
    events = F.concat(first, F.transform(late, lambda k: event(k + 4, "delta", part(k))))
    return _placed(rows, conv_id, turn, role, text).select("conv_id", "turn", "tie", F.explode(events).alias("e")).select(
        "conv_id", F.struct("turn", "tie", "e.step").alias("seq"), "e.kind", "turn", "tie", "e.answer", "e.role", "e.text",
    )


def _placed(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Stored turns with their place among rows of the same turn, ``tie``."""
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    among = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return plain.withColumn("tie", F.row_number().over(among))
