"""Chat formatting: a state machine over roles and a declarative template with loss flags.

The template is data: markers, roles under the loss, and the transitions of the state machine.  Every turn
becomes three segments (header, text, end marker), each with a loss flag; a conversation's formatted text is its
segments in order.  Only markers contain ``<|``: in texts and roles a backslash is doubled and ``<|`` becomes
``<\\|``, so what a user types can neither end a turn nor open one, and the text is read back without loss.

Defined cases: a null text is empty; a null role is the empty role; turns are ordered by turn, then role and
text, nulls first, and repeated rows stay; rows with a null conversation id form one conversation; a conversation
whose roles break the turn order is still formatted and has ``valid`` false.  An empty table gives no rows.
A conversation is one output row, so it must fit a task, as any text does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``transitions`` maps (state, role) to the next state; the start state is ``start``."""

    open: str = "<|start|>"
    header_end: str = "\n"
    close: str = "<|end|>\n"
    newline: str = "<|nl|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "primed",
            ("start", "user"): "asked",
            ("primed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)


DEFAULT = ChatTemplate()


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _state_after(roles: Column, template: ChatTemplate) -> Column:
    def step(state: Column, role: Column) -> Column:
        to = F.lit("error")
        for (source, name), target in template.transitions.items():
            to = F.when((state == source) & (role == name), F.lit(target)).otherwise(to)
        return to

    return F.aggregate(roles, F.lit("start"), step)


def format_chat(
    turns: DataFrame,
    template: ChatTemplate = DEFAULT,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, end_state, segments, formatted.

    ``segments`` is an array of (text, loss); ``formatted`` is their concatenation.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments_of(t: Column) -> Column:
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit(template.newline))
        header = F.concat(F.lit(template.open), role, F.lit(template.header_end))
        return F.array(
            F.struct(header.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    built = ordered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _state_after(F.transform("turns", lambda t: t["role"]), template).alias("end_state"),
        F.flatten(F.transform("turns", segments_of)).alias("segments"),
    )
    return built.select(
        "conv_id",
        "n_turns",
        F.col("end_state").isin(*template.accepting).alias("valid"),
        "end_state",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The (role, text) turns of a formatted conversation, read from its text alone."""
    parts = F.split(formatted, "\\Q" + template.close + "\\E", -1)
    bodies = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(template.open) + 1))
    )

    def turn(body: Column) -> Column:
        head = F.substring_index(body, template.header_end, 1)
        text = F.substr(body, F.length(head) + F.lit(len(template.header_end) + 1))
        role = unescaped(F.replace(head, F.lit(template.newline), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"])), "")
