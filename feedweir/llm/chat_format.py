"""Chat formatting with a loss mask, in SQL functions alone.

A declarative template names the marks around a turn, the roles, those whose text is trained on, and the
turn orders allowed as a finite-state machine. Each turn becomes three segments: its head, its text and
its tail, each with a loss flag. Control marks inside texts get a backslash after their "<", and such
backslashes one more, so every text can be read back as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    after_role: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a conversation is valid if each step exists and it ends in `accept`.
    steps: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
        }
    )
    first: str = "begin"
    accept: tuple[str, ...] = ("assistant",)


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    """No `<|` is left: every `<`, any backslashes, `|` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line: line feeds, percent signs and marks become %-codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<|"), F.lit("%3C|"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C|"), F.lit("<|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def segments(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Rows conv_id, turn, role, text, segments array<struct<text, loss>>; one row per turn, no shuffle."""
    head = F.concat(F.lit(template.start), escape_role(F.col("role")), F.lit(template.after_role))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.array(part(head, F.lit(False)), part(escape(F.col("text")), F.col("role").isin(*template.loss_roles)), part(F.lit(template.end), F.lit(False)))
    return turns.select("conv_id", "turn", "role", "text", parts.alias("segments"))


def valid_order(roles: Column, template: ChatTemplate = CHATML) -> Column:
    """Run the finite-state machine over an array of roles."""
    moves = [(f"{state}\n{role}", to) for state, by_role in template.steps.items() for role, to in by_role.items()]
    table = F.create_map(*[F.lit(x) for move in moves for x in move])
    end = F.aggregate(roles, F.lit(template.first), lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)), F.lit("")))
    return end.isin(*template.accept)


def format_conversations(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Rows conv_id, formatted, segments, valid.

    Turns are put in order of turn, role and text; a null turn comes first, a null role or text counts as
    empty, rows with a null conv_id form one conversation. Repeated turns are all kept. Extra columns are
    ignored. An invalid order is flagged, not dropped. An empty table gives no rows. One conversation is one
    string here, so it must fit a row; `segments` gives the same per turn, without gathering.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text", "segments")
    grouped = segments(clean, template).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select(
        "conv_id", F.flatten("t.segments").alias("segments"), valid_order(F.col("t.role"), template).alias("valid")
    ).select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments", "valid")


def parsed_turns(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """array<struct<role, text>> read from a formatted string alone."""
    blocks = F.split(formatted, r"\Q" + template.start + r"\E", -1)
    blocks = F.slice(blocks, F.lit(2), F.size(blocks))

    def turn(block: Column) -> Column:
        role = F.substring_index(block, template.after_role, 1)
        begin = F.length(role) + F.lit(len(template.after_role) + 1)
        text = F.substr(block, begin, F.length(block) - begin - F.lit(len(template.end) - 1))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
