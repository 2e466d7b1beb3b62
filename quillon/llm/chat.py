"""Chat formatting: turn order checked by a finite-state machine, text segments with loss flags.

A template is declared as data: the text before and after a turn for each role, which roles are
learned, and which role may follow which. Roles that the template doesn't name get the generic
turn. Control strings begin with ``<``; inside roles and texts ``<`` and the backslash are
escaped by pairs, so the output can always be read back.

Defined results: null text and null role are empty; turns are ordered by turn, role and text
(null first), so ties and repeated rows have one order and all are kept; a null conversation id
is a conversation of its own; an empty table gives no rows; further columns are ignored. A
conversation that breaks the turn order is formatted all the same and carries ``order_ok`` false.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is escaped, and by which pair. Each pair starts with the escape character, so reading
# back replaces the pairs in reverse order, the escape character's own pair last.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))


@dataclass(frozen=True)
class Template:
    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    # State machine: the role last seen ("" at the start) and the roles that may come next.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escaped(text: Column) -> Column:
    for plain, pair in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescaped(text: Column) -> Column:
    for plain, pair in reversed(ESCAPES):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def format_conversations(
    turns: DataFrame,
    template: Template = CHAT,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row for each conversation: conv_id, order_ok, segments (text, loss) in order.

    The concatenated segment texts are the formatted conversation.
    """
    before, after = template.opening.split("{role}")
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))

    def segments(said: Column) -> Column:
        return F.array(
            F.struct(
                F.concat(F.lit(before), escaped(said["role"]), F.lit(after)).alias("text"),
                F.lit(False).alias("loss"),
            ),
            F.struct(
                escaped(said["text"]).alias("text"),
                said["role"].isin(*template.learned).alias("loss"),
            ),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
        )

    allowed = F.array(
        *(F.lit(f"{a}\n{b}") for a, nexts in template.follows.items() for b in nexts)
    )
    # The machine's state is the role last seen; a step it doesn't know leads to a dead state.
    dead = F.lit("\x00")
    end = F.aggregate(
        F.col("said"),
        F.lit(""),
        lambda state, said: F.when(
            F.array_contains(allowed, F.concat(state, F.lit("\n"), said["role"])), said["role"]
        ).otherwise(dead),
    )
    return talks.select(
        "conv_id",
        end.isin(*template.last).alias("order_ok"),
        F.flatten(F.transform("said", segments)).alias("segments"),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    before, after = template.opening.split("{role}")
    # Raw control strings never occur inside escaped roles and texts.
    pieces = F.split(formatted, f"\\Q{template.closing}\\E")
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        return F.struct(
            unescaped(
                F.substring_index(F.substr(piece, F.lit(len(before) + 1)), after, 1)
            ).alias("role"),
            unescaped(
                F.substr(piece, F.instr(piece, after) + F.lit(len(after)))
            ).alias("text"),
        )

    return F.transform(turns, turn)


def read_loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescaped(s["text"])), "")


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")
