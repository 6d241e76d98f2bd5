"""Chat formatting: a finite-state machine over roles and a declarative template.

The template marks turns with control strings. Inside roles and texts every
control string is written as a two-character escape, so the output can be
read back without loss. The result keeps the segments with their loss flags;
their concatenation is the formatted conversation.

Defined results: a null text or role is empty; turns sort by (turn, role,
text), null turns first, so repeated rows stay as repeated turns; an empty
table gives an empty result; other columns are ignored. A turn order that the
machine refuses is formatted all the same and has ``valid`` false.

One conversation is one output row, so its turns meet in one task; copies of
a conversation under different ids spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """start + role + sep + text + end for each turn; ``loss_roles`` bear loss."""

    start: str = "### "
    sep: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Control string -> code letter; the escape sign itself comes first.
    escapes: tuple[tuple[str, str], ...] = (("\\", "e"), ("###", "h"), ("</turn>", "t"))
    #: In roles, also what ends a role.
    role_escapes: tuple[tuple[str, str], ...] = (("\\", "e"), ("###", "h"), ("</turn>", "t"), (":", "c"))
    #: state -> role -> next state; the start state is "start".
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


def escape(c: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    sign = escapes[0][0]
    for control, code in escapes:
        c = F.replace(c, F.lit(control), F.lit(sign + code))
    return c


def unescape(c: Column, escapes: tuple[tuple[str, str], ...]) -> Column:
    sign = escapes[0][0]
    for control, code in reversed(escapes):
        c = F.replace(c, F.lit(sign + code), F.lit(control))
    return c


def _machine(turns: Column, t: Template) -> Column:
    """The state after the last turn; "refused" once a role has no move."""
    refused = F.lit("refused")

    def step(state: Column, turn: Column) -> Column:
        out = refused
        for at, by_role in t.moves.items():
            for role, to in by_role.items():
                out = F.when((state == at) & (turn["role"] == role), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(turns, F.lit("start"), step)


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, segments array<struct<text, loss>>, valid."""
    t = template or Template()
    row = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.start), escape(x["role"], t.role_escapes), F.lit(t.sep))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t.escapes).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
        )

    made = grouped.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), _machine(F.col("turns"), t).isin(*t.final).alias("valid"))
    return made.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation again: array<struct<role, text>>."""
    t = template or Template()
    parts = F.split(formatted, _quoted(t.end), -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def read(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(t.start) + 1)), t.sep, 1)
        body = F.substr(part, F.length(role) + F.lit(len(t.start) + len(t.sep) + 1))
        return F.struct(unescape(role, t.role_escapes).alias("role"), unescape(body, t.escapes).alias("text"))

    return F.transform(turns, read)


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """The contract's columns, read back from the formatted text and the loss mask."""
    t = template or Template()
    read = formatted.select(
        "conv_id", "formatted", "valid", parse_formatted(F.col("formatted"), t).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t.escapes)), "").alias("masked"),
    )
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
