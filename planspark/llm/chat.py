"""Chat formatting from a declarative template, with loss flags (operator 4, native).

A finite-state machine over roles checks the order of turns. Each turn
becomes segments: the opening mark, the escaped text and the closing mark,
each with a loss flag. The formatted conversation is the segments joined.

Control strings inside texts and role names are escaped: every backslash is
doubled, then a backslash is put behind the first character of each control
string. Outside the marks a single backslash therefore stands only there, and
``unescape`` is exact.

Cases: a null text counts as empty, a null role as the empty role; rows order
by turn, then role, then text, null turns first, so ties and repeated rows
have one defined order and are all kept; roles without a mark of their own
keep their name in the generic mark; conversations of an invalid order are
formatted as well, with ``valid`` false and the first offending position; a
null conversation id is a conversation of its own; an empty table gives an
empty result; extra columns are left out. A conversation becomes one value,
so its rows meet in one task, as any result of one row per conversation must.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, control strings, loss roles and the role automaton."""

    open_left: str = "<|"
    open_right: str = "|>\n"
    close: str = "</s>\n"
    control: tuple[str, ...] = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
    )
    final: tuple[str, ...] = field(default=("user", "assistant"))


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column, template: Template = CHAT) -> Column:
    out = text
    for c in reversed(template.control):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def walk(roles: Column, template: Template = CHAT) -> Column:
    """Run the automaton: a struct of the state reached and the first bad position (-1: none)."""
    moves = F.create_map(*[F.lit(x) for a, role, b in template.moves for x in (f"{a} {role}", b)])
    return F.aggregate(
        roles,
        F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at")),
        lambda s, role: F.struct(
            F.coalesce(moves[F.concat_ws(" ", s["state"], role)], role).alias("state"),
            F.when((s["bad"] < 0) & moves[F.concat_ws(" ", s["state"], role)].isNull(), s["at"])
            .otherwise(s["bad"])
            .alias("bad"),
            (s["at"] + 1).alias("at"),
        ),
    )


def format_chats(
    rows: DataFrame, template: Template = CHAT, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``id``, ``segments`` (array of text and loss), ``formatted``, ``valid``, ``bad_turn``."""
    turns = rows.select(
        F.col(id),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = turns.groupBy(id).agg(F.array_sort(F.collect_list("t"), _by_turn).alias("ts"))

    def segments(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        mark = F.concat(F.lit(template.open_left), escape(t["role"], template), F.lit(template.open_right))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), loss.alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    done = walk(F.transform("ts", lambda t: t["role"]), template)
    return (
        chats.select(id, F.flatten(F.transform("ts", segments)).alias("segments"), done.alias("walk"))
        .select(
            id,
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            ((F.col("walk.bad") < 0) & F.col("walk.state").isin(*template.final)).alias("valid"),
            F.col("walk.bad").alias("bad_turn"),
        )
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """Parse a formatted conversation back into its turns (role, text)."""
    chunks = F.split(formatted, re.escape(template.close), -1)
    whole = F.slice(chunks, 1, F.size(chunks) - 1)
    left, right = len(template.open_left), len(template.open_right)

    def turn(chunk: Column) -> Column:
        end = F.instr(chunk, template.open_right)
        return F.struct(
            unescape(F.substring(chunk, F.lit(left + 1), end - left - 1), template).alias("role"),
            unescape(F.substring(chunk, end + right, F.length(chunk)), template).alias("text"),
        )

    return F.transform(whole, turn)


def _by_turn(a: Column, b: Column) -> Column:
    """Order by turn, role and text; nulls first."""

    def three(x: Column, y: Column, rest: Column) -> Column:
        return (
            F.when(x.eqNullSafe(y), rest)
            .when(x.isNull(), -1)
            .when(y.isNull(), 1)
            .when(x < y, -1)
            .otherwise(1)
        )

    return three(a["turn"], b["turn"], three(a["role"], b["role"], three(a["text"], b["text"], F.lit(0))))
