"""Chat formatting: a finite-state machine over roles and a declarative
template, in DataFrame functions alone.

A ``Template`` states how each role's turn is framed, which roles are trained
on, and which role may follow which. A conversation becomes a list of segments
(text, loss flag): for each turn its opening mark, its escaped text and its
closing mark. Control characters inside texts are escaped reversibly, so a
text can never be taken for a mark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Declarative chat template.

    ``marks`` frames a role by its opening mark; ``close`` ends every turn;
    ``loss`` names the roles whose text is trained on; ``follows`` maps a state
    (the role of the turn before; ``""`` at the start) to the roles allowed
    next; ``final`` names the roles a whole conversation may end with. Every
    mark begins with ``#`` or ``<``, which escaped texts do not contain.
    """

    marks: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Other: "
    close: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


#: Escaped form of each control character.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("#", "\\h"))


def escape(col: Column) -> Column:
    for plain, coded in ESCAPES:
        col = F.replace(col, F.lit(plain), F.lit(coded))
    return col


def unescape(col: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        col = F.replace(col, F.lit(coded), F.lit(plain))
    return col


def _mark(role: Column, t: Template) -> Column:
    out = None
    for name, mark in t.marks.items():
        out = (F.when if out is None else out.when)(role == name, F.lit(mark))
    # a role without a mark of its own is named inside the mark of the others
    named = F.concat(F.lit(t.other), escape(role), F.lit("<|>"))
    return named if out is None else out.otherwise(named)


def _fold_states(turns: Column, t: Template) -> Column:
    """The machine's run over the roles: last state and the number of turns
    that no transition allows. A turn that is not allowed still sets the state."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, bs in t.follows.items() for b in bs] or [F.lit("")])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("bad"))
    return F.aggregate(
        turns, start,
        lambda acc, x: F.struct(
            x["role"].alias("state"),
            (acc["bad"] + F.when(F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), x["role"])), 0).otherwise(1)).alias("bad")))


def format_chats(turns: DataFrame, template: Template | None = None, conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid`` (the machine accepts
    its roles), ``n_bad_turns``, and ``segments``, an array of (text, loss) in
    order, three for each turn: opening mark, escaped text, closing mark.

    Turns are ordered by (turn, role, text), NULL turns first, so that ties and
    repeated rows have one result; every row is a turn. NULL text is empty, a
    NULL role is the role ``""``, a NULL conv_id is a conversation of its own.
    Roles without a mark use the template's ``other`` mark and are not valid.
    No rows give no rows. A conversation is one row of one task, which bounds
    its size by the memory of a task (and by 2 GB). Other columns are dropped,
    whatever their name.
    """
    t = template or Template()
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    run = grouped.select("conv_id", "turns", _fold_states(F.col("turns"), t).alias("run"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        segment(_mark(x["role"], t), no),
        segment(escape(x["text"]), x["role"].isin(*t.loss)),
        segment(F.lit(t.close), no))))
    return run.select(
        "conv_id",
        ((F.col("run.bad") == 0) & F.col("run.state").isin(*t.final)).alias("valid"),
        F.col("run.bad").alias("n_bad_turns"),
        segments.alias("segments"))


def formatted_text(segments: Column) -> Column:
    """The whole formatted conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    t = template or Template()
    bodies = F.slice(F.split(formatted, t.close.replace("|", "\\|")), 1, F.size(F.split(formatted, t.close.replace("|", "\\|"))) - 1)

    def parse(body: Column) -> Column:
        named = F.substring_index(body, "<|>", 1)
        role = unescape(F.substr(named, F.lit(len(t.other) + 1)))
        text = F.substr(body, F.length(named) + 4)
        for name, mark in t.marks.items():
            hit = F.startswith(body, F.lit(mark))
            role = F.when(hit, F.lit(name)).otherwise(role)
            text = F.when(hit, F.substr(body, F.lit(len(mark) + 1))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, parse)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
