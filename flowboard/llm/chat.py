"""Chat formatting: a declarative template, a role state machine, text segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPE = "\\"
START_STATE = "start"


@dataclass(frozen=True)
class Template:
    """How turns are written. Each role has an opening mark and whether its text carries loss.

    `turns` maps a role to (opening mark, loss flag). A role outside it is written between
    `other_open` and `other_close`, a null role as `no_role`; neither carries loss. `end` closes every
    turn. `steps` lists the allowed moves of the state machine: (state before, role); the state
    after a move is the role. `finals` are the states a conversation may end in.
    """

    turns: dict[str, tuple[str, bool]] = field(default_factory=lambda: {
        "system": ("[SYS]", False), "user": ("[INST]", False), "assistant": ("[/INST]", True)})
    other_open: str = "[ROLE]"
    other_close: str = "[/ROLE]"
    no_role: str = "[NOROLE]"
    end: str = "</s>"
    steps: tuple[tuple[str, str], ...] = (
        (START_STATE, "system"), (START_STATE, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    finals: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [m for m, _ in self.turns.values()] + [self.other_open, self.other_close, self.no_role, self.end]

    def __post_init__(self):
        marks = self.controls()
        for m in marks:
            if not m or _ESCAPE in m or any(m != o and o in m for o in marks) or marks.count(m) > 1:
                raise ValueError(f"mark {m!r} is empty, repeated, holds another mark or the escape character")
            if any(m.endswith(o[:n]) for o in marks for n in range(1, len(o)) if not (m == o and n == len(o))):
                raise ValueError(f"a mark begins as {m!r} ends, so marks could not be told apart")


def escape(text: Column, template: Template) -> Column:
    """Replace each control string by an escape of two or three characters; reversible."""
    out = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e;"))
    for i, mark in enumerate(template.controls()):
        out = F.replace(out, F.lit(mark), F.lit(f"{_ESCAPE}{i};"))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for i, mark in enumerate(template.controls()):
        out = F.replace(out, F.lit(f"{_ESCAPE}{i};"), F.lit(mark))
    return F.replace(out, F.lit(_ESCAPE + "e;"), F.lit(_ESCAPE))


def _order_fault(roles: Column, template: Template) -> Column:
    """0 if the state machine accepts, else the first turn (from 1) it stops at; turns + 1 for a bad end."""
    moves = [f"{a}\u0001{b}" for a, b in template.steps]
    step = lambda s, r: F.when(
        s["fault"] > 0, s).otherwise(F.struct(
            F.coalesce(r, F.lit("")).alias("state"), (s["at"] + 1).alias("at"),
            F.when(F.concat(s["state"], F.lit("\u0001"), F.coalesce(r, F.lit(""))).isin(moves), 0).otherwise(s["at"] + 1).alias("fault")))
    first = F.struct(F.lit(START_STATE).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("fault"))
    return F.aggregate(roles, first, step, lambda s: F.when(s["fault"] > 0, s["fault"]).when(s["state"].isin(*template.finals), 0).otherwise(s["at"] + 1))


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, text, segments, order_fault.

    `segments` lists (text, loss) in order; `text` is their concatenation. An opening mark, a text
    and the closing mark are segments of their own, so a loss segment holds one escaped text of a
    role with loss and nothing else. `order_fault` is the first turn that the state machine does not accept (from 1;
    one past the last turn where the conversation ends too early), else 0: wrong orders are
    reported and still written whole. Rows are sorted by turn (nulls first), then role, then text;
    repeated rows are repeated turns; a null text is empty; rows with a null conv_id form one conversation.
    """
    template = template or Template()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), text.alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def mark(role: Column) -> Column:
        out = F.when(role.isNull(), F.lit(template.no_role))
        for name, (opening, _) in template.turns.items():
            out = out.when(role == name, F.lit(opening))
        return out.otherwise(F.concat(F.lit(template.other_open), escape(role, template), F.lit(template.other_close)))

    learnt = [name for name, (_, loss) in template.turns.items() if loss]
    loss = lambda role: F.coalesce(role.isin(*learnt), F.lit(False)) if learnt else F.lit(False)
    piece = lambda value, flag: F.struct(value.alias("text"), flag.alias("loss"))
    segments = F.flatten(F.transform("rows", lambda r: F.array(
        piece(mark(r["role"]), F.lit(False)), piece(escape(r["text"], template), loss(r["role"])), piece(F.lit(template.end), F.lit(False)))))
    return whole.select("conv_id", segments.alias("segments"), _order_fault(F.col("rows.role"), template).alias("order_fault")).select(
        "conv_id", F.concat_ws("", F.col("segments.text")).alias("text"), "segments", "order_fault")


def parse_chats(text: Column, template: Template | None = None) -> Column:
    """The turns (role, text) in a formatted text: the way back from `format_chats`."""
    template = template or Template()
    bodies = F.split(text, F.concat(F.lit(r"\Q"), F.lit(template.end), F.lit(r"\E")))
    bodies = F.slice(bodies, F.lit(1), F.size(bodies) - 1)

    def turn(body: Column) -> Column:
        after = lambda mark: body.substr(F.lit(len(mark) + 1), F.length(body))
        close = F.instr(body, template.other_close)
        role = F.when(body.startswith(template.no_role), F.lit(None).cast("string"))
        said = F.when(body.startswith(template.no_role), after(template.no_role))
        for name, (opening, _) in template.turns.items():
            role, said = role.when(body.startswith(opening), F.lit(name)), said.when(body.startswith(opening), after(opening))
        begin = len(template.other_open) + 1
        role = role.otherwise(unescape(body.substr(F.lit(begin), close - begin), template))
        said = said.otherwise(body.substr(close + len(template.other_close), F.length(body)))
        return F.struct(role.alias("role"), unescape(said, template).alias("text"))

    return F.transform(bodies, turn)


def digest_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Lengths and digests read back from formatted text and loss segments alone."""
    template = template or Template()
    turns = parse_chats(F.col("text"), template)
    learnt = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return formatted.select("conv_id", "text", "order_fault", turns.alias("turns"), learnt.alias("learnt")).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(lines).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), sha(F.col("learnt")).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"), F.col("order_fault").cast("bigint").alias("order_fault"))
