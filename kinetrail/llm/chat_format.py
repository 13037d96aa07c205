"""Chat formatting from a declarative template.

A :class:`Template` says how each role opens and closes and whether its text is under the loss mask, which role may
follow which (a finite-state machine), and the escape mark. A conversation's turns, in order, run through the machine
and become segments ``(text, loss)``; joined, the segments are the formatted string. Control strings inside texts are
escaped reversibly, so the string can always be read back.

All of it is DataFrame functions: one grouping by conversation, then functions on each conversation's array of turns.
A formatted conversation is one string, hence one row; nothing larger than a conversation is ever held together.

Defined results
* turns are ordered by (turn, role, text), so ties and repeated rows have a fixed order; all of them are kept;
* null text or role counts as the empty string; a role without marks of its own gets the template's ``other`` marks;
* conversations in a wrong order are formatted too, with ``valid`` false and ``bad_turn`` the place (from 0) of the
  first turn that the machine refuses;
* rows with a null conversation id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import quoted


@dataclass(frozen=True)
class Template:
    #: role: (open mark, close mark, is its text under the loss mask?)
    roles: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<s>", "</s>", True),
        }
    )
    #: any other role stands between these two, then its text, then the close mark
    other: tuple = ("<|", "|>", "<|end|>")
    #: state: {role: next state}; states in ``final`` may end a conversation
    machine: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple = ("assistant", "user")
    #: a mark that texts rarely hold; where they do, it's escaped as well
    escape: str = "␛"

    @property
    def controls(self) -> list[str]:
        marks = {m for opens, closes, _ in self.roles.values() for m in (opens, closes)} | set(self.other[:2])
        return sorted(marks, key=lambda m: (-len(m), m))


DEFAULT = Template()


def escaped(text: Column, t: Template = DEFAULT) -> Column:
    """No control string is left: each is replaced by the escape mark and a letter; the mark itself by mark and 0."""
    text = F.replace(text, F.lit(t.escape), F.lit(t.escape + "0"))
    for i, mark in enumerate(t.controls):
        text = F.replace(text, F.lit(mark), F.lit(t.escape + chr(65 + i)))
    return text


def unescaped(text: Column, t: Template = DEFAULT) -> Column:
    for i, mark in enumerate(t.controls):
        text = F.replace(text, F.lit(t.escape + chr(65 + i)), F.lit(mark))
    return F.replace(text, F.lit(t.escape + "0"), F.lit(t.escape))


def _segments(turn: Column, t: Template) -> Column:
    def three(opens, closes, loss):
        parts = ((opens, False), (escaped(turn["text"], t), loss), (closes, False))
        return F.array(*[F.struct(x.alias("text"), F.lit(flag).alias("loss")) for x, flag in parts])

    found = None
    for role, (opens, closes, loss) in t.roles.items():
        part = three(F.lit(opens), F.lit(closes), loss)
        found = F.when(turn["role"] == role, part) if found is None else found.when(turn["role"] == role, part)
    rest = three(F.concat(F.lit(t.other[0]), escaped(turn["role"], t), F.lit(t.other[1])), F.lit(t.other[2]), False)
    return rest if found is None else found.otherwise(rest)


def _run_machine(turns: Column, t: Template) -> Column:
    """(state, place): the state after all turns, or "refused" and the place of the first refused turn."""
    moves = [F.lit(x) for state, to in t.machine.items() for role, after in to.items() for x in (f"{state}\n{role}", after)]
    table = F.create_map(*moves)
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("place"))

    def step(s, turn):
        after = F.coalesce(F.try_element_at(table, F.concat(s["state"], F.lit("\n"), turn["role"])), F.lit("refused"))
        refused = s["state"] == "refused"
        return F.struct(
            F.when(refused, F.lit("refused")).otherwise(after).alias("state"),
            F.when(refused | (after == "refused"), s["place"]).otherwise(s["place"] + 1).alias("place"),
        )

    return F.aggregate(turns, start, step)


def chat_format(rows: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, valid, bad_turn, n_turns, segments array<struct<text, loss>>."""
    empty = F.lit("")
    turn = F.struct(quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col), empty).alias("role"), F.coalesce(quoted(text_col), empty).alias("text"))
    convs = rows.groupBy(quoted(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ran = convs.withColumn("ran", _run_machine(F.col("turns"), template))
    valid = F.col("ran.state").isin(*template.final)
    return ran.select(
        "conv_id",
        valid.alias("valid"),
        F.when(F.col("ran.state") == "refused", F.col("ran.place")).alias("bad_turn"),
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", lambda x: _segments(x, template))).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")


def read_back(text: Column, t: Template = DEFAULT) -> Column:
    """The turns of a formatted string, array<struct<role, text>>: the inverse of :func:`chat_format`."""
    opens = "|".join([re.escape(o) for o, _, _ in t.roles.values()] + [f"{re.escape(t.other[0])}.*?{re.escape(t.other[1])}"])
    closes = "|".join([re.escape(c) for _, c, _ in t.roles.values()] + [re.escape(t.other[2])])
    pattern = F.lit(f"(?s)({opens})(.*?)(?:{closes})")

    def role(mark):
        found = None
        for name, (o, _, _) in t.roles.items():
            found = F.when(mark == o, F.lit(name)) if found is None else found.when(mark == o, F.lit(name))
        inner = F.substring(mark, F.lit(len(t.other[0]) + 1), F.char_length(mark) - (len(t.other[0]) + len(t.other[1])))
        return unescaped(inner, t) if found is None else found.otherwise(unescaped(inner, t))

    marks, texts = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.zip_with(marks, texts, lambda m, x: F.struct(role(m).alias("role"), unescaped(x, t).alias("text")))
