"""Chat formatting: a finite-state machine over roles, and a declarative template of marked, flagged segments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START = "start"


@dataclass(frozen=True)
class Template:
    """turns: role -> (marker before, marker after, whether its text is under the loss mask).

    A role that `turns` does not name goes between `other` markers, its escaped name in front. `follows` is the machine:
    role -> roles that may come next, from START; a conversation may end after a role of `ends`.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("[OUT]", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return sorted({self.begin, *self.other, *(m for a, b, _ in self.turns.values() for m in (a, b))}, key=len, reverse=True)


ESCAPE = "\\"


class Formatter:
    def __init__(self, template: Template):
        if any(len(c) < 2 or ESCAPE in c for c in template.controls):
            raise ValueError("markers have two characters at least and no backslash")
        self.template = template
        self.control = re.compile("|".join(re.escape(c) for c in template.controls))
        self.opening = {a: (role, b, loss) for role, (a, b, loss) in template.turns.items()}

    def escape(self, text: str) -> str:
        """Doubles backslashes and puts one inside each control string, so that none is left."""
        return self.control.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text

    def check(self, roles: list[str]) -> str | None:
        """None, or what is wrong with the order of turns."""
        state = START
        for k, role in enumerate(roles):
            if role not in self.template.follows.get(state, ()):
                return f"turn {k}: {role} after {state}"
            state = role
        return None if state in self.template.ends else f"ends after {state}"

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        out = [(self.template.begin, False)]
        for role, text in turns:
            if role in self.template.turns:
                before, after, loss = self.template.turns[role]
            else:
                a, b, after = self.template.other
                before, loss = a + self.escape(role) + b, False
            out += [(before, False), (self.escape(text), loss), (after, False)]
        return out

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns, from the formatted text alone."""
        at, out = len(self.template.begin), []
        a, b, c = self.template.other
        while at < len(formatted):
            m = self.control.match(formatted, at)
            if not m:
                raise ValueError(f"no marker at {at}")
            at = m.end()
            if m[0] == a:
                till = formatted.index(b, at)
                role, after, at = self.unescape(formatted[at:till]), c, till + len(b)
            else:
                role, after, _ = self.opening[m[0]]
            till = formatted.index(after, at)
            out.append((role, self.unescape(formatted[at:till])))
            at = till + len(after)
        return out


def format_conversations(df: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, valid, error, formatted, segments (array of text and loss flag), in order of turn.

    Null texts and roles are empty; equal turns are ordered by role, then text; null turns come first; repeated rows
    stay as turns. A conversation whose order of turns the machine refuses is formatted all the same, with valid false
    and the reason. Other columns do not matter. An empty table gives an empty table. A conversation's formatted text is
    one value, so its turns meet in one task.
    """
    template = template or Template()
    named = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x")).alias("said"))
    whole = named.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    turns = whole.select("conv_id", F.col("said.r").alias("roles"), F.col("said.x").alias("texts"))
    segment = T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())])
    schema = T.StructType([turns.schema["conv_id"], T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("formatted", T.StringType()), T.StructField("segments", T.ArrayType(segment))])

    def run(batches):
        formatter = Formatter(template)
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            errors, formatted, segments = [], [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = formatter.segments(list(zip(roles, texts, strict=True)))
                errors.append(formatter.check(roles))
                formatted.append("".join(x for x, _ in parts))
                segments.append([{"text": x, "loss": f} for x, f in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string()), pa.array(formatted, pa.string()), pa.array(segments, kind)], names=schema.names)

    return turns.mapInArrow(run, schema)


def read_back(df: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, from `formatted` and the flags of `segments`.

    loss_text: what is under the mask, unescaped, with nothing between.
    """
    template = template or Template()
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([df.schema["conv_id"], T.StructField("turns", T.ArrayType(turn)), T.StructField("loss_text", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        formatter = Formatter(template)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, losses, chars = [], [], []
            for formatted, segments in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append([{"role": r, "text": x} for r, x in formatter.parse(formatted)])
                at, masked = 0, []
                for s in segments:
                    if s["loss"]:
                        masked.append(formatter.unescape(formatted[at : at + len(s["text"])]))
                    at += len(s["text"])
                losses.append("".join(masked))
                chars.append(len(formatted))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(losses, pa.string()), pa.array(chars, pa.int64())], names=schema.names)

    return df.select("conv_id", "formatted", "segments").mapInArrow(run, schema)
