"""Chat formatting by a finite-state machine over roles and a declarative template.

A template gives each role the literals before and after its text and says
whether the text is trained on. The machine walks the turns of a conversation
and says of each whether its role may follow; a turn out of order is formatted
all the same and flagged. Every turn becomes one piece of text with a loss
flag for each segment. Control strings inside texts are escaped with a
backslash, so the output can be parsed back without loss.

Rows are dealt by conversation and sorted by turn, and a partition is read as
a stream that holds one turn at a time, so a conversation of any length needs
no more memory than its longest turn.

Defined results: a null text counts as empty and a null role as the empty
role; roles outside the template get the generic marks with their name; rows
that share conv_id and turn are ordered by role and text and all kept; null
turns come first, and the rows without conv_id form one conversation. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import map_arrow

ESCAPE = "\\"


@dataclass(frozen=True)
class RoleMarks:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Declarative template: marks for each role, generic marks for others, and the order of roles."""

    roles: dict[str, RoleMarks] = field(
        default_factory=lambda: {
            "system": RoleMarks("<<SYS>>", "<</SYS>>"),
            "user": RoleMarks("<s>[INST] ", " [/INST]"),
            "assistant": RoleMarks("<a>", "</s>", True),
        }
    )
    #: The name of any other role stands between these, its text before the last.
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    #: state -> {role: next state}; anything else is out of order.
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def controls(self) -> list[str]:
        """The control strings, longest first."""
        marks = [m for r in self.roles.values() for m in (r.before, r.after)] + list(self.other)
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))


DEFAULT = Template()


class Codec:
    """Escapes, formats and parses by one template."""

    def __init__(self, template: Template = DEFAULT):
        self.t = template
        controls = template.controls()
        if any(ESCAPE in c or not c for c in controls):
            raise ValueError("control strings must not be empty or hold the escape character")
        # a text may also end in the first part of a control string that the marks after it complete
        parts = sorted({c[:k] for c in controls for k in range(1, len(c))}, key=len, reverse=True)
        self._special = re.compile("|".join([re.escape(ESCAPE), *map(re.escape, controls)]) + "|(?:" + "|".join(map(re.escape, parts)) + r")\Z")
        self._escaped = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
        body = r"((?:[^\\]|\\.)*?)"
        turns = [f"(?P<r{k}>){re.escape(m.before)}{body}{re.escape(m.after)}" for k, m in enumerate(template.roles.values())]
        turns.append(f"(?P<other>){re.escape(template.other[0])}{body}{re.escape(template.other[1])}{body}{re.escape(template.other[2])}")
        self._turn = re.compile("|".join(turns), re.DOTALL)

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: ESCAPE + m.group(), text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn: ``(text, loss)``."""
        m = self.t.roles.get(role)
        if m is None:
            name, start, end = self.t.other
            return [(name + self.escape(role) + start, False), (self.escape(text), False), (end, False)]
        return [(m.before, False), (self.escape(text), m.loss), (m.after, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """``(role, text)`` of every turn; raises where the text isn't of this template."""
        out, at, names = [], 0, list(self.t.roles)
        while at < len(formatted):
            m = self._turn.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            if m.group("other") is not None:
                k = self._turn.groupindex["other"]
                out.append((self.unescape(m.group(k + 1)), self.unescape(m.group(k + 2))))
            else:
                role = next(k for k in range(len(names)) if m.group(f"r{k}") is not None)
                out.append((names[role], self.unescape(m.group(self._turn.groupindex[f"r{role}"] + 1))))
            at = m.end()
        return out

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after ``role`` and whether it may follow; a turn out of order counts as if it had come in order."""
        after = self.t.order.get(state, {}).get(role)
        if after is not None:
            return after, True
        return next((s[role] for s in self.t.order.values() if role in s), state), False


SEGMENTS = "conv_id long, seq long, role string, valid boolean, segments array<struct<text:string,loss:boolean>>"
SEGMENTS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("seq", pa.int64()),
        ("role", pa.string()),
        ("valid", pa.bool_()),
        ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
    ]
)


def _in_order(conversations: DataFrame) -> DataFrame:
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, seq, role, valid, segments``: a row per turn, in order within its partition.

    The formatted conversation is the concatenation of the segment texts by
    ``seq``; ``valid`` says whether the role could follow the turns before.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        codec = Codec(template)
        now, state, seq = object(), "start", 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            seqs, valid, segments = [], [], []
            for conv, role, text in zip(ids, roles, texts, strict=True):
                if conv != now:
                    now, state, seq = conv, "start", 0
                state, ok = codec.step(state, role)
                seqs.append(seq)
                valid.append(ok)
                segments.append([{"text": t, "loss": loss} for t, loss in codec.turn(role, text)])
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, seqs, roles, valid, segments), SEGMENTS_ARROW, strict=True)], schema=SEGMENTS_ARROW)

    return map_arrow(_in_order(conversations), run, SEGMENTS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_out_of_order long"
DIGEST_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("n_out_of_order", pa.int64()),
    ]
)


class _Reader:
    """Running digests of one conversation, from its formatted turns alone."""

    def __init__(self, codec: Codec):
        self.codec, self.n, self.loss_chars, self.chars, self.wrong = codec, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segments: list[dict], valid: bool) -> None:
        for role, text in self.codec.parse("".join(s["text"] for s in segments)):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for s in segments:
            self.chars += len(s["text"])
            if s["loss"]:
                text = self.codec.unescape(s["text"])
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.wrong += not valid

    def row(self) -> tuple:
        return (self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.wrong)


def read_back(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of each conversation of ``format_turns``, parsed back from its output.

    Takes the partitions as ``format_turns`` left them; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        codec, now, reader = Codec(template), None, None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGEST_ARROW, strict=True)], schema=DIGEST_ARROW)

        for batch in batches:
            rows = []
            for conv, seq, valid, segments in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if seq == 0:
                    if reader:
                        rows.append((now, *reader.row()))
                    now, reader = conv, _Reader(codec)
                reader.add(segments, valid)
            if rows:
                yield out(rows)
        if reader:
            yield out([(now, *reader.row())])

    return map_arrow(turns, run, DIGEST)
