"""Chat formatting by a finite-state machine over roles.

A declarative ``Template`` names, for each role, the strings that open and close
a turn and whether the loss counts its text, and the moves that the machine
allows.  Turns of one conversation are streamed in order (turn, then role, then
text; nulls first), so a conversation of any length needs a constant amount of
memory.  A backslash goes before each character of a text that could begin a
control string and before each backslash, so control strings inside texts can't
be taken for marks and reading back restores each text exactly.

Defined cases: null text is empty; null role is the empty role; a role without
marks of its own gets the generic ones; a null conv_id is a conversation of its
own; equal turns keep every row; a turn order that the machine doesn't allow is
formatted all the same, ``valid`` being false from that turn on.  Texts of any
length are one segment each, whole.  An empty table gives no rows.  Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.runtime import ship


@dataclass(frozen=True)
class Template:
    """marks: role -> (opens, closes). other: the same for any other role, {role} standing for its name."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str] = ("<role>{role}</role>", "</turn>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )

    @property
    def leads(self) -> str:
        """The first characters of all control strings."""
        marks = [*self.marks.values(), self.other]
        found = {s.strip("\n ")[0] for pair in marks for s in pair}
        return "".join(sorted(found | {self.other[0].partition("{role}")[2][:1] or "\\"}))

    def escape(self, text: str) -> str:
        return re.sub(rf"[\\{re.escape(self.leads)}]", r"\\\g<0>", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def opens_closes(self, role: str) -> tuple[str, str]:
        if role in self.marks:
            return self.marks[role]
        return self.other[0].replace("{role}", self.escape(role)), self.other[1]

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The (text, loss) segments of one turn: mark, content, mark."""
        opens, closes = self.opens_closes(role)
        return [(opens, False), (self.escape(text), role in self.loss_roles), (closes, False)]

    def reader(self) -> re.Pattern:
        """Matches one formatted turn; groups r<i> and t<i> hold its role, if generic, and its text."""
        plain = rf"(?:[^\\{re.escape(self.leads)}]|\\.)*"
        forms = [rf"{re.escape(a)}(?P<t{i}>{plain}){re.escape(z)}" for i, (a, z) in enumerate(self.marks.values())]
        before, _, after = self.other[0].partition("{role}")
        forms.append(rf"{re.escape(before)}(?P<role>{plain}){re.escape(after)}(?P<text>{plain}){re.escape(self.other[1])}")
        return re.compile("|".join(forms), re.DOTALL)

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The turns of a formatted text; raises ValueError if it isn't one."""
        reader, roles, at = self.reader(), list(self.marks), 0
        while at < len(formatted):
            if not (found := reader.match(formatted, at)):
                raise ValueError(f"no turn at character {at}")
            if found["text"] is not None:
                yield self.unescape(found["role"]), self.unescape(found["text"])
            else:
                i = next(i for i in range(len(roles)) if found[f"t{i}"] is not None)
                yield roles[i], self.unescape(found[f"t{i}"])
            at = found.end()


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per turn, in order within a conversation: conv_id, turn, role, place (from 0), state, valid, segments.

    The rows of a conversation come out in one partition, sorted.
    """
    template = template or Template()
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        state, valid, place = template.start, True, 0
        for batch in batches:
            places, states, valids, segments = [], [], [], []
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv, role, text in zip(ids, roles, texts, strict=True):
                if conv != now:
                    now, state, valid, place = conv, template.start, True, 0
                role = role or ""
                to = template.moves.get((state, role))
                valid = valid and to is not None
                state = to or role
                places.append(place)
                place += 1
                states.append(state)
                valids.append(valid)
                segments.append([{"text": s, "loss": loss} for s, loss in template.segments(role, text or "")])
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(places, pa.int64()), pa.array(states, pa.string()), pa.array(valids, pa.bool_()), pa.array(segments, kind)],
                names=["conv_id", "turn", "role", "place", "state", "valid", "segments"],
            )

    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, place bigint, state string, valid boolean, segments {SEGMENTS}")


def read_back(formatted: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """Per conversation, from the output of ``format_turns`` alone: counts and digests of what its segments say.

    Rows are dealt and sorted again unless they come ``in_order``, straight from ``format_turns`` in the same plan; a stored
    table keeps no order that could be relied on.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        now: object = run
        id_type = None
        count = chars = loss_chars = 0
        valid, all_turns, loss = True, hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, ok, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != now:
                    if now is not run:
                        done.append((now, count, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    now, count, chars, loss_chars, valid = conv, 0, 0, 0, True
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                text = "".join(s["text"] for s in segments)
                chars += len(text)
                valid = valid and ok
                for role, said in template.read(text):
                    count += 1
                    all_turns.update(f"{role}\n{said}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = template.unescape(s["text"])
                        loss_chars += len(plain)
                        loss.update(plain.encode())
                if len(done) >= 4096:
                    yield table(done)
                    done = []
        if now is not run:
            done.append((now, count, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
        if done:
            yield table(done)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return formatted.select("conv_id", "valid", "segments").mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    )


def conversations_of(segments: DataFrame) -> DataFrame:
    """All segments as rows: conv_id, turn, role, segment, text, loss."""
    return segments.select("conv_id", "turn", "role", F.posexplode("segments").alias("segment", "s")).select("conv_id", "turn", "role", "segment", "s.text", "s.loss")
