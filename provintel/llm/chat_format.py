"""Chat formatting: a finite-state machine over roles walks each conversation and emits text segments with loss flags.

A declarative Template says what stands before and after a turn of each role and which roles carry loss. Control strings
inside texts are escaped with one more backslash after their first character. Segments are numbered within their
conversation, so they can be written, read and ordered again. read_back() joins their texts and parses those alone, by the
template's marks: what it finds proves that the escape is sound.

Rows are hashed by conversation, sorted by turn and streamed; a task holds one turn at a time, so a conversation of any
length fits. Its turns meet in one task, as the digest of an ordered text is sequential.

Defined cases: null text or role is an empty string; turns that tie are ordered by role, then text; repeated rows are
turns of their own; unknown roles get a generic mark; an order that the machine refuses is still formatted and marked
valid = false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT_SCHEMA = "conv_id long, segment long, kind string, text string, loss boolean, valid boolean"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
BATCH_CHARS = 1 << 21


@dataclass(frozen=True)
class Template:
    """Marks by role, the mark of other roles, loss roles, and the machine: state -> role -> next state."""

    begin: str = "<s>"
    marks: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
            "user": ("[INST] ", " [/INST]"),
            "assistant": (" ", " </s>"),
        }
    )
    other: tuple = ("<<ROLE>>", "<</ROLE>>", " </s>")
    loss_roles: tuple = ("assistant",)
    controls: str = r"/?INST\]|/?s>|</?SYS>>|</?ROLE>>"
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: tuple = ("assistant",)

    def escape(self, text: str) -> str:
        return re.sub(rf"([\[<])(\\*)({self.controls})", r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return re.sub(rf"([\[<])\\(\\*)({self.controls})", r"\1\2\3", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        before, after = self.marks.get(role) or (self.other[0] + self.escape(role) + self.other[1], self.other[2])
        return [(before, False), (self.escape(text), role in self.loss_roles), (after, False)]

    def read_turn(self, text: str) -> tuple[str, str, int] | None:
        """Role, text and length of the turn that formatted text starts with; None if it has no whole turn yet."""
        before, middle, after = self.other
        if text.startswith(before):
            at = text.find(middle, len(before))
            end = text.find(after, at + len(middle)) if at >= 0 else -1
            return None if end < 0 else (self.unescape(text[len(before) : at]), self.unescape(text[at + len(middle) : end]), end + len(after))
        for role, (before, after) in self.marks.items():
            if text.startswith(before):
                end = text.find(after, len(before))
                return None if end < 0 else (role, self.unescape(text[len(before) : end]), end + len(after))
        return None


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            yield from zip(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += 64 + (len(r[text_at] or "") if text_at is not None else 64)
        if chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _emit(rows: Iterator[tuple], template: Template) -> Iterator[tuple]:
    now, state, valid, any_row, k = None, "start", True, False, 0
    for conv, role, text in rows:
        role, text = role or "", text or ""
        if not any_row or conv != now:
            if any_row:
                yield now, k, "end", "", False, valid and state in template.final
            now, state, valid, any_row, k = conv, "start", True, True, 1
            yield conv, 0, "begin", template.begin, False, True
        follow = template.moves.get(state, {}).get(role)
        valid, state = valid and follow is not None, follow or (role if role in template.moves else state)
        for kind, (piece, loss) in zip(("before", "text", "after"), template.segments(role, text), strict=True):
            yield conv, k, kind, piece, loss, valid
            k += 1
    if any_row:
        yield now, k, "end", "", False, valid and state in template.final


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Numbered segments of each conversation: kind, text, loss flag; the row of kind end says if it is valid."""
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(_emit(_rows(batches, "conv_id", "role", "text"), template), schema, 3)

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SEGMENT_SCHEMA)


def _digest(rows: Iterator[tuple], template: Template) -> Iterator[tuple]:
    """Digests of conversations whose segments come in order. Turns are found in the joined text; flags only say what carries loss."""

    def torn(conv: int) -> ValueError:
        return ValueError(f"conversation {conv}: formatted text can't be read back")

    now, any_row = None, False
    for conv, text, loss, valid in rows:
        if not any_row or conv != now:
            if any_row:
                if rest or not begun:
                    raise torn(now)
                yield now, n, turns.hexdigest(), loss_chars, lost.hexdigest(), chars, ok
            now, any_row, begun = conv, True, False
            n, turns, lost, loss_chars, chars, rest = 0, hashlib.sha256(), hashlib.sha256(), 0, 0, ""
        ok = valid
        chars += len(text)
        rest += text
        if loss:
            plain = template.unescape(text)
            loss_chars += len(plain)
            lost.update(plain.encode())
        if not begun and rest.startswith(template.begin):
            begun, rest = True, rest[len(template.begin) :]
        while begun and (turn := template.read_turn(rest)):
            turns.update(f"{turn[0]}\n{turn[1]}\n".encode())
            n, rest = n + 1, rest[turn[2] :]
    if any_row:
        if rest or not begun:
            raise torn(now)
        yield now, n, turns.hexdigest(), loss_chars, lost.hexdigest(), chars, ok


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Orders segments by their numbers and parses their joined text into turns again; one row of digests per conversation."""
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(_digest(_rows(batches, "conv_id", "text", "loss", "valid"), template), schema, None)

    ordered = segments.select("conv_id", "segment", "text", "loss", "valid").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, DIGEST_SCHEMA)
