"""Chat formatting (5): a finite-state machine over roles, and text segments with loss flags from a declarative template.

Rows of a conversation come sorted by turn and are streamed, so a conversation of any length takes bounded memory; the
only shuffle deals rows by conversation. A conversation's rows have to be in order for its digest, so one conversation
is one task's work; its state is a few hashes, however long it is.

Texts are escaped reversibly: the template's control strings all begin with one of its `openers`, and every opener in a
text is followed by ESCAPE in the output. A text thus never holds a control string, and removing ESCAPE after an opener
gives the text back.

Defined cases: a null text is empty, a null role is the empty role; a null conv_id is a conversation of its own; equal
turns are taken in order of role, then text; unknown roles are formatted like others but make the conversation
invalid; extra columns are dropped; an empty table gives no segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "​"


@dataclass(frozen=True)
class Template:
    """How a turn is laid out, which roles bear loss, and which role may follow which ("" is the start)."""

    name: str
    turn: tuple[str, ...] = ("<|im_start|>", "{role}", "\n", "{text}", "<|im_end|>", "\n")
    openers: tuple[str, ...] = ("<|",)
    loss_roles: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"user", "assistant"})

    def escape(self, text: str) -> str:
        for x in self.openers:
            text = text.replace(x, x + ESCAPE)
        return text

    def unescape(self, text: str) -> str:
        for x in self.openers:
            text = text.replace(x + ESCAPE, x)
        return text

    def segments(self, role: str, text: str) -> list[tuple[str, bool, bool]]:
        """(string, bears loss, stands for the text) of one turn. A role is escaped and its line breaks are too."""
        out = []
        for x in self.turn:
            if x == "{text}":
                out.append((self.escape(text), role in self.loss_roles, True))
            elif x == "{role}":
                out.append((self.escape(role).replace("\n", "\n" + ESCAPE), False, False))
            else:
                out.append((x, False, False))
        return out


CHAT = Template("chat-1")
SEGMENTS = "conv_id bigint, segment bigint, text string, loss boolean, valid_so_far boolean, last boolean"


class Machine:
    """Walks over roles; `valid` stays true while each may follow the one before."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.valid = template, "", True

    def step(self, role: str) -> bool:
        self.valid = self.valid and role in self.template.follows.get(self.state, frozenset())
        self.state = role
        return self.valid

    def end(self) -> bool:
        return self.valid and self.state in self.template.ends


def _rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


class _Out:
    """Collects rows into record batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.held += size + 64
        return self.held > 4 << 20

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


_SEGMENT_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("valid_so_far", pa.bool_()), ("last", pa.bool_())])


def _emitter(template: Template):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, machine, n = _Out(_SEGMENT_SCHEMA), object(), None, 0
        held: list[tuple] = []  # the turn before, as only the next row tells whether it is the last

        def put(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n
            for key, role, text in held:
                ok = machine.step(role)
                ok = machine.end() if last else ok
                parts = template.segments(role, text)
                for i, (x, loss, _) in enumerate(parts):
                    if out.add((key, n, x, loss, ok, last and i == len(parts) - 1), len(x)):
                        yield out.take()
                    n += 1
            held.clear()

        for key, role, text in _rows(batches, "conv_id", "role", "text"):
            yield from put(key != conv)
            if key != conv:
                conv, machine, n = key, Machine(template), 0
            held.append((key, role or "", text or ""))
        yield from put(True)
        yield out.take()

    return emit


def format_segments(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Segments of all conversations (conv_id, turn, role, text), each conversation's in order within one partition.

    Row `last` of a conversation says in valid_so_far whether the conversation is valid as a whole.
    """
    source = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    dealt = source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_emitter(template), SEGMENTS)


def parse_turns(pieces: Iterable[tuple[str, bool]], template: Template = CHAT) -> Iterator[tuple[str, str, bool]]:
    """Reads (role, text, loss) of each turn back from formatted strings alone; loss flags are those of the text."""
    start, end = template.turn[0], template.turn[4]
    role, text, loss, state = [], [], False, "out"
    for x, flag in pieces:
        if state == "out" and x == start:
            role, text, loss, state = [], [], False, "role"
        elif state == "role" and x == template.turn[2]:
            state = "text"
        elif state == "role":
            role.append(x)
        elif state == "text" and x == end:
            yield template.unescape("".join(role).replace("\n" + ESCAPE, "\n")), template.unescape("".join(text)), loss
            state = "out"
        elif state == "text":
            text.append(x)
            loss = loss or flag
    if state != "out":
        raise ValueError("a turn has no end")


_DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


def _reader(template: Template):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(_DIGEST_SCHEMA)
        rows = _rows(batches, "conv_id", "text", "loss", "valid_so_far", "last")
        for first in rows:
            chars, valid = 0, False

            def pieces(row=first):
                nonlocal chars, valid
                while True:
                    chars += len(row[1])
                    valid = row[3]
                    yield row[1], row[2]
                    if row[4]:
                        return
                    row = next(rows)

            turns, loss, n, loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text, bears in parse_turns(pieces(), template):
                n += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if bears:
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            if out.add((first[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid), 200):
                yield out.take()
        yield out.take()

    return read


def read_back(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of each conversation, parsed from the output of format_segments; narrow, as its rows are in order."""
    return segments.mapInArrow(_reader(template), DIGESTS)
