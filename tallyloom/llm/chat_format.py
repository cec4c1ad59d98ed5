"""Chat formatting: a finite-state machine over roles and a declarative template.

``Template`` says which strings open a turn, end its role and close it, which
roles bear loss, and the machine: the state after each (state, role) and the
states in which a conversation may end. A conversation's rows are taken in order;
each turn gives three segments (opening with the role, text, closing), and the
text of a loss role is flagged. The formatted text is stored in chunks of whole
turns, each with the spans of its loss mask in code points.

Every conversation is formatted, whatever its order of turns: the machine's
verdict is ``valid``, and ``bad_turn`` is the number (from 0) of the first turn
that it has no move for (the number of turns when only the end is wrong).

Control strings in texts and roles are escaped reversibly: a backslash goes
between the first two characters of each ``<|``, and one more where backslashes
already stand between them. Roles also escape backslash and newline, which ends a role.

Scale: one shuffle by conversation, sorted within partitions; tasks stream their
rows and hold one Arrow batch and one chunk, whatever a conversation's size. Its turns
have to pass one task in order, as a digest over it is sequential; chunks are cut
at ``CHUNK_CHARS``, so no row grows with a conversation.

Order: by turn (nulls last), then role and text, so equal turns have one order.
Null text or role: empty. A null conversation id is a conversation of its own.
Repeated rows are turns like any other. Empty input: empty output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import Scratch

CHUNK_CHARS = 1 << 20
TURN_BYTES = 4 << 20  # of an Arrow batch's turns that are formatted at once


def _moves() -> dict[tuple[str, str], str]:
    return {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked"}


@dataclass(frozen=True)
class Template:
    """How a turn is written, and which sequences of roles are valid."""
    open: str = "<|im_start|>"
    role_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: Mapping[tuple[str, str], str] = field(default_factory=_moves)
    accepted: frozenset[str] = frozenset({"asked", "answered"})

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """One turn's pieces, and whether each bears loss."""
        return [(self.open + escape_role(role) + self.role_end, False), (escape(text), role in self.loss_roles),
                (self.close, False)]

    def turn(self) -> re.Pattern:
        """Matches one formatted turn: role and text, both still escaped."""
        return re.compile(f"{re.escape(self.open)}(.*?){re.escape(self.role_end)}(.*?){re.escape(self.close)}", re.DOTALL)


CHAT = Template()
REFUSED = ""  # the machine's state after a turn that it has no move for


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Writer:
    """The chunks of one conversation, made turn by turn."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template = conv_id, template
        self.state, self.bad, self.turns, self.chunk = template.start, None, 0, 0
        self.parts: list[str] = []
        self.loss: list[dict] = []
        self.size = self.held = 0

    def add(self, role: str, text: str) -> None:
        if self.bad is None:
            self.state = self.template.moves.get((self.state, role), REFUSED)
            if self.state == REFUSED:
                self.bad = self.turns
        for piece, flag in self.template.segments(role, text):
            if flag:
                self.loss.append({"start": self.size, "end": self.size + len(piece)})
            self.parts.append(piece)
            self.size += len(piece)
        self.turns += 1
        self.held += 1

    def row(self, last: bool) -> dict:
        """The turns since the last chunk; the last chunk also has the machine's verdict."""
        if last and self.bad is None and self.state not in self.template.accepted:
            self.bad = self.turns
        out = {"conv_id": self.conv_id, "chunk": self.chunk, "formatted": "".join(self.parts), "loss": self.loss,
               "n_turns": self.held, "valid": self.bad is None if last else None, "bad_turn": self.bad if last else None}
        self.parts, self.loss, self.size, self.held = [], [], 0, 0
        self.chunk += 1
        return out


def few_turns(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """The batch's rows as dicts, a few at a time, so that long texts aren't all held as Python strings."""
    step = max(1, int(batch.num_rows * TURN_BYTES / max(batch.nbytes, TURN_BYTES)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step).to_pylist()


def format_chats(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Formatted conversations in chunks: (conv_id, chunk, formatted, loss, n_turns, valid, bad_turn).

    loss: spans of the chunk in code points; valid and bad_turn: on each
    conversation's last chunk, else null.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, chunk long, formatted string, loss array<struct<start:long,end:long>>, n_turns long, "
              "valid boolean, bad_turn long")
    frame = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kinds
        now = None
        for batch in batches:
            kinds = pa.schema([("conv_id", batch.schema.field(0).type), ("chunk", pa.int64()), ("formatted", pa.string()),
                               ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                               ("n_turns", pa.int64()), ("valid", pa.bool_()), ("bad_turn", pa.int64())])
            for rows in few_turns(batch):
                done = []
                for r in rows:
                    if now is None or now.conv_id != r["conv_id"]:
                        if now is not None:
                            done.append(now.row(True))
                        now = Writer(r["conv_id"], template)
                    elif now.size >= CHUNK_CHARS:
                        done.append(now.row(False))
                    now.add(r["role"], r["text"])
                yield pa.RecordBatch.from_pylist(done, kinds)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(True)], kinds)

    return (frame.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")
            .mapInArrow(run, schema))


def read_back(chunks: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, from its formatted chunks alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (all text under the loss mask, unescaped),
    formatted_chars, valid, bad_turn.
    """
    kind = chunks.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
              "valid boolean, bad_turn long")
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = template.turn()
        now = turns = loss = kinds = None
        for batch in batches:
            kinds = pa.schema(list(zip(names, [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(),
                                               pa.int64(), pa.bool_(), pa.int64()])))
            for rows in few_turns(batch):
                done = []
                for r in rows:
                    if now is None:
                        now = [r["conv_id"], 0, "", 0, "", 0, None, None]
                        turns, loss = hashlib.sha256(), hashlib.sha256()
                    text, at = r["formatted"], 0
                    for m in pattern.finditer(text):
                        if m.start() != at:
                            raise ValueError(f"conversation {r['conv_id']}: text between turns at {at}")
                        at = m.end()
                        now[1] += 1
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    if at != len(text):
                        raise ValueError(f"conversation {r['conv_id']}: text after the last turn")
                    for span in r["loss"]:
                        piece = unescape(text[span["start"]:span["end"]])
                        now[3] += len(piece)
                        loss.update(piece.encode())
                    now[5] += len(text)
                    if r["valid"] is not None:  # a conversation's last chunk
                        now[2], now[4], now[6], now[7] = turns.hexdigest(), loss.hexdigest(), r["valid"], r["bad_turn"]
                        done.append(dict(zip(names, now)))
                        now = None
                yield pa.RecordBatch.from_pylist(done, kinds)

    return (chunks.select("conv_id", "chunk", "formatted", "loss", "valid", "bad_turn").repartition("conv_id")
            .sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema))


def chat_round_trip(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Format the conversations, store the result, and read each back from it."""
    scratch = Scratch(turns.sparkSession, "chat-format")
    return read_back(scratch.write(format_chats(turns, template), "formatted"), template)
