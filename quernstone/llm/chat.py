"""Chat formatting by a declarative template and a finite-state machine over roles.

A template names the marks around a turn, the roles that are learnt from and the moves
between states. Conversations are brought together by a hash of their key and sorted by
turn on disk; each is then formatted turn by turn as a stream, so that a conversation of
any length needs the memory of one turn. A turn gives three segments: its opening, its
text and its closing, each with a flag whether the loss covers it.

Every mark begins with the opener, here ``<|``. A text that holds ``<``, some backslashes
and ``|`` gets one backslash more, which reading back takes away again, so no text can
hold a mark and every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import map_arrow

#: The template of the query: turns between marks, the assistant's texts learnt, an optional
#: system turn first and then questions and answers in turn.
CHATML = {
    "opener": "<|",
    "before": "<|im_start|>{role}\n",
    "after": "<|im_end|>\n",
    "loss": ["assistant"],
    "start": "start",
    "moves": {
        "start": {"system": "primed", "user": "asked"},
        "primed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    "accept": ["answered"],
}
#: The state after a turn that no move allows.
REFUSED = "refused"
#: Characters of a batch that a task gives out.
_BATCH = 1 << 22


@dataclass(frozen=True)
class Template:
    """A checked template: marks that can be told from texts, and moves between known states."""

    head: str
    tail: str
    after: str
    opener: str
    loss: frozenset
    start: str
    moves: dict
    accept: frozenset

    @classmethod
    def of(cls, spec: dict) -> Template:
        opener, parts = spec["opener"], spec["before"].split("{role}")
        if len(opener) < 2 or opener[0] in opener[1:] or "\\" in opener:
            raise ValueError("the opener has two characters or more, the first of them once, and no backslash")
        if len(parts) != 2 or not parts[0].startswith(opener) or not parts[1].startswith("\n") or not spec["after"].startswith(opener):
            raise ValueError("a turn begins with the opener, then {role} and a line's end, and closes with the opener")
        if opener in parts[0][1:] or opener in parts[1] or opener in spec["after"][1:] or parts[0] == spec["after"]:
            raise ValueError("a mark holds the opener once, at its beginning, and opening and closing differ")
        states = {spec["start"], *spec["moves"], *(s for m in spec["moves"].values() for s in m.values())}
        if REFUSED in states or not set(spec["accept"]) <= states:
            raise ValueError(f"accepting states are states of moves, and {REFUSED!r} isn't one")
        return cls(parts[0], parts[1], spec["after"], opener, frozenset(spec["loss"]), spec["start"], spec["moves"], frozenset(spec["accept"]))

    def move(self, state: str, role: str) -> str:
        return self.moves.get(state, {}).get(role, REFUSED)

    def escape(self, text: str) -> str:
        first, rest = re.escape(self.opener[0]), re.escape(self.opener[1:])
        return re.sub(rf"{first}(\\*){rest}", lambda m: f"{self.opener[0]}\\{m[1]}{self.opener[1:]}", text) if self.opener[0] in text else text

    def unescape(self, text: str) -> str:
        first, rest = re.escape(self.opener[0]), re.escape(self.opener[1:])
        return re.sub(rf"{first}\\(\\*){rest}", lambda m: f"{self.opener[0]}{m[1]}{self.opener[1:]}", text) if "\\" in text else text

    def escape_role(self, role: str) -> str:
        """A role has no line's end of its own."""
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of a turn's three parts."""
        return [(f"{self.head}{self.escape_role(role)}{self.tail}", False), (self.escape(text), role in self.loss), (self.after, False)]

    def read(self, pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, text under the loss mask, characters) of each turn of formatted text.

        The pieces may be cut anywhere; turns are found by the marks alone.
        """
        held: list[tuple[str, bool]] = []
        text = ""
        for piece in pieces:
            held.append(piece)
            text += piece[0]
            while (end := text.find(self.after)) >= 0:
                end += len(self.after)
                yield self._turn(text[:end], held)
                held, text = _drop(held, end), text[end:]
        if text:
            raise ValueError("formatted text ends within a turn")

    def _turn(self, turn: str, held: list[tuple[str, bool]]) -> tuple[str, str, str, int]:
        begin = turn.find(self.tail, len(self.head))
        if not turn.startswith(self.head) or begin < 0:
            raise ValueError("a turn doesn't open with its mark")
        learnt, at = [], 0
        for piece, loss in held:
            if loss:
                learnt.append(turn[at : at + len(piece)])
            at += len(piece)
        body = turn[begin + len(self.tail) : len(turn) - len(self.after)]
        return self.unescape_role(turn[len(self.head) : begin]), self.unescape(body), self.unescape("".join(learnt)), len(turn)


def _drop(held: list[tuple[str, bool]], n: int) -> list[tuple[str, bool]]:
    """The pieces without their first ``n`` characters."""
    out = []
    for text, loss in held:
        if n < len(text):
            out.append((text[n:], loss))
        n = max(0, n - len(text))
    return out


def _rows(batches, width: int) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True)


def _groups(rows: Iterator[tuple], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, its rows' rest) as a stream; rows of a key stand together."""
    from itertools import groupby

    for key, own in groupby(rows, key=lambda r: r[:width]):
        yield key, (r[width:] for r in own)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose ``size`` adds up to about 4 MB."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _types(df: DataFrame, names: list[str]) -> tuple[str, list[pa.Field]]:
    """The columns as a Spark schema, and as Arrow fields."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.select(*names).schema
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), list(to_arrow_schema(kept))


def format_chats(turns: DataFrame, spec: dict = CHATML, keys: tuple[str, ...] = ("conv_id",), turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(keys, segment, text, loss, state): the segments of every conversation, in order within a partition.

    Turns stand in the order of ``turn_col`` (null first, equal ones by role and text). Null roles and
    texts count as empty; a null key is a conversation of its own; repeated rows are repeated turns.
    ``state`` is the machine's after the turn, ``refused`` from the first turn on that no move allows;
    what it refuses is formatted all the same. An empty table has no segments.
    """
    template = Template.of(spec)
    names, n = list(keys), len(keys)
    own, fields = _types(turns, names)
    rows = turns.select(*names, F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("__role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "__turn", "__role", "__text").drop("__turn")
    schema = pa.schema([*fields, ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string())])

    def made(batches):
        for key, own_turns in _groups(_rows(batches, n + 2), n):
            state, k = template.start, 0
            for role, text in own_turns:
                state = template.move(state, role)
                for part, loss in template.segments(role, text):
                    yield (*key, k, part, loss, state)
                    k += 1

    def run(batches):
        yield from _batches(made(batches), schema, lambda r: 64 + len(r[n + 1]))

    return map_arrow(rows, run, f"{own}, segment long, text string, loss boolean, state string")


def read_chats(segments: DataFrame, spec: dict = CHATML, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """(keys, turn, role, text, learnt): the turns read back from what ``format_chats`` gave, as it gave it.

    ``learnt`` is the turn's text under the loss mask. A turn is found by the marks in the
    formatted text, whatever the segments were.
    """
    template = Template.of(spec)
    names, n = list(keys), len(keys)
    own, fields = _types(segments, names)
    schema = pa.schema([*fields, ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learnt", pa.string())])

    def made(batches):
        for key, pieces in _groups(_rows(batches, n + 2), n):
            for k, (role, text, learnt, _) in enumerate(template.read(pieces)):
                yield (*key, k, role, text, learnt)

    def run(batches):
        yield from _batches(made(batches), schema, lambda r: 64 + len(r[n + 2]) + len(r[n + 3]))

    return map_arrow(segments.select(*names, "text", "loss"), run, f"{own}, turn long, role string, text string, learnt string")


def chat_digests(segments: DataFrame, spec: dict = CHATML, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """(keys, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), read back from segments.

    Digests grow with the stream of turns, so no conversation is ever held as a whole. ``valid``
    says that the machine allowed every turn and ended in an accepting state.
    """
    template = Template.of(spec)
    names, n = list(keys), len(keys)
    own, fields = _types(segments, names)
    schema = pa.schema([*fields, ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def made(batches):
        for key, own_segments in _groups(_rows(batches, n + 3), n):
            last = [template.start]

            def pieces(own_segments=own_segments, last=last):
                for text, loss, state in own_segments:
                    last[0] = state
                    yield text, loss

            all_turns, under_loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for role, text, learnt, length in template.read(pieces()):
                all_turns.update(f"{role}\n{text}\n".encode())
                under_loss.update(learnt.encode())
                n_turns, loss_chars, chars = n_turns + 1, loss_chars + len(learnt), chars + length
            yield (*key, n_turns, all_turns.hexdigest(), loss_chars, under_loss.hexdigest(), chars, last[0] in template.accept)

    def run(batches):
        yield from _batches(made(batches), schema, lambda r: 256)

    return map_arrow(segments.select(*names, "text", "loss", "state"), run, f"{own}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
