"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. Logs are partitioned by conversation and sorted by message and sequence; one pass over
the sorted rows folds streamed deltas, edits and regenerations into final messages and renders each at once. A pass holds
one message and not a conversation, so a conversation of any length needs the memory of its longest message.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: what opens and closes a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
MASKED_ROLE = "assistant"

HEAD = 64  # characters of a text that order messages of the same turn and role
EVENT_KINDS = ("start", "delta", "edit", "regenerate", "delete")

_BAR = re.compile(r"<(\\*)\|")
_ESCAPED_BAR = re.compile(r"<\\(\\*)\|")
_HEADER = re.compile(r"\\[\\n]")


def escape(text: str) -> str:
    """Put one more backslash between every ``<`` and ``|``, so that no control string is left; ``unescape`` undoes it."""
    return _BAR.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED_BAR.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line: backslashes and line feeds are escaped besides control strings."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _HEADER.sub(lambda m: "\n" if m[0][1] == "n" else "\\", unescape(role))


class Segment(NamedTuple):
    """A rendered turn: its text, and the span in it, in code points, that the loss covers (empty for other roles)."""

    text: str
    loss_from: int
    loss_to: int


def render(role: str, text: str) -> Segment:
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    to = len(head) + len(body) if role == MASKED_ROLE else len(head)
    return Segment(f"{head}{body}{CLOSE}\n", len(head), to)


class Message:
    """The state that a message's events are folded into."""

    def __init__(self) -> None:
        self.role, self.parts, self.gone = "", [], False

    def fold(self, kind: str, role: str | None, text: str | None) -> None:
        """start: sets the role and begins with text. delta: appends. edit: replaces all. regenerate: begins anew with text.
        delete: drops the message until a later start, edit or regenerate. A null text is empty; a null role keeps the role."""
        if kind not in EVENT_KINDS:
            raise ValueError(f"unknown kind of event: {kind!r}")
        if role is not None:
            self.role = role
        if kind == "delta":
            self.parts.append(text or "")
        else:
            self.parts, self.gone = [text or ""], kind == "delete"

    @property
    def text(self) -> str:
        return "".join(self.parts)


def read_turns(chunks: Iterable[str]) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, span) of every turn of a formatted conversation, given in chunks that may be cut anywhere.

    span is where the escaped text stands in the whole. A malformed conversation raises ValueError. What is held is the turn
    that is not complete yet; a chunk is looked through once, however many a turn has.
    """
    reader = TurnReader()
    for chunk in chunks:
        for role, body, at in reader.feed(chunk):
            yield role, unescape(body), (at, at + len(body))
    reader.end()


class TurnReader:
    """Reads a conversation's output as it comes: ``feed`` gives (role, escaped text, its place in the whole) of turns that are complete."""

    def __init__(self) -> None:
        self.held: list[str] = []  # of the turn that is not complete
        self.tail = ""  # the last characters of it, in which the end of a turn may have begun
        self.base = 0

    def feed(self, chunk: str) -> Iterator[tuple[str, str, int]]:
        end = CLOSE + "\n"
        self.held.append(chunk)
        if end not in self.tail + chunk:
            self.tail = (self.tail + chunk)[-len(end) + 1 :]
            return
        rest, at = "".join(self.held), 0
        while (stop := rest.find(end, at)) >= 0:
            head = rest.find("\n", at, stop)
            if not rest.startswith(OPEN, at) or head < 0:
                raise ValueError("a turn does not begin with its header")
            yield unescape_role(rest[at + len(OPEN) : head]), rest[head + 1 : stop], self.base + head + 1
            at = stop + len(end)
        self.base += at
        self.held, self.tail = [rest[at:]], rest[at:][-len(end) + 1 :]

    def end(self) -> None:
        if any(self.held):
            raise ValueError("text after the last turn")


_READ_CHARS = 1 << 16


class Digest:
    """What is read back from a conversation's output. The output is one run of text: segments are strung together and read
    in blocks that end anywhere, and the loss mask is a list of spans of that run."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.reader, self.output, self.size = TurnReader(), [], 0
        self.mask: deque[tuple[int, int]] = deque()

    def add(self, segment: Segment) -> None:
        if segment.loss_to > segment.loss_from:
            self.mask.append((self.formatted_chars + segment.loss_from, self.formatted_chars + segment.loss_to))
        self.formatted_chars += len(segment.text)
        self.output.append(segment.text)
        self.size += len(segment.text)
        if self.size >= _READ_CHARS:
            whole = "".join(self.output)
            cut = len(whole) // _READ_CHARS * _READ_CHARS
            self.output, self.size = [whole[cut:]], len(whole) - cut
            for at in range(0, cut, _READ_CHARS):
                self._read(whole[at : at + _READ_CHARS])

    def _read(self, chunk: str) -> None:
        for role, body, at in self.reader.feed(chunk):
            self.n_turns += 1
            self.turns.update(f"{role}\n{unescape(body)}\n".encode())
            while self.mask and self.mask[0][0] < at + len(body):
                begin, stop = self.mask.popleft()
                if begin < at or stop > at + len(body):
                    raise ValueError("the loss mask covers more than a turn's text")
                covered = unescape(body[begin - at : stop - at])
                self.loss_chars += len(covered)
                self.loss.update(covered.encode())

    def row(self) -> tuple:
        self._read("".join(self.output))
        self.reader.end()
        if self.mask:
            raise ValueError("the loss mask covers what is no turn's text")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_BY = ["conv_id", "message", "seq", "kind", "role", "text"]


def _ordered(events: DataFrame) -> DataFrame:
    """One conversation in one partition, sorted; ties by kind, role and text, so equal logs give equal results. A message
    goes on by a hash of its name, which need not be a number."""
    events = events.select(*_BY).repartition("conv_id").sortWithinPartitions(*_BY)
    return events.select("conv_id", F.xxhash64("message").alias("message"), "kind", "role", "text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, Message]]:
    now: tuple | None = None
    message = Message()
    for b in batches:
        for conv, at, kind, role, text in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if (conv, at) != now:
                if now is not None and not message.gone:
                    yield *now, message
                now, message = (conv, at), Message()
            message.fold(kind, role, text)
    if now is not None and not message.gone:
        yield *now, message


def _streamed(emit: Callable[[int | None, list[tuple[int | None, Message]] | None], Iterator[tuple]], names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for row in emit(_messages(batches)):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if size > 4_000_000 or len(rows) >= 5000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return run


def _rendered(messages: Iterator) -> Iterator[tuple]:
    conv, at, n = object(), 0, 0
    for c, _m, message in messages:
        at, n = (0, 0) if c != conv else (at, n)
        conv, s = c, render(message.role, message.text)
        yield c, n, message.role, s.text, at, at + s.loss_from, at + s.loss_to
        at, n = at + len(s.text), n + 1


def _digested(messages: Iterator) -> Iterator[tuple]:
    conv, digest = None, None
    for c, _m, message in messages:
        if digest is None or c != conv:
            if digest:
                yield conv, *digest.row()
            conv, digest = c, Digest()
        digest.add(render(message.role, message.text))
    if digest:
        yield conv, *digest.row()


def format_segments(events: DataFrame) -> DataFrame:
    """The formatted conversations, in a row for each turn: conv_id, turn (from 0), role, segment, start, loss_from, loss_to.

    A conversation's output is its segments in a row, which fit no matter how long it is; start, loss_from and loss_to are
    code points in that output. events: conv_id, message (its place, of any type that sorts), seq, kind (see ``Message.fold``),
    role, text.
    """
    names = ["conv_id", "turn", "role", "segment", "start", "loss_from", "loss_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    schema = "conv_id bigint, turn bigint, role string, segment string, start bigint, loss_from bigint, loss_to bigint"
    return _ordered(events).mapInArrow(_streamed(_rendered, names, types), schema)


def format_digests(events: DataFrame) -> DataFrame:
    """One row for each conversation with a message, read back from its output as a whole: n_turns, turns_sha256 (of role,
    line feed, text, line feed for each turn), loss_chars and loss_sha256 (of what the loss mask covers, unescaped),
    formatted_chars. A null conv_id is a conversation; an empty log gives an empty result."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _ordered(events).mapInArrow(_streamed(_digested, names, types), schema)


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that ends in the turns (conv_id, turn, role, text), as a live one would: texts come in three deltas, and by a hash
    a draft comes first, which is generated anew, edited, or deleted and then edited.

    Each row is a message of its own, repeated rows too. Messages are in order of the turn, nulls first, then of role and the
    text's first HEAD characters, then of its hash. Null roles and texts are empty. Other columns are not read. Nothing is
    grouped or shuffled here; an empty table gives an empty log.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    message = F.struct("turn", "role", F.left("text", F.lit(HEAD)).alias("head"), F.xxhash64("text").alias("hash"), "row")
    third = F.ceil(F.length("text") / 3).cast("int")
    parts = [F.left("text", third), F.substring(F.col("text"), third + 1, third), F.substring(F.col("text"), 2 * third + 1, third)]
    none = F.lit(None).cast("string")

    def log(*steps: tuple[str, Column]) -> Column:
        made = [(kind, F.col("role") if i == 0 else none, said) for i, (kind, said) in enumerate([*steps, ("delta", parts[1]), ("delta", parts[2])])]
        return F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), who.alias("role"), said.alias("text")) for i, (k, who, said) in enumerate(made)])

    draft = F.reverse(F.left("text", F.lit(12)))
    way = F.pmod(F.xxhash64("text", "role"), F.lit(4))
    events = (
        F.when(way == 0, log(("start", parts[0])))
        .when(way == 1, log(("start", draft), ("regenerate", parts[0])))
        .when(way == 2, log(("start", draft), ("edit", parts[0])))
        .otherwise(log(("start", draft), ("delete", none), ("edit", parts[0])))
    )
    return rows.select("conv_id", message.alias("message"), F.explode(events).alias("e")).select("conv_id", "message", "e.seq", "e.kind", "e.role", "e.text")
