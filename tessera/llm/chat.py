"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" body "<|im_end|>\\n"

A role has no line break and a body no marker.  Each turn is rendered, parsed
again and compared to its source; while they differ, the part in conflict is
escaped and the turn rendered anew.  The parser always takes one backslash out
of ``<\\|`` (``<\\\\|`` ...) in a body, and backslash escapes out of a role, so
escaping, which puts one in, is undone whatever the text.

The result has one row per turn in order: a conversation's text is the
concatenation of its segments, so no conversation is gathered into one row.
Rows lie in range partitions of (conversation, turn), so a conversation with a
third of all rows is rendered, parsed and compared by many tasks.  ``read_back``
parses in the same partitions; only the bytes of conversations that cross a
border, or are long, go on in small pieces to one running digest each.
``loss_start`` and ``loss_end`` bound the assistant's text in its segment.

Defined cases: null roles and texts are empty; rows of one turn number follow
by role and text; a null turn number comes first; rows with a null
conversation id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
PIECE = 1 << 15  # bytes of a conversation that go on in one row


class GrammarError(ValueError):
    pass


def escape_body(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape_body(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


class Parser:
    """Deterministic parser; takes the text in any pieces."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Turns (role, text) that the piece completes."""
        self.rest += piece
        while self.rest:
            if not self.rest.startswith(OPEN):
                if OPEN.startswith(self.rest):
                    return
                raise GrammarError("a turn has to open")
            line = self.rest.find("\n", len(OPEN))
            end = self.rest.find(CLOSE, line + 1)
            if line < 0 or end < 0 or len(self.rest) <= end + len(CLOSE):
                return
            if self.rest[end + len(CLOSE)] != "\n":
                raise GrammarError("a line has to end behind a turn")
            body = self.rest[line + 1: end]
            if OPEN in body:
                raise GrammarError("a turn opens inside another")
            role = self.rest[len(OPEN): line]
            self.rest = self.rest[end + len(CLOSE) + 1:]
            yield unescape_role(role), unescape_body(body)

    def close(self) -> None:
        if self.rest:
            raise GrammarError("a turn does not close")


def parse(text: str) -> list[tuple[str, str]]:
    p = Parser()
    turns = list(p.feed(text))
    p.close()
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the body in it)."""
    r, body = role, text
    while True:
        segment = f"{OPEN}{r}\n{body}{CLOSE}\n"
        try:
            back = parse(segment)
        except GrammarError:
            back = []
        if back == [(role, text)]:
            at = len(OPEN) + len(r) + 1
            return segment, at, at + len(body)
        if r == role and unescape_role(role) != role or "\n" in r:
            r = escape_role(role)
        elif body == text:
            body = escape_body(text)
        else:
            raise AssertionError("an escaped turn does not parse back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, segment, loss_start, loss_end)``, in order within and across
    partitions; the loss bounds are null but for the assistant."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                             F.coalesce("text", F.lit("")).alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the row's place lets equal rows lie in several partitions
    order = ["conv_id", "turn", "role", "text", "row"]
    ordered = (c.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order)
               .sortWithinPartitions(*order))

    def run(batches):
        for b in batches:
            made = [render_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            mine = [r == ASSISTANT for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] if a else None for m, a in zip(made, mine)], pa.int32()),
                 pa.array([m[2] if a else None for m, a in zip(made, mine)], pa.int32())],
                ["conv_id", "segment", "loss_start", "loss_end"])

    kind = c.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, segment string, loss_start int, loss_end int")


class _Reader:
    """Bytes of one conversation in one partition, turn by turn."""

    def __init__(self, conv, whole: bool):
        self.conv, self.whole = conv, whole  # whole: nothing of it lies elsewhere or has gone out
        self.parser, self.piece = Parser(), 0
        self._clear()

    def _clear(self) -> None:
        self.turns, self.loss = bytearray(), bytearray()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.chars += len(segment)
        for role, text in self.parser.feed(segment):
            self.n_turns += 1
            self.turns += f"{role}\n{text}\n".encode()
        if start is not None:
            text = unescape_body(segment[start:end])
            self.loss_chars += len(text)
            self.loss += text.encode()

    def full(self) -> bool:
        return len(self.turns) + len(self.loss) >= PIECE

    def pieces(self) -> Iterator[tuple]:
        """What has come in since the last call, in rows of bounded size."""
        self.whole = False
        for at in range(0, max(len(self.turns), len(self.loss)), PIECE):
            counts = (self.n_turns, self.loss_chars, self.chars) if at == 0 else (0, 0, 0)
            yield (self.conv, self.piece, *counts, bytes(self.turns[at:at + PIECE]), bytes(self.loss[at:at + PIECE]), None, None)
            self.piece += 1
        self._clear()

    def end(self, last: bool) -> Iterator[tuple]:
        """The rest; a conversation that lies wholly here is digested at once."""
        self.parser.close()
        if self.whole and not last:
            yield (self.conv, 0, self.n_turns, self.loss_chars, self.chars, None, None,
                   hashlib.sha256(self.turns).hexdigest(), hashlib.sha256(self.loss).hexdigest())
        else:
            yield from self.pieces()


def _batch(rows: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted text says: turns, digest of roles
    and texts, and the text under the loss mask.  Expects the partitions of
    ``format_turns`` and streams through them."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = segments.schema["conv_id"].dataType
    conv_type, sql_type = to_arrow_type(kind), kind.simpleString()
    piece_kinds = [conv_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    piece_names = ["conv_id", "piece", "n_turns", "loss_chars", "formatted_chars", "turns", "loss", "turns_sha256", "loss_sha256"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches):
        reader = None
        for b in batches:
            out = []
            for c, *turn in zip(*(b.column(i).to_pylist() for i in range(4))):
                if reader is None:  # the first may have begun in the partition before
                    reader = _Reader(c, whole=False)
                elif c != reader.conv:
                    out += reader.end(last=False)
                    reader = _Reader(c, whole=True)
                reader.add(*turn)
                if reader.full():
                    out += reader.pieces()
                if len(out) >= 1000:
                    yield _batch(out, piece_kinds, piece_names)
                    out = []
            if out:
                yield _batch(out, piece_kinds, piece_names)
        if reader:  # the last may go on in the partition behind
            out = list(reader.end(last=True))
            if out:
                yield _batch(out, piece_kinds, piece_names)

    def merge(batches):
        conv = turns = loss = None
        sums = [0, 0, 0]

        def row():
            return conv, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2]

        for b in batches:
            out = []
            for c, _, n, chars, formatted, t, x, t_sha, x_sha in zip(*(b.column(i).to_pylist() for i in range(9))):
                if turns and c != conv:
                    out.append(row())
                    turns = None
                if t_sha is not None:
                    out.append((c, n, t_sha, chars, x_sha, formatted))
                    continue
                if turns is None:
                    conv, turns, loss, sums = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                turns.update(t)
                loss.update(x)
                sums = [a + d for a, d in zip(sums, (n, chars, formatted))]
            if out:
                yield _batch(out, kinds, names)
        if turns:
            yield _batch([row()], kinds, names)

    pieces = segments.mapInArrow(read, f"conv_id {sql_type}, piece long, n_turns long, loss_chars long, formatted_chars long,"
                                       " turns binary, loss binary, turns_sha256 string, loss_sha256 string")
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pieces.withColumn("part", F.spark_partition_id())
    own = parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece").select(*piece_names)
    return own.mapInArrow(merge, f"conv_id {sql_type}, n_turns long, turns_sha256 string, loss_chars long,"
                                 " loss_sha256 string, formatted_chars long")
