"""Chat formatting by a grammar round trip.

A conversation is rendered with a fixed template, the rendered text is reparsed by a deterministic parser, and the turns
that come back are compared with the source. Content that conflicts with the grammar (control strings, or the escape
character before one) is escaped and the conversation rendered again, until both sides are identical.

Grammar (``text`` has no bare control string; ``\\`` before a control string or another ``\\`` is an escape)::

    conversation := "<s>" turn*
    turn         := "[INST]" text "[/INST]"          (user)
                  | "<<SYS>>" text "<</SYS>>"        (system)
                  | "<<OUT>>" text "</s>"            (assistant)
                  | "<<ROLE>>" role "<<BODY>>" text "<</BODY>>"   (any other role)
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "open", "close"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<<OUT>>", "</s>")}
BEGIN, ROLE, BODY, BODY_END = "<s>", "<<ROLE>>", "<<BODY>>", "<</BODY>>"
CONTROL = sorted({BEGIN, ROLE, BODY, BODY_END, *itertools.chain(*MARKS.values())}, key=lambda c: (-len(c), c))
_TOKEN = re.compile("(\\\\(?:\\\\|" + "|".join(map(re.escape, CONTROL)) + "))|(" + "|".join(map(re.escape, CONTROL)) + ")")
_CONFLICT = re.compile("\\\\|" + "|".join(map(re.escape, CONTROL)))


@dataclass
class Formatted:
    """A rendered conversation. ``loss`` holds [start, end) code point spans of assistant content in ``text``."""

    text: str
    loss: list[tuple[int, int]] = field(default_factory=list)


class GrammarError(ValueError):
    """The text is no sentence of the grammar."""


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _TOKEN.sub(lambda m: m[1][1:] if m[1] else m[0], text)


def render(turns: list[tuple[str, str]], escaped: set[int]) -> Formatted:
    """Render turns as they are; the content of those listed in ``escaped`` is escaped first."""
    parts, at, loss = [BEGIN], len(BEGIN), []
    for k, (role, text) in enumerate(turns):
        body = escape(text) if k in escaped else text
        if role in MARKS:
            head, tail = MARKS[role]
        else:
            head, tail = ROLE + (escape(role) if k in escaped else role) + BODY, BODY_END
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return Formatted("".join(parts), loss)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; raises :class:`GrammarError` on anything else."""
    opens = {head: (role, tail) for role, (head, tail) in MARKS.items()}
    turns, state, role, tail, content = [], "start", "", "", []

    def plain(piece: str) -> None:
        if piece and state not in ("role", "body"):
            raise GrammarError(f"text outside a turn: {piece[:20]!r}")
        if piece:
            content.append(piece)

    at = 0
    for m in _TOKEN.finditer(text):
        plain(text[at : m.start()])
        at = m.end()
        if m[1]:
            plain(m[1][1:])
            continue
        mark = m[2]
        if state == "start" and mark == BEGIN:
            state = "between"
        elif state == "between" and mark in opens:
            (role, tail), state = opens[mark], "body"
        elif state == "between" and mark == ROLE:
            state = "role"
        elif state == "role" and mark == BODY:
            role, tail, state = "".join(content), BODY_END, "body"
            content = []
        elif state == "body" and mark == tail:
            turns.append((role, "".join(content)))
            content, state = [], "between"
        else:
            raise GrammarError(f"{mark!r} in state {state}")
    plain(text[at:])
    if state != "between":
        raise GrammarError(f"ends in state {state}")
    return turns


def format_conversation(turns: list[tuple[str, str]]) -> Formatted:
    """Render, reparse, compare; escape the turns in conflict and repeat until the round trip is exact."""
    escaped: set[int] = set()
    while True:
        out = render(turns, escaped)
        try:
            back = parse(out.text)
        except GrammarError:
            back = []
        if back == turns:
            return out
        clash = {k for k, (role, text) in enumerate(turns) if k not in escaped and (_CONFLICT.search(text) or role not in MARKS)}
        if not clash:
            raise GrammarError("an escaped conversation does not parse back")
        escaped |= clash


FORMAT_SCHEMA = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Consecutive rows of one conv_id, across Arrow batches."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for key, group in itertools.groupby(rows, key=lambda x: x[0]):
        yield key, [(r or "", t or "") for _, r, t in group]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _conversations(batches)
    while chunk := list(itertools.islice(found, 256)):
        made = [format_conversation(turns) for _, turns in chunk]
        spans = [[{"start": a, "end": b} for a, b in f.loss] for f in made]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunk], pa.int64()), pa.array([f.text for f in made], pa.string()), pa.array(spans, SPANS)], ["conv_id", "formatted", "loss_spans"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """One formatted text with loss spans for each conv_id of (conv_id, turn, role, text) rows.

    Null text is empty text; a null role is the role "". Rows of equal turn are ordered by role, then text; repeated rows
    are separate turns; a null turn comes first and rows of a null conv_id form one conversation. An empty table gives no
    rows; other columns are ignored. Rows are dealt by conv_id and sorted, and each task streams over its conversations, so
    no more than one conversation is held at a time.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, FORMAT_SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out = []
        for key, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            turns = parse(text)
            under = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            out.append((key, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(text)))
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the loss spans recover from formatted conversations."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
