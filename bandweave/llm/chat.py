"""Chat formatting with a template that is only ever called, never read.

The template renders a list of turns. It is called on the turns before and with
each turn; where the first output begins the second, what is added is the turn's
piece, and where it doesn't, the template has rewritten history. Two further calls
with single letters in place of the text, which differ only there, show where in
the piece the text stands. A turn's row says: what was rendered stands up to
offset, then comes piece.

A null text or role is an empty one; rows of a null id are one conversation; turns
of equal number are ordered by role and text, and repeated rows are turns of their
own; the template sees all turns before, so that what it does to any earlier one is
seen: a conversation stands in one task's memory, and rendering it costs the square
of its turns (a caller whose template looks back on a few turns only can say so by
`context`); further columns are left behind; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
COLUMNS = ("conv_id", "place", "role", "piece", "offset", "start", "end", "in_loss", "rewrites", "located")
SCHEMA = "conv_id long, place long, role string, piece string, offset long, start long, end long, in_loss boolean, rewrites boolean, located boolean"
#: Rows that are handed on at a time, and their code points.
OUT_ROWS, OUT_CHARS = 2000, 1 << 22
#: Texts of up to so many code points are escaped once for many renderings; so many of them are kept.
KEPT_CHARS, KEPT_TEXTS = 4096, 4096

# The template of instructions. Its marks, each of which is broken up where a text holds it.
BEGIN, END = "<s>", "</s>"
FRAMES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", END)}
OTHER_ROLE = ("[ROLE ", "]\n", "[/ROLE]")
CONTROL = re.compile(r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[ROLE |\[/ROLE\]|</s>|<s>")
HEADER = re.compile(r"(?:<s>)?(?:(<<SYS>>\n)|(\[INST\] )|\[ROLE ((?:[^\]\\]|\\.)*)\]\n|( ))", re.S)


def escaped(text: str) -> str:
    """Backslashes doubled, and one put behind the first character of each control string."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


_escaped_once = lru_cache(KEPT_TEXTS)(escaped)


def _escaped(text: str) -> str:
    return _escaped_once(text) if len(text) <= KEPT_CHARS else escaped(text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def instruct(turns: Sequence[Turn]) -> str:
    """System, user and assistant turns in their marks; a turn of any other role names it."""
    out = [BEGIN]
    for role, text in turns:
        if role in FRAMES:
            before, after = FRAMES[role]
            out += (before, _escaped(text), after)
        else:
            before, behind, after = OTHER_ROLE
            out += (before, escaped(role).replace("]", "\\]"), behind, _escaped(text), after)
    return "".join(out)


def read_turn(piece: str) -> Turn:
    """Role and text of one turn's piece of instruct(), from its marks alone."""
    head = HEADER.match(piece)
    if not head:
        raise ValueError(f"no turn begins with {piece[:20]!r}")
    role = ("system", "user", None, "assistant")[head.lastindex - 1]
    after = FRAMES[role][1] if role else OTHER_ROLE[2]
    if not piece.endswith(after):
        raise ValueError(f"a turn ends with {piece[-20:]!r}")
    name = role or re.sub(r"\\(.)", r"\1", head[3], flags=re.S)
    return name, unescaped(piece[head.end() : len(piece) - len(after)])


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Rendering:
    """One conversation, rendered turn by turn."""

    def __init__(self, render: Template, context: int | None, restore: Callable[[str], str] = unescaped):
        self._render, self._context, self._restore = render, context, restore
        self._turns: list[Turn] = []
        self._last: str | None = ""  # of self._turns, if they are all that were given
        self._length = 0

    def add(self, role: str, text: str) -> tuple[str, int, int, int, bool, bool]:
        """(piece, offset, start, end, rewrites, located); start and end are those of the text within the whole output."""
        before = self._last if self._last is not None else self._render(self._turns)
        after = self._render([*self._turns, (role, text)])
        kept = _common(before, after)
        one, two = (self._render([*self._turns, (role, probe)]) for probe in "ab")
        start = _common(one, two)
        end = len(after) - (len(one) - start - 1)
        framed = one[start + 1 :] == two[start + 1 :] and after[:start] == one[:start] and after[end:] == one[start + 1 :]
        located = kept <= start <= end and framed and self._restore(after[start:end]) == text
        shift = self._length - len(before)
        self._turns.append((role, text))
        self._last, self._length = after, shift + len(after)
        if self._context is not None and len(self._turns) > self._context:
            del self._turns[: len(self._turns) - self._context]
            self._last = None
        return after[kept:], shift + kept, shift + start, shift + end, kept < len(before), located


def _formatted(batches: Iterator[pa.RecordBatch], render: Template, context: int | None, loss: tuple[str, ...], restore: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    chars, now, open_, place = 0, None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows], schema=_ARROW)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c) for c in ("conv_id", "role", "text")), strict=True):
            conv, role, text = conv.as_py(), role.as_py(), text.as_py()
            if open_ is None or conv != now:
                now, open_, place = conv, Rendering(render, context, restore), 0
            piece, offset, start, end, rewrites, located = open_.add(role, text)
            rows.append((conv, place, role, piece, offset, start, end, role in loss, rewrites, located))
            place, chars = place + 1, chars + len(piece)
            if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                yield out()
                rows.clear()
                chars = 0
    if rows:
        yield out()


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("offset", pa.int64()),
     ("start", pa.int64()), ("end", pa.int64()), ("in_loss", pa.bool_()), ("rewrites", pa.bool_()), ("located", pa.bool_())]
)


def format_conversations(turns: DataFrame, render: Template = instruct, context: int | None = None, loss: tuple[str, ...] = ("assistant",), restore: Callable[[str], str] = unescaped) -> DataFrame:
    """(conv_id, place, role, piece, offset, start, end, in_loss, rewrites, located), one row a turn.

    A conversation's output is that of applied() to its rows by place, which
    stand together in that order; start and end bound the text of the turn in it
    and in_loss says that it is one to be learnt. rewrites: earlier output was
    changed from offset on. located: what stands between start and end is the
    text again once restore undoes the template's escapes, which fails for
    templates that trim, change or repeat it.

    context is how many turns a template looks back on, None for all; what it does
    to earlier ones is seen with None only.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _formatted(batches, render, context, loss, restore), SCHEMA)


def applied(pieces: Iterator[tuple[int, str]]) -> str:
    """The output of one conversation from (offset, piece) in order."""
    out = ""
    for offset, piece in pieces:
        out = out[:offset] + piece
    return out


def rewriting(render: Template, conversations: Sequence[Sequence[Turn]]) -> list[tuple[int, int]]:
    """(conversation, turn) of those given at which the template changes what it rendered before."""
    found = []
    for number, turns in enumerate(conversations):
        state = Rendering(render, None)
        found += [(number, place) for place, turn in enumerate(turns) if state.add(*turn)[4]]
    return found


def _digests(batches: Iterator[pa.RecordBatch], read: Callable[[str], Turn]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    now, turns, loss, n, chars, length = None, None, None, 0, 0, 0

    def close() -> None:
        rows.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), length))

    def out() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("conv_id", "place", "piece", "offset", "start", "end", "in_loss", "rewrites", "located")), strict=True):
            conv, place, piece, offset, start, end, learnt, rewrites, located = (v.as_py() for v in row)
            if rewrites or not located:
                raise ValueError(f"turn {place} of conversation {conv} can't be read back: the template changes history or texts")
            if turns is None or conv != now:
                if turns is not None:
                    close()
                now, turns, loss, n, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0
            role, text = read(piece)
            turns.update(f"{role}\n{text}\n".encode())
            if learnt:
                masked = unescaped(piece[start - offset : end - offset])
                loss.update(masked.encode())
                chars += len(masked)
            n, length = n + 1, offset + len(piece)
            if len(rows) >= OUT_ROWS:
                yield out()
                rows.clear()
    if turns is not None:
        close()
    if rows:
        yield out()


def read_back(formatted: DataFrame, read: Callable[[str], Turn] = read_turn) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the rows of format_conversations().

    Roles and texts come from the marks of the pieces, what is learnt from the
    bounds of the loss mask. A turn that was rewritten or isn't located raises.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(lambda batches: _digests(batches, read), schema)
