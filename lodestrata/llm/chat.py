"""Chat formatting: a finite-state machine over roles and a declarative template.

The template is data: for each role a text before and after a turn, and whether its text is learned
from. Control strings inside a turn's text are escaped: the escape mark is doubled, and one mark is put
behind the first character of every control string, in one left-to-right pass. No control string is
left in a text, and reading back (a pair of marks is a mark, a single one is nothing) is exact.

Turns stream through a task in (conv_id, turn) order; the machine holds one state and the current
row, so a conversation of any length needs constant memory.

Defined cases: null text is empty; a null role is the role '' and, like any role the template does
not know, is written with the template's entry for other roles and makes the conversation invalid; a
null turn sorts first, equal turns by role, then text; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives no segments. Turn order is judged, never repaired:
`error` names the first transition that the machine refuses.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Template:
    """before/after by role; '*' serves every other role and has the role itself written after `before`."""

    before: dict[str, str]
    after: dict[str, str]
    learned: frozenset[str]
    controls: tuple[str, ...]
    escape: str = "\\"
    #: state -> role -> next state; a conversation may end in the states of `final`.
    machine: dict[str, dict[str, str]] = field(default_factory=dict)
    start: str = "start"
    final: frozenset[str] = frozenset()

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(re.escape(x) for x in sorted({*self.controls, self.escape}, key=lambda x: (-len(x), x))))

    def quote(self, text: str) -> str:
        return self.pattern().sub(lambda m: self.escape * 2 if m[0] == self.escape else m[0][0] + self.escape + m[0][1:], text)

    def plain(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + f"({re.escape(self.escape)})?", lambda m: m[1] or "", text)


INST = Template(
    before={"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>", "*": "<<ROLE>>"},
    after={"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>", "*": "<</ROLE>>"},
    learned=frozenset({"assistant"}),
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<</ROLE>>", "<<IS>>"),
    machine={"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}},
    final=frozenset({"answered"}),
)
#: Between the name of an unknown role and its text.
ROLE_END = "<<IS>>"

SEGMENTS = "conv_id long, turn_no long, part int, segment string, loss boolean, error string"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, error string"


def segments_of(rows: Iterator[tuple], t: Template) -> Iterator[tuple]:
    """(conv_id, turn_no, part, segment, loss, error) for rows (conv_id, role, text) in order. Parts of a turn: 0 before, 1 text, 2 after; after the last turn comes part 3, empty, with the verdict."""
    conv, state, n, error, first = None, t.start, 0, None, True

    def end() -> tuple:
        return (conv, n, 3, "", False, error or (None if state in t.final else f"ends in {state}"))

    for c, role, text in rows:
        if first or c != conv:
            if not first:
                yield end()
            conv, state, n, error, first = c, t.start, 0, None, False
        role, text = role or "", text or ""
        after = t.machine.get(state, {}).get(role)
        if after is None:
            error = error or f"turn {n}: {role or 'no role'} after {state}"
            after = next((x for s in t.machine.values() for r, x in s.items() if r == role), state)
        state = after
        known = role in t.before and role != "*"
        yield (conv, n, 0, t.before[role] if known else t.before["*"] + t.quote(role) + ROLE_END, False, None)
        yield (conv, n, 1, t.quote(text), role in t.learned, None)
        yield (conv, n, 2, t.after[role if known else "*"], False, None)
        n += 1
    if not first:
        yield end()


def _rows(batches, *names) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded text."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, str))
        if size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("part", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_()), ("error", pa.string())])
_DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("error", pa.string())])


def format_chats(conversations: DataFrame, template: Template = INST) -> DataFrame:
    """Segments of the formatted text with their loss flags, in order within a partition; one conversation lies in one partition."""
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda batches: _batches(segments_of(_rows(batches, "conv_id", "role", "text"), template), _SEGMENT_ARROW), SEGMENTS)


class Reader:
    """Parses formatted text, piece by piece, by its control strings alone: an opening, a text, the closing that belongs to it."""

    def __init__(self, t: Template) -> None:
        self.t, self.held, self.learned, self.mark = t, "", [], None
        self.roles = {v: k for k, v in t.before.items()}

    def feed(self, piece: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """(role, text, learned text) of every turn that the piece ends."""
        t = self.t
        self.learned.append((len(self.held), len(piece), loss))
        self.held += piece
        while True:
            if self.mark is None:
                self.mark = next((m for m in sorted(self.roles, key=len, reverse=True) if self.held.startswith(m)), None)
                if self.mark is None:
                    if len(self.held) >= max(map(len, self.roles)):
                        raise ValueError(f"no turn begins with {self.held[:20]!r}")
                    return
            end = t.after[self.roles[self.mark]]
            at = self.held.find(end, len(self.mark))
            if at < 0:
                return
            role, body, begin = self.roles[self.mark], self.held[len(self.mark) : at], len(self.mark)
            if role == "*":
                name, _, body = body.partition(ROLE_END)
                role, begin = t.plain(name), begin + len(name) + len(ROLE_END)
            # What the mask covers of the turn's text.
            covered = "".join(self.held[max(begin, s) : min(at, s + n)] for s, n, x in self.learned if x and s < at and s + n > begin)
            yield role, t.plain(body), t.plain(covered)
            cut = at + len(end)
            self.held, self.mark = self.held[cut:], None
            self.learned = [(max(0, s - cut), s + n - max(cut, s), x) for s, n, x in self.learned if s + n > cut]


def read_turns(segments: Iterator[tuple], t: Template) -> Iterator[tuple]:
    """(conv_id, role, text, learned text) per turn of the formatted text, then (conv_id, None, error, formatted chars)."""
    reader, chars = Reader(t), 0
    for conv, _, part, segment, loss, error in segments:
        if part == 3:  # the verdict, which ends a conversation
            if reader.held:
                raise ValueError(f"conversation {conv} ends inside a turn: {reader.held[:20]!r}")
            yield conv, None, error, chars
            reader, chars = Reader(t), 0
        else:
            chars += len(segment)
            for role, text, learned in reader.feed(segment, loss):
                yield conv, role, text, learned


def digest_chats(segments: DataFrame, template: Template = INST) -> DataFrame:
    """One row per conversation, from the formatted segments as they lie in their partitions."""

    def run(batches):
        def rows():
            turns, learned, n, k = hashlib.sha256(), hashlib.sha256(), 0, 0
            for conv, role, text, loss in read_turns(_rows(batches, "conv_id", "turn_no", "part", "segment", "loss", "error"), template):
                if role is None:
                    yield conv, n, turns.hexdigest(), k, learned.hexdigest(), loss, text is None, text
                    turns, learned, n, k = hashlib.sha256(), hashlib.sha256(), 0, 0
                else:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                    learned.update(loss.encode("utf-8", "surrogatepass"))
                    k += len(loss)

        return _batches(rows(), _DIGEST_ARROW)

    return segments.mapInArrow(run, DIGEST)
