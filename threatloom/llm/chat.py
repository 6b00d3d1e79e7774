"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatloom.llm.common import map_arrow

ROLE_END = ": "


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, roles under the loss mask, and the machine: which role may follow which (None: the start).

    ``controls`` are the strings that never occur inside a text; each is written as a backslash and its letter there, and a backslash as two.
    """

    opening: str = "### "
    closing: str = " </turn>\n"
    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "Role "
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {
        None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    controls: dict[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "t"})

    def __post_init__(self):
        letters = set(self.controls.values())
        for mark in self.controls:
            if "\\" in mark or mark[0] in letters or mark[0].isspace():
                raise ValueError(f"control string {mark!r} could be made by an escape")

    def escape(self, text: Column) -> Column:
        out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
        for mark, letter in self.controls.items():
            out = F.replace(out, F.lit(mark), F.lit("\\" + letter))
        return out

    def unescape(self, text: str) -> str:
        back = {letter: mark for mark, letter in self.controls.items()} | {"\\": "\\", "c": ":"}
        return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S)

    def title(self, role: Column) -> Column:
        """A known role's title, or the role itself with colons escaped, behind a word that no title starts with."""
        known = F.create_map(*(F.lit(x) for pair in self.titles.items() for x in pair))
        return F.coalesce(known[role], F.concat(F.lit(self.other), F.replace(self.escape(role), F.lit(":"), F.lit("\\c"))))

    def role(self, title: str) -> str:
        for role, known in self.titles.items():
            if title == known:
                return role
        return self.unescape(title.removeprefix(self.other))


DEFAULT = ChatTemplate()


def segments(conversations: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """(conv_id, nth, part, text, loss, error): three segments a turn, in order of nth and part; joined they are the formatted conversation.

    ``loss`` is true for the text of trained roles alone. ``error`` is null or says which step of the machine fails at the turn:
    a role that may not follow the one before, or a last turn that may not be last. All turns are formatted, valid or not. Turns are ordered by
    turn, then role and text; a null text is empty, a null role is a role of its own that reads back empty, rows without a conv_id are one conversation.
    Joined to a row number inside each conversation, so every row is formatted on its own; a repeated row is a turn of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    steps = F.create_map(*(x for role, after in template.follows.items() for x in (F.lit("" if role is None else f"={role}"), F.array(*map(F.lit, after)))))
    named = conversations.select(
        "conv_id", "role", "text", F.row_number().over(order).cast("long").alias("nth"), F.lag(F.concat(F.lit("="), F.coalesce("role", F.lit("")))).over(order).alias("before"),
        F.lead(F.lit(1)).over(order).isNull().alias("last"))
    allowed = F.coalesce(F.array_contains(steps[F.coalesce("before", F.lit(""))], F.coalesce("role", F.lit(""))), F.lit(False))
    error = F.when(~allowed, F.concat(F.coalesce("role", F.lit("no role")), F.lit(" may not follow "), F.coalesce(F.substring("before", 2, 1 << 30), F.lit("the start")))).when(
        F.col("last") & ~F.coalesce(F.col("role").isin(*template.ends), F.lit(False)), F.concat(F.coalesce("role", F.lit("no role")), F.lit(" may not be last")))
    trained = F.coalesce(F.col("role").isin(*template.trained), F.lit(False))
    part = lambda k, text, loss: F.struct(F.lit(k).alias("part"), text.alias("text"), loss.alias("loss"))
    parts = F.array(part(0, F.concat(F.lit(template.opening), template.title(F.col("role")), F.lit(ROLE_END)), F.lit(False)),
                    part(1, template.escape(F.col("text")), trained), part(2, F.lit(template.closing), F.lit(False)))
    return named.select("conv_id", "nth", error.alias("error"), F.inline(parts)).select("conv_id", "nth", "part", "text", "loss", "error")


class _Digest:
    """Reads one conversation back, turn by turn; keeps one turn's text and running digests."""

    def __init__(self, conv_id, template: ChatTemplate):
        self.conv_id, self.template = conv_id, template
        self.turns, self.chars, self.loss_chars, self.errors = 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.open, self.masked = "", ""

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            self.masked += text
        self.open += text
        closing = self.template.closing
        if closing not in self.open:
            return
        turn, _, self.open = self.open.partition(closing)
        opening = self.template.opening
        title, mark, body = turn.partition(ROLE_END)
        if not turn.startswith(opening) or not mark or self.open:
            raise ValueError(f"conversation {self.conv_id}: not a turn: {turn[:80]!r}")
        body = self.template.unescape(body)
        self.all.update(f"{self.template.role(title[len(opening):])}\n{body}\n".encode())
        self.turns += 1
        if self.masked:
            text, self.masked = self.template.unescape(self.masked), ""
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self) -> tuple:
        if self.open:
            raise ValueError(f"conversation {self.conv_id}: no end of its last turn")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.errors


ROWS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long"


def read_back(parts: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """Per conversation, what its segments hold: turns, digests of turns and of the text under the loss mask, lengths, and turns with errors.

    Segments stream in order through a reader that holds one turn, however long the conversation.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        names, types = [f.split()[0] for f in ROWS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for conv_id, part, text, loss, error in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if reader is None or reader.conv_id != conv_id:
                    if reader:
                        out.append(reader.row())
                    reader = _Digest(conv_id, template)
                reader.feed(text, loss)
                reader.errors += part == 0 and error is not None
            if len(out) >= 10_000:
                yield flush()
                out = []
        if reader:
            out.append(reader.row())
        if out:
            yield flush()

    return map_arrow(parts.repartition("conv_id").sortWithinPartitions("conv_id", "nth", "part"), rows, ROWS)
