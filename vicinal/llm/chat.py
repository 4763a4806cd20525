"""Format conversations into training windows of a token budget, and read them back.

A window is a run of whole turns.  Windows follow each other through a conversation: each
begins with the system turn, repeats some turns of history, and goes on with new turns
for as long as the prefix sums of turn tokens stay within the budget.  Targets are the
assistant turns among the new ones; repeated ones are masked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of the template.  None can occur in an escaped text, as each begins with ``<``.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters that begin a control string of a usual template, and how a text spells them.
#: The first one makes the others reversible.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: str) -> str:
    for plain, spelled in ESCAPES:
        text = text.replace(plain, spelled)
    return text


def unescape(text: str) -> str:
    for plain, spelled in reversed(ESCAPES):
        text = text.replace(spelled, plain)
    return text


@dataclass(frozen=True)
class Settings:
    """``budget``: tokens of a window; ``history``: repeated turns at most, as long as they take
    no more than half of the budget.  A token is a word piece of at most four characters or
    a mark, a fixed count that needs no vocabulary file; ``tokenizer`` names a ``tokenizers`` file
    on every executor to count with instead."""

    budget: int = 512
    history: int = 2
    tokenizer: str | None = None


@dataclass
class Turn:
    role: str
    text: str
    tokens: int

    @property
    def marked(self) -> str:
        return f"{TURN}{escape(self.role)}{TEXT}{escape(self.text)}{END}"


def counter(settings: Settings):
    """Tokens of a marked turn."""
    if settings.tokenizer:
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(settings.tokenizer)
        return lambda text: 3 + len(loaded.encode(text, add_special_tokens=False).ids)
    return lambda text: 3 + sum(-(-len(w) // 4) for w in text.split())


@dataclass
class Builder:
    """Turns of one conversation in, whole windows out.  It holds one window at a time, so that
    a conversation of any length passes through bounded memory (one turn may exceed the budget)."""

    conv_id: int | None
    settings: Settings
    system: Turn | None = None
    #: Turns of the open window: (turn, position, new).
    open: list = field(default_factory=list)
    used: int = 0
    number: int = 0
    seen: int = 0

    def add(self, turn: Turn):
        """Add the next turn; yields the open window if the turn does not fit it."""
        fresh = any(new for _, _, new in self.open)
        if fresh and self.used + turn.tokens > self.settings.budget:
            yield self.close()
            self._reopen(turn)
        if turn.role == "system" and self.seen == 0:
            self.system = turn
        self.open.append((turn, self.seen, True))
        self.used += turn.tokens
        self.seen += 1

    def _reopen(self, turn: Turn):
        """Begin a window with the system turn and the history that leaves room for ``turn``."""
        kept, budget = [], self.settings.budget
        self.used = self.system.tokens if self.system else 0
        room = min(budget // 2, budget - turn.tokens - self.used)
        for old, place, _ in reversed(self.open[-self.settings.history :] if self.settings.history else []):
            if (place == 0 and self.system) or old.tokens > room:
                break
            room -= old.tokens
            self.used += old.tokens
            kept.append((old, place, False))
        system = [(self.system, 0, False)] if self.system else []
        self.open = system + kept[::-1]

    def close(self) -> dict:
        """The open window as a row: its text and, by character, the spans under the loss."""
        text, spans, at = [], [], 0
        for turn, _, new in self.open:
            marked = turn.marked
            if new and turn.role == "assistant":
                begin = at + len(TURN) + len(escape(turn.role)) + len(TEXT)
                spans.append({"begin": begin, "end": at + len(marked) - len(END)})
            text.append(marked)
            at += len(marked)
        row = {
            "conv_id": self.conv_id,
            "window": self.number,
            "repeated": sum(not new for _, _, new in self.open),
            "tokens": sum(t.tokens for t, _, _ in self.open),
            "formatted": "".join(text),
            "loss": spans,
        }
        self.number += 1
        return row


SCHEMA = "conv_id bigint, window int, repeated int, tokens bigint, formatted string, loss array<struct<begin:int,end:int>>"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("tokens", pa.int64())]
    + [("formatted", pa.string()), ("loss", pa.list_(_SPAN))]
)


def _build(settings: Settings):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(settings)
        builder: Builder | None = None
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if builder is None or builder.conv_id != conv_id:
                    if builder is not None:
                        rows.append(builder.close())
                    builder = Builder(conv_id, settings)
                rows += builder.add(Turn(role, text, count(text)))
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        if builder is not None:
            yield pa.RecordBatch.from_pylist([builder.close()], schema=_ARROW)

    return build


def format_chats(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Windows of all conversations: ``conv_id, window, repeated, tokens, formatted, loss``.

    Turns are ordered by ``turn`` (null first), ties by role and text; equal rows are turns of
    their own.  A null role or text is empty.  A null ``conv_id`` is a conversation.  An empty
    table has no windows.  Extra columns are not carried.

    Conversations are sorted in their tasks and stream through them turn by turn, so that a long
    one needs no more memory than its longest window.  Its turns stay in one task because
    every window depends on where the one before ended.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_build(settings), SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a window."""
    found = []
    for part in formatted.split(TURN)[1:]:
        role, text = part[: -len(END)].split(TEXT)
        found.append((unescape(role), unescape(text)))
    return found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its windows, which come sorted."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state = None

    def row():
        return (*state[:2], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:])

    for batch in batches:
        rows = []
        for conv_id, repeated, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "repeated", "formatted", "loss"))):
            if state is None or state[0] != conv_id:
                if state is not None:
                    rows.append(row())
                state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in parse(formatted)[repeated:]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["begin"] : span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
            state[6] += 1
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], names=names)
    if state is not None:
        yield pa.record_batch([pa.array([c], t) for c, t in zip(row(), types)], names=names)


def chat_report(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from them alone, by conversation."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(
        _digest,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_windows bigint",
    )


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
