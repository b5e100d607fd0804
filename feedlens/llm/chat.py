"""Chat formatting into training windows of a bounded number of tokens.

Prefix sums of the turns' tokens choose spans of whole turns.  Every window starts with
the conversation's system turn and a limited amount of history, both masked; only targets
that appear for the first time carry loss.  The template marks turns with control
strings, and control strings inside texts are escaped reversibly.  Tokens are counted
where the turns stand, before a conversation's turns come together; the task that lays out
its windows then holds one window and its history at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.packing import tokenizer
from feedlens.llm.shared import with_key, without_key
from feedlens.llm.textkit import batches

#: Tokens of one window: those of its turns' roles and texts, and two a turn for its marks.
BUDGET = 4096
#: Of these, as many at most for repeated turns.
HISTORY = 1024
START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<(\\*)\\\|")
WINDOWS = (
    "conv_id long, no_id boolean, window_id long, first_turn long, n_turns long, n_repeated long, n_tokens long, "
    "formatted string, loss_spans array<array<long>>"
)


def escape(text: str) -> str:
    """Puts a backslash into each ``<|``, and one more where there are some already."""
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


class Layout:
    """Lays out one conversation's turns in order.

    ``before`` is the prefix sum of tokens in front of a turn.  A window opens with the
    system turn, as many of the last turns as HISTORY and the budget beside its first new
    turn allow, and goes on as long as the next turn fits.  It is over the budget only if
    the system turn and its one new turn are.
    """

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.done = self.window_id = self.before = 0
        self.past: deque[tuple[int, Turn]] = deque()
        self.fresh: list[Turn] = []
        self.repeated: list[Turn] = []
        self.size = 0

    def add(self, turn: Turn) -> tuple | None:
        """Takes the next turn; returns the window that it closes, if any."""
        closed = None
        if self.fresh and self.size + turn.tokens > self.budget:
            closed = self.close()
        if not self.fresh:
            self._open(turn)
        if not self.done and not self.fresh and turn.role == "system":
            self.system = turn
        else:
            self.past.append((self.before, turn))
            while self.past and self.before + turn.tokens - self.past[0][0] > self.history:
                self.past.popleft()
        self.fresh.append(turn)
        self.size += turn.tokens
        self.before += turn.tokens
        return closed

    def _open(self, turn: Turn) -> None:
        kept = [self.system] if self.system else []
        room = self.budget - turn.tokens - sum(x.tokens for x in kept)
        self.repeated = kept + [x for at, x in self.past if self.before - at <= min(room, self.history)]
        self.size = sum(x.tokens for x in self.repeated)

    def close(self) -> tuple | None:
        """The window (window_id, first_turn, n_turns, n_repeated, n_tokens, formatted, loss_spans) that is open."""
        if not self.fresh:
            return None
        parts, loss, length = [], [], 0
        for i, (role, text, _) in enumerate(self.repeated + self.fresh):
            head, body = f"{START}{_escape_role(role)}\n", escape(text)
            if role == "assistant" and i >= len(self.repeated):
                loss.append([length + len(head), length + len(head) + len(body)])
            parts.append(f"{head}{body}{END}\n")
            length += len(parts[-1])
        n = len(self.repeated)
        out = (self.window_id, self.done, n + len(self.fresh), n, self.size, "".join(parts), loss)
        self.done, self.window_id, self.fresh = self.done + len(self.fresh), self.window_id + 1, []
        return out


def _counter(path: str):
    """Adds to turns the tokens of their role and text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer(path)
        roles: dict[str, int] = {}
        for whole in parts:
            for part in batches(whole, limit=2 << 20):
                if len(roles) > 1000:
                    roles.clear()
                new = [x for x in dict.fromkeys(part["role"]) if x not in roles]
                roles.update(zip(new, map(len, words.batch(new)), strict=True))
                own = [len(x) + 2 for x in words.batch(part["text"].tolist())]
                yield part.assign(tokens=[n + roles[role] for n, role in zip(own, part["role"], strict=True)])

    return run


def _formatter(budget: int, history: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, layout, out, size = None, Layout(budget, history), [], 0
        for part in parts:
            for conv_id, no_id, role, text, tokens in part[["conv_id", "no_id", "role", "text", "tokens"]].itertuples(index=False, name=None):
                if own != (conv_id, no_id):
                    if closed := layout.close():
                        out.append((*own, *closed))
                    own, layout = (conv_id, no_id), Layout(budget, history)
                if closed := layout.add(Turn(role, text, tokens)):
                    out.append((*own, *closed))
                    size += len(closed[5])
                if size > _HELD_CHARS:
                    yield _windows(out)
                    out, size = [], 0
        if closed := layout.close():
            out.append((*own, *closed))
        yield _windows(out)

    return run


#: Characters of finished windows that are handed on together.
_HELD_CHARS = 4 << 20


def _windows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in WINDOWS.split(", ")])


def format_chats(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows of conversations (conv_id, turn, role, text), in tokens of the tokenizer at ``path``.

    Returns conv_id, window_id, first_turn (index of its first new turn), n_turns,
    n_repeated (masked turns at its head), n_tokens, formatted and loss_spans (code point
    spans of formatted that carry loss).  Only a turn that doesn't fit a window beside the
    system turn exceeds the budget, with these two alone.  Null texts and roles are empty;
    rows with a null conv_id are one conversation; equal turns are ordered by role and
    text, and repeated rows are turns of their own; an empty table gives no windows.
    Windows come ordered by conversation within each partition.  Extra columns are ignored.
    """
    rows = with_key(
        turns.select(
            F.col("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ),
        "conv_id",
    ).withColumn("no_turn", F.col("turn").isNull())
    rows = rows.withColumn("turn", F.coalesce("turn", F.lit(0).cast("long")))
    counted = rows.mapInPandas(_counter(path), "conv_id long, turn long, role string, text string, no_id boolean, no_turn boolean, tokens long")
    ordered = counted.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", F.desc("no_turn"), "turn", "role", "text")
    return without_key(ordered.select("conv_id", "no_id", "role", "text", "tokens").mapInPandas(_formatter(budget, history), WINDOWS), "conv_id")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out = []
    for block in formatted.split(START)[1:]:
        role, _, body = block.partition("\n")
        out.append((_unescape_role(role), unescape(body[: body.rindex(END)])))
    return out


READ_BACK = "conv_id long, no_id boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


class _Told:
    """What the windows of one conversation have said so far."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = self.windows = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, first: int, repeated: int, text: str, spans) -> None:
        if first != self.turns:
            raise ValueError("the windows of a conversation don't stand in order")
        for role, own in parse(text)[repeated:]:
            self.turns += 1
            self.said.update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
        for start, end in spans:
            own = unescape(text[start:end])
            self.loss_chars += len(own)
            self.loss.update(own.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        self.windows += 1

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.windows


def _read_back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in READ_BACK.split(", ")]
    told, own = _Told(), None
    for part in parts:
        out = []
        for conv_id, no_id, first, repeated, text, spans in part[["conv_id", "no_id", "first_turn", "n_repeated", "formatted", "loss_spans"]].itertuples(index=False, name=None):
            if own != (conv_id, no_id):
                if own is not None:
                    out.append((*own, *told.row()))
                told, own = _Told(), (conv_id, no_id)
            told.add(first, repeated, text, spans)
        yield pd.DataFrame(out, columns=names)
    if own is not None:
        yield pd.DataFrame([(*own, *told.row())], columns=names)


def read_back(windows: DataFrame, ordered: bool = False) -> DataFrame:
    """Per conversation, what its windows say: turns, their digest, text under the loss mask and total size.

    Windows that stand in order within their partitions, as format_chats has just given
    them, may be read as they are; windows from a table are brought together and sorted first.
    """
    rows = with_key(windows, "conv_id")
    if not ordered:
        rows = rows.repartition("no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "window_id")
    return without_key(rows.mapInPandas(_read_back, READ_BACK), "conv_id")
