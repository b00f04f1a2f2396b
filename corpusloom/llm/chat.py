"""Chat formatting in budgeted windows with loss masks.

Each turn has a mark of its role, and control strings inside texts and roles are
escaped, so a formatted window reads back into its turns.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings, and what opens and closes a turn of a role.
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>")
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
}
# Any other role is named inside its turn.
OTHER = ("[ROLE]", "[/ROLE]")
BUDGET, HISTORY = 1024, 256
TARGET = "assistant"

_CONTROL = regex.compile("|".join(regex.escape(c) for c in CONTROLS))
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
_TURN = regex.compile(
    "|".join(
        rf"(?P<{name}>{regex.escape(opening)}(?P<{name}_text>.*?){regex.escape(closing)})"
        for name, (opening, closing) in {**MARKS, "other": OTHER}.items()
    ),
    regex.DOTALL,
)


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; backslashes double."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the start and end of its escaped text in it."""
    opening, closing = MARKS.get(role, OTHER)
    # A role of None is written as a lone backslash pair, which no escaped name is.
    name = "" if role in MARKS else ("\\n" if role is None else escape(role).replace("\n", "\\\n")) + "\n"
    body = escape(text)
    start = len(opening) + len(name)
    return f"{opening}{name}{body}{closing}", start, start + len(body)


def parse_window(text: str) -> list[tuple[str | None, str]]:
    """``(role, text)`` of all turns of a formatted window."""
    turns = []
    for match in _TURN.finditer(text):
        kind = match.lastgroup.removesuffix("_text")
        body = match[f"{kind}_text"]
        if kind == "other":
            name = regex.match(r"(?:\\.|[^\\\n])*", body, regex.DOTALL)[0]
            body = body[len(name) + 1 :]
            turns.append((None if name == "\\n" else unescape(name), unescape(body)))
        else:
            turns.append((kind, unescape(body)))
    return turns


def count_tokens(text: Column) -> Column:
    """Words and single punctuation marks, the cost of a turn unless a caller names another."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) + F.lit(2)


@dataclass
class _Windows:
    """Windows of one conversation as its turns come in; holds a window and its history at most."""

    budget: int
    history: int
    system: tuple | None = None
    turns: list[tuple] = field(default_factory=list)
    # Prefix sums of tokens over ``turns``: sums[i] is the cost of the turns before i.
    sums: list[int] = field(default_factory=lambda: [0])
    first_new: int = 0
    number: int = 0
    started: bool = False

    def add(self, role: str | None, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if not self.started and role == "system":
            self.system = turn
        self.started = True
        room = self.budget - (self.system[2] if self.system and self.number else 0)
        if self.first_new < len(self.turns) and self.sums[-1] - self.sums[0] + tokens > room:
            yield self.flush()
            room = self.budget - (self.system[2] if self.system else 0)
            # History gives way to the first new turn.
            while self.turns and self.sums[-1] - self.sums[0] + tokens > room:
                self._drop(1)
        self.turns.append(turn)
        self.sums.append(self.sums[-1] + tokens)

    def flush(self) -> tuple:
        """The window over the turns held; keeps the history that the next one repeats."""
        repeated = self.first_new
        shown = list(self.turns)
        if self.system and self.number:
            shown.insert(0, self.system)
            repeated += 1
        out = (self.number, *_render(shown, repeated))
        self.number += 1
        # The longest run of last turns within the history budget, by the prefix sums;
        # the system turn comes with every window and is no history.
        keep = bisect_left(self.sums, self.sums[-1] - self.history)
        if self.number == 1 and self.system:
            keep = max(keep, 1)
        self._drop(min(keep, len(self.turns)))
        self.first_new = len(self.turns)
        return out

    def _drop(self, count: int) -> None:
        self.turns = self.turns[count:]
        self.sums = self.sums[count:]
        self.first_new = max(0, self.first_new - count)


def _render(turns: list[tuple], repeated: int) -> tuple[str, int, int, list[dict]]:
    """``(text, turns, repeated turns, loss spans)``: new targets are under the loss, repeated ones masked."""
    parts, spans, at = [], [], 0
    for i, (role, text, _) in enumerate(turns):
        formatted, start, end = format_turn(role, text)
        if role == TARGET and i >= repeated:
            spans.append({"start": at + start, "end": at + end})
        parts.append(formatted)
        at += len(formatted)
    return "".join(parts), len(turns), repeated, spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def in_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """All rows of a group in one task and in order; the sort spills, and readers stream."""
    return rows.repartition(group).sortWithinPartitions(group, *order)


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Column | None = None,
) -> DataFrame:
    """``(<id_col>, window, formatted, n_turns, n_repeated, loss)``, one row per window.

    Turns come in the order of turn, role and text. A window takes new turns
    while their tokens, the repeated ones included, stay within ``budget``; a
    turn that alone exceeds it gets a window of its own, whole. Every window
    after the first repeats the system turn that opens a conversation, and of
    the turns before it the last ones within ``history`` tokens. ``loss`` lists
    code-point spans of ``formatted``: the escaped text of each assistant turn
    where it is new, so every one is under the loss exactly once.

    Null texts are empty, null roles stay null, rows with a null id are one
    conversation, repeated rows are repeated turns, other columns are not read,
    and an empty table gives an empty result. One conversation is read by one
    task, as a stream: memory holds one window, not the conversation.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), text.alias("text"),
        (count_tokens(text) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"),
    )
    id_field = T.StructField("id", turns.schema[id_col].dataType)
    schema = T.StructType(
        [
            id_field,
            T.StructField("window", T.IntegerType()),
            T.StructField("formatted", T.StringType()),
            T.StructField("n_turns", T.IntegerType()),
            T.StructField("n_repeated", T.IntegerType()),
            T.StructField("loss", SPANS),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, windows = _NOTHING, None
        for batch in batches:
            out = []
            for key, role, body, cost in zip(_keys(batch["id"]), batch["role"], batch["text"], batch["tokens"]):
                if key != current:
                    if windows is not None:
                        out.append((current, *windows.flush()))
                    current, windows = key, _Windows(budget, history)
                out.extend((key, *w) for w in windows.add(role, body, int(cost)))
            yield _frame(out, schema)
        if windows is not None:
            yield _frame([(current, *windows.flush())], schema)

    ordered = in_order(rows, "id", "turn", "role", "text").select("id", "role", "text", "tokens")
    return ordered.mapInPandas(run, schema).withColumnRenamed("id", id_col)


_NOTHING = object()


def _keys(values: pd.Series) -> list:
    """Ids as Python values, null as None."""
    return [None if pd.isna(v) else v for v in values]


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=schema.names)
    if isinstance(schema["id"].dataType, T.IntegralType):
        frame["id"] = frame["id"].astype("Int64")
    return frame


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(<id_col>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` parsed from the windows."""
    rows = windows.select(F.col(id_col).alias("id"), "window", "formatted", "n_repeated", "loss")
    schema = T.StructType(
        [
            T.StructField("id", windows.schema[id_col].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = _NOTHING, None
        for batch in batches:
            out = []
            for key, text, repeated, loss in zip(_keys(batch["id"]), batch["formatted"], batch["n_repeated"], batch["loss"]):
                if key != current:
                    if digest is not None:
                        out.append((current, *digest.row()))
                    current, digest = key, _Digest()
                digest.add(text, repeated, [(s["start"], s["end"]) for s in loss])
            yield _frame(out, schema)
        if digest is not None:
            yield _frame([(current, *digest.row())], schema)

    ordered = in_order(rows, "id", "window").select("id", "formatted", "n_repeated", "loss")
    return ordered.mapInPandas(run, schema).withColumnRenamed("id", id_col)


class _Digest:
    """Running counts and hashes of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, repeated: int, spans: list[tuple[int, int]]) -> None:
        for role, body in parse_window(text)[repeated:]:
            self.turns.update(f"{role or ''}\n{body}\n".encode())
            self.n_turns += 1
        for start, end in spans:
            body = unescape(text[start:end])
            self.loss.update(body.encode())
            self.loss_chars += len(body)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
