"""Chat formatting in budgeted windows that begin and end at turns."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.base import table, word_count

#: Tokens of a window, and of earlier turns repeated at its start.
BUDGET, HISTORY = 512, 96
#: Tokens that the marks of a turn count as.
MARKS = 3

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that chat templates give a meaning to. None is left whole inside a text.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]")
_CONTROL = re.compile("(?=(" + "|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)) + "))", re.S)
_BACK = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE), re.S)

WINDOWS = (
    "conv_id long, window int, text string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_turns int, tokens long"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(text: str) -> str:
    """text without any control string: backslashes are doubled, one goes after the first character of each."""
    doubled = text.replace("\\", "\\\\")
    at = [m.start() + 1 for m in _CONTROL.finditer(doubled)]
    if not at:
        return doubled
    return "\\".join(doubled[a:b] for a, b in zip([0, *at], [*at, len(doubled)], strict=True))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its text begins and ends in it."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def _role(marked: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], marked)


def read_turns(window: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted window."""
    return [(_role(m[1]), unescape(m[2])) for m in _TURN.finditer(window)]


class _Conversation:
    """Windows of one conversation as its turns come in; holds no more turns than a window and its history."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.number, self.system, self.turns, self.new_from, self.sums = 0, None, [], 0, [0]

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        if not self.number and not self.turns and self.system is None and role == "system":
            self.system, self.system_is_new = (role, text, tokens), True
            return
        spent = self.system[2] if self.system else 0
        if len(self.turns) > self.new_from and spent + self.sums[-1] + tokens > self.budget:
            yield self._window()
            self._keep_history(spent + tokens)
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)

    def _keep_history(self, spent: int) -> None:
        """Leaves the last turns that the history's and the next window's budget allow."""
        room = min(self.history, self.budget - spent)
        total = self.sums[-1]
        first = bisect_right(self.sums, total - room - 1) if room > 0 else len(self.turns)
        self.turns = self.turns[first:]
        self.sums = [s - self.sums[first] for s in self.sums[first:]]
        self.new_from = len(self.turns)

    def _window(self) -> dict:
        shown = ([self.system] if self.system else []) + self.turns
        repeated = self.new_from + (bool(self.system) and not self.system_is_new)
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate(shown):
            marked, a, b = render(role, text)
            if role == "assistant" and k >= repeated:
                starts.append(at + a)
                ends.append(at + b)
            parts.append(marked)
            at += len(marked)
        out = {
            "conv_id": self.conv_id, "window": self.number, "text": "".join(parts), "loss_starts": starts, "loss_ends": ends,
            "n_repeated": repeated, "n_turns": len(shown), "tokens": sum(t[2] for t in shown),
        }
        self.number, self.system_is_new = self.number + 1, False
        return out

    def end(self) -> Iterator[dict]:
        if len(self.turns) > self.new_from or not self.number:
            yield self._window()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _batched(rows: Iterable[dict], schema: pa.Schema, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("text", ""))
        if size > chars:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def format_conversations(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None, marks: int = MARKS
) -> DataFrame:
    """A row for each window of each conversation of turns(conv_id, turn, role, text).

    Turns are added while the running sum of tokens stays within the budget; the next window
    repeats a leading system turn and as many of the last turns as `history` tokens hold. `text` is
    the formatted window; loss_starts and loss_ends are code points of the assistant texts that are
    targets in it, repeated ones being masked, so every assistant text is a target once. The first
    n_repeated of its n_turns turns were shown before. A turn above the budget has a window to
    itself and stays whole.

    Rows are taken in order of turn, then role, then text; repeated rows are turns of their own.
    Null texts and roles are empty; rows without conv_id form one conversation; an empty table gives
    no rows; other columns are ignored. Rows stream through sorted partitions: memory holds one
    window, however long a conversation is.
    """
    counted = (word_count(F.col("text")) if tokens is None else tokens) + marks
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), counted.cast("long").alias("tokens"),
    )
    schema = _schema(WINDOWS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[dict]:
            now = None
            for batch in batches:
                for conv, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")), strict=True):
                    if now is None or now.conv_id != conv:
                        if now:
                            yield from now.end()
                        now = _Conversation(conv, budget, history)
                    yield from now.add(role, text, n)
            if now:
                yield from now.end()

        yield from _batched(rows_of(), schema)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(windows, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back from their text alone; takes format_conversations() as it is."""
    schema = _schema(DIGESTS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[dict]:
            now, turns, loss = None, None, None
            for batch in batches:
                for w in batch.to_pylist():
                    if now is None or now["conv_id"] != w["conv_id"]:
                        if now:
                            yield now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
                        now = {"conv_id": w["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}
                        turns, loss = hashlib.sha256(), hashlib.sha256()
                    for role, text in read_turns(w["text"])[w["n_repeated"] :]:
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        now["n_turns"] += 1
                    for a, b in zip(w["loss_starts"], w["loss_ends"], strict=True):
                        target = unescape(w["text"][a:b])
                        loss.update(target.encode("utf-8", "surrogatepass"))
                        now["loss_chars"] += len(target)
                    now["formatted_chars"] += len(w["text"])
                    now["n_windows"] += 1
            if now:
                yield now | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        yield from _batched(rows_of(), schema)

    return windows.mapInArrow(read, DIGESTS)


def op2(spark, sf_dir) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(turns.union(planted)))




