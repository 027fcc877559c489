r"""Chat formatting into budgeted windows.

A turn becomes ``### Role: text </turn>`` and a line feed.  A backslash before
each backslash, before ``#`` where two more follow and before ``</turn>`` keeps
control strings in texts and roles apart from the template; removing it restores
the text.

Conversations are dealt by id and read turn by turn, in order.  Prefix sums of
the turns' tokens choose the windows: each begins with the system turn (the first
turn, if its role is ``system``), repeats at most ``history`` tokens of the turns
just before, and goes on with new turns while the budget lasts.  A turn is never
cut; one that is larger than the budget has a window of its own, marked as over
budget.  The loss mask holds the spans of new assistant texts only, so a repeated
target is masked and each assistant text counts once.

Ids and turns may be null (a null turn comes first, null ids are one
conversation), a null role is an empty one and a null text an empty text.  Equal
turn numbers are ordered by role and text.  Nothing of a conversation but its
system turn, its history and one window is in memory at once, so a conversation
may have any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .transducer import counter

#: Tokens of a window, and of the history that it repeats.
BUDGET, HISTORY = 1024, 256
#: Turns whose tokens are counted at once.
LOOK_AHEAD = 256

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?) </turn>\n", re.DOTALL)

WINDOW_SCHEMA = "conv_id long, window int, text string, loss array<struct<start: int, end: int>>, new_from int, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    """``text`` without control strings of the template."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """What :func:`escape` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text lies in it."""
    head = f"### {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse(window: str) -> Iterator[tuple[int, str, str, tuple[int, int]]]:
    """``start, role, text, span`` of each turn of a window."""
    at = 0
    while at < len(window):
        m = _TURN.match(window, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield at, unescape(m[1]), unescape(m[2]), m.span(2)
        at = m.end()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _counted(turns: Iterator[tuple[int | None, str, str]], path: str) -> Iterator[tuple[int | None, str, str, int]]:
    """Turns with the tokens of their formatted text."""
    machine, held = counter(path), []

    def flush() -> Iterator[tuple[int | None, str, str, int]]:
        raw = [render(role, text)[0].encode() for _, role, text in held]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
        for turn, n in zip(held, machine.counts(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist(), strict=True):
            yield *turn, n
        held.clear()

    for turn in turns:
        held.append(turn)
        if len(held) == LOOK_AHEAD:
            yield from flush()
    if held:
        yield from flush()


def _windows(path: str, budget: int, history: int):
    def cut(conv_id: int | None, turns: Iterator[tuple]) -> Iterator[tuple]:
        system: tuple | None = None
        past: list[tuple] = []  # the turns that the next window may repeat
        new: list[tuple] = []
        number = used = 0

        def window() -> tuple:
            keep = ([system] if system and not any(t is system for t in new) else []) + past
            text, loss, new_from = "", [], 0
            for i, (role, content, _) in enumerate([*keep, *new]):
                formatted, a, b = render(role, content)
                if i == len(keep):
                    new_from = len(text)
                if i >= len(keep) and role == "assistant":
                    loss.append({"start": len(text) + a, "end": len(text) + b})
                text += formatted
            tokens = sum(n for *_, n in [*keep, *new])
            return conv_id, number, text, loss, new_from, tokens, tokens > budget

        for first, (_, role, text, n) in enumerate(turns):
            turn = (role, text, n)
            if new and used + n > budget:
                yield window()
                number += 1
                # The last turns whose sum, a difference of prefix sums, is within the history and leaves room for the next.
                base = system[2] if system else 0
                room, past, total = min(history, budget - base - n), [], 0
                for old in reversed([t for t in new if t is not system]):
                    if total + old[2] > room:
                        break
                    past.insert(0, old)
                    total += old[2]
                used, new = base + total, []
            if not first and role == "system":
                system = turn
            new.append(turn)
            used += n
        yield window()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for conv_id, turns in groupby(_counted(_turns(batches), path), key=lambda t: t[0]):
            for row in cut(conv_id, turns):
                rows.append(row)
                if len(rows) == 500:
                    yield _window_batch(rows)
                    rows = []
        yield _window_batch(rows)

    return run


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int64(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "window", "text", "loss", "new_from", "n_tokens", "over_budget"])


def format_chats(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``conversations(conv_id, turn, role, text)``, those of a conversation together and in order.

    ``loss`` holds code point spans of ``text``; turns from ``new_from`` on are
    not repeated ones.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_windows(tokenizer, budget, history), WINDOW_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def windows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "new_from")), strict=True)

    rows = []
    for conv_id, own in groupby(windows(), key=lambda w: w[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = formatted = 0
        for _, text, spans, new_from in own:
            formatted += len(text)
            for start, role, content, _ in parse(text):
                if start >= new_from:
                    n_turns += 1
                    turns.update(f"{role}\n{content}\n".encode())
            for span in spans:
                target = unescape(text[span["start"] : span["end"]])
                loss_chars += len(target)
                loss.update(target.encode())
        rows.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted))
        if len(rows) == 5000:
            yield _digest_batch(rows)
            rows = []
    yield _digest_batch(rows)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    import public_tokenizers

    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    windows = format_chats(table.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
    return windows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
