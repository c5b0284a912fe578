"""Chat formatting in budgeted windows.

A turn is written `<s>[INST] role` LF `text [/INST]</s>`; inside a role or text a backslash goes before each
backslash and after the first character of each control string, so texts can't close a turn or open one, and reading takes the
backslashes away again.

A conversation becomes windows of at most `budget` tokens: prefix sums of the turns' tokens give the longest
span of turns that fits after the system turn and the history; no turn is cut. Each window starts with the
conversation's system turn, if it has one, then repeats the last turns before the span as far as `history`
tokens go. Loss is taken on the texts of assistant turns of the span only, never on what is repeated.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, MIDDLE, CLOSE = "<s>[INST] ", "\n", " [/INST]</s>"
INSIDE = re.compile("|".join(re.escape(x) for x in ("\\", *CONTROL)))
TURN = re.compile(r"<s>\[INST\] (.*?)\n(.*?) \[/INST\]</s>", re.S)


def escape(text: str) -> str:
    return INSIDE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def written(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends there. Line feeds in a role are written as a control string would be."""
    head = OPEN + escape(role).replace("\n", "\\n") + MIDDLE
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


class Windows:
    """The windows of one conversation, whose turns come one by one; only a window's turns and the history are held."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history, self.number = budget, history, 0
        self.system: tuple | None = None
        self.turns = 0
        self.past: list[tuple] = []
        self.span: list[tuple] = []
        self.room = 0

    def add(self, role: str, form: tuple[str, int, int], tokens: int) -> Iterator[tuple]:
        turn = (role, form, tokens)
        self.turns += 1
        if self.turns == 1 and role == "system":
            self.system, self.budget = turn, self.budget - tokens
        elif self.span and tokens <= self.room:
            self.span.append(turn)
            self.room -= tokens
        else:
            if self.span:
                yield from self.close()
            # the last turns as far as the history goes; their tokens' sums from the end tell how many
            sums = list(accumulate(t[2] for t in reversed(self.past)))
            most = bisect_right(sums, min(self.history, self.budget - tokens))
            self.past = self.past[len(self.past) - most :]
            self.room = self.budget - tokens - (sums[most - 1] if most else 0)
            self.span = [turn]

    def close(self) -> Iterator[tuple]:
        """(window, text, n_tokens, new_from, loss) of the open window, if there is one."""
        if not self.span and not (self.system and not self.number):
            return
        first = self.system and not self.number
        old = ([self.system] if self.system and not first else []) + self.past
        new = ([self.system] if first else []) + self.span
        parts, loss = [t[1][0] for t in old], []
        place = start = sum(map(len, parts))
        for role, (form, a, b), _ in new:
            if role == "assistant":
                loss.append({"start": place + a, "stop": place + b})
            parts.append(form)
            place += len(form)
        yield self.number, "".join(parts), sum(t[2] for t in old + new), start, loss
        self.number += 1
        self.past, self.span = self.past + self.span, []
        while sum(t[2] for t in self.past) > self.history:
            self.past = self.past[1:]


def chat_windows(conversations: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, window, text, n_tokens, new_from, loss): the windows of each conversation.

    conversations: conv_id, turn, role, text, and any other columns, which are left aside; rows in order of turn (null
    first, ties by role and text). Null roles and texts are empty. new_from: where in text the turns start that no earlier window
    has; loss: an array of (start, stop) in text, of the assistant texts there, escaped. A turn that is longer than the
    budget has a window for itself. Repeated rows are turns of their own; a null conv_id is a conversation. No rows give no windows.
    Turns are sorted within a partition and read as a stream, so a long conversation takes time, but no memory.
    """
    role, text = (F.coalesce(x, F.lit("")).alias(x) for x in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = {"conv_id": pa.int64(), "window": pa.int64(), "text": pa.string(), "n_tokens": pa.int64(), "new_from": pa.int64(), "loss": kind}

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        at, windows = None, None
        pack = lambda rows: pa.record_batch({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                ids, roles, texts = (batch.slice(start, 1000).column(i).to_pylist() for i in range(3))
                forms = [written(r, t) for r, t in zip(roles, texts, strict=True)]
                sizes = [len(e) for e in tokenizer.encode_batch_fast([f[0] for f in forms], add_special_tokens=False)]
                out = []
                for conv, r, f, n in zip(ids, roles, forms, sizes, strict=True):
                    if windows is None or conv != at:
                        out += [(at, *w) for w in windows.close()] if windows else []
                        at, windows = conv, Windows(budget, history)
                    out += [(at, *w) for w in windows.add(r, f, n)]
                yield pack(out)
        if windows:
            yield pack([(at, *w) for w in windows.close()])

    return rows.mapInArrow(form, "conv_id long, window long, text string, n_tokens long, new_from long, loss array<struct<start: long, stop: long>>")


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what chat_windows() returns.

    Windows are sorted within a partition and read as a stream with running digests.
    """
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "text", "new_from", "loss")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        done, row, turns, loss = [], None, None, None
        pack = lambda rows: pa.record_batch({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})
        for batch in batches:
            for i in range(batch.num_rows):
                conv, text, new, spans = (batch.column(c)[i].as_py() for c in range(4))
                if row is None or conv != row[0]:
                    if row:
                        done.append((row[0], row[1], turns.hexdigest(), row[2], loss.hexdigest(), row[3]))
                    row, turns, loss = [conv, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for r, t in TURN.findall(text[new:]):
                    row[1] += 1
                    turns.update(f"{read_role(r)}\n{unescape(t)}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["stop"]])
                    row[2] += len(said)
                    loss.update(said.encode())
                row[3] += len(text)
            yield pack(done)
            done = []
        if row:
            yield pack([(row[0], row[1], turns.hexdigest(), row[2], loss.hexdigest(), row[3])])

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
