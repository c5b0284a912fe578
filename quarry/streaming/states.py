"""State machines over streams: operations and proposals move by events, end in terminal states, and expire.

Each key's state is a status and when it was last moved. An event moves it where its kind allows the step; others are refused and change nothing,
as are all after a terminal status. A key that isn't terminal expires once the watermark passes its last accepted event by `ttl`;
an event with a later time than that comes too late, whether or not the expiry has been seen yet, so that results don't
hang on how a stream is cut into batches. Events of a key must come in order of (ts, seq), over batches too: within a batch they are sorted,
and one from before the state's last event is refused as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Statuses that each status may be followed by; none for terminal ones. "" is before the first.
OPERATIONS = {"": ["queued"], "queued": ["running", "failed", "conflict"], "running": ["succeeded", "failed", "conflict"], "succeeded": [], "failed": [], "conflict": []}
PROPOSALS = {
    "": ["draft", "submitted"], "draft": ["submitted"], "submitted": ["approved", "rejected", "changes_requested"], "changes_requested": ["submitted"],
    "approved": ["applied"], "rejected": [], "applied": [],
}
MOVES = "id string, seq long, ts timestamp, before string, after string, accepted boolean, reason string"
STATE = "status string, at long, seq long"
EXPIRED = "expired"


def moved(steps: dict[str, list[str]], ttl: int, state: tuple[str, int, int], rows: list[tuple[int, int, str]]) -> tuple[tuple[str, int, int], list[tuple]]:
    """(status, at, seq) after events (at, seq, status) in order, and a row (at, seq, before, after, accepted, reason) for each. Times are in microseconds.

    An event that comes ttl or more after the last accepted one finds its key expired: the expiry is a row of its own, at its time, with a null seq.
    """
    status, at, seq = state
    out: list[tuple] = []
    for t, s, asked in rows:
        if status and status != EXPIRED and steps[status] and t >= at + ttl:
            out.append((at + ttl, None, status, EXPIRED, True, "timeout"))
            status = EXPIRED
        if (t, s) <= (at, seq) and status:
            out.append((t, s, status, status, False, "late"))
        elif status == EXPIRED or status and not steps[status]:
            out.append((t, s, status, status, False, "terminal"))
        elif asked in steps[status]:
            out.append((t, s, status, asked, True, "step"))
            status, at, seq = asked, t, s
        else:
            out.append((t, s, status, status, False, "not allowed"))
    return (status, at, seq), out


def micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def transitions(events: DataFrame, steps: dict[str, list[str]], ttl: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(id, seq, ts, before, after, accepted, reason) of a stream of events (id, ts, seq, status): a row for each, and one for each expiry.

    reason: step, timeout, not allowed, terminal or late. Rows whose id, ts, seq or status is null are left out. What a task holds is one key's events of a
    batch. Repeated events are refused as late. State stays for terminal keys, so that what follows is refused: a few bytes for each key.
    """
    span = int(pd.Timedelta(ttl) / pd.Timedelta(microseconds=1))

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, at, seq = held.get if held.exists else ("", -1, -1)
        if held.hasTimedOut:
            out = [(at + span, None, status, EXPIRED, True, "timeout")]
            status = EXPIRED
        else:
            rows = sorted(x for f in frames for x in zip(micros(f["ts"]), f["seq"].tolist(), f["status"].tolist(), strict=True))
            (status, at, seq), out = moved(steps, span, (status, at, seq), rows)
        held.update((status, at, seq))
        if status and status != EXPIRED and steps[status]:
            due = (at + span) // 1000
            held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
        table = pd.DataFrame(out, columns=["at", "seq", "before", "after", "accepted", "reason"])
        yield pd.DataFrame({"id": key[0], "seq": table["seq"].astype("Int64"), "ts": pd.to_datetime(table["at"], unit="us"), "before": table["before"], "after": table["after"], "accepted": table["accepted"], "reason": table["reason"]})

    rows = events.select("id", "ts", F.col("seq").cast("long").alias("seq"), "status").dropna()
    grouped = rows.withWatermark("ts", late).groupBy("id")
    return grouped.applyInPandasWithState(step, MOVES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
