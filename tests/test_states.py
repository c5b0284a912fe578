"""State machines over files that come one by one, against plain loops; sessions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.streaming import jobs as J
from quarry.streaming.states import OPERATIONS, PROPOSALS, moved, transitions

SCHEMA = "id string, ts timestamp, seq long, status string"
START = datetime(2024, 1, 1)


def run(spark, tmp_path, name, batches, make):
    folder = tmp_path / name
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b={n:03}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    make(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def plain(steps, rows, ttl):
    """Each event in order of time, with no state but a dictionary."""
    status, last, out = {}, {}, []
    for i, ts, seq, asked in sorted(rows, key=lambda r: (r[1], r[2])):
        now = status.get(i, "")
        if now and now != "expired" and steps[now] and ts >= last[i][0] + ttl:
            out.append((i, None, last[i][0] + ttl, now, "expired", True, "timeout"))
            now = status[i] = "expired"
        if now and (ts, seq) <= last[i]:
            out.append((i, seq, ts, now, now, False, "late"))
        elif now == "expired" or now and not steps[now]:
            out.append((i, seq, ts, now, now, False, "terminal"))
        elif asked in steps[now]:
            out.append((i, seq, ts, now, asked, True, "step"))
            status[i], last[i] = asked, (ts, seq)
        else:
            out.append((i, seq, ts, now, now, False, "not allowed"))
    return out


@pytest.mark.parametrize("name,steps", [("operations", OPERATIONS), ("proposals", PROPOSALS)])
def test_transitions(spark, tmp_path, name, steps):
    r = random.Random(name)
    kinds = [*[k for k in steps if k], "unknown"]
    rows, at = [], START
    for seq in range(400):
        at += timedelta(minutes=r.randrange(40))
        rows.append((f"k{min(r.randrange(30), r.randrange(30))}", at, seq, r.choice(kinds)))
    rows[7:7] = [rows[6]]
    end = (None, at, 1000, "queued")
    want = plain(steps, rows, timedelta(hours=6))
    for size in (400, 90):
        batches = [rows[i : i + size] for i in range(0, len(rows), size)]
        got = run(spark, tmp_path, f"{name}_{size}", [*batches, [end]], lambda s: transitions(s, steps, "6 hours", "1 minute"))
        mine = [tuple(x) for x in got]
        # expiries that no later event tells of show only in the stream
        told = {(i, t) for i, seq, t, *_ in want if seq is None}
        mine = [x for x in mine if x[1] is not None or (x[0], x[2]) in told]
        assert sorted(mine, key=repr) == sorted(want, key=repr)
        assert {x.reason for x in got} >= {"step", "not allowed", "terminal", "timeout"}
        assert all(x.after == "expired" and x.accepted for x in got if x.seq is None)


def test_moved():
    state, out = moved(OPERATIONS, 100, ("", -1, -1), [(5, 0, "running"), (6, 1, "queued"), (6, 1, "queued"), (7, 2, "running"), (200, 3, "succeeded")])
    assert [x[-1] for x in out] == ["not allowed", "step", "late", "step", "timeout", "terminal"] and state == ("expired", 7, 2)


def test_sessions(spark, tmp_path):
    r = random.Random(3)
    rows, at = [], START
    for seq in range(300):
        at += timedelta(seconds=r.randrange(200))
        rows.append((f"u{r.randrange(5)}", at, seq, "x"))
    rows.append(("end", at + timedelta(hours=5), 999, "x"))
    got = run(spark, tmp_path, "sessions", [rows[:100], rows[100:200], rows[200:300], rows[300:]], lambda s: J.sessions(s.withColumnRenamed("id", "user_id")))
    want = []
    for u in sorted({x[0] for x in rows} - {"end"}):
        times = [t for i, t, *_ in rows if i == u]
        first = n = None
        for a, b in zip(times, [*times[1:], None]):
            first, n = first or a, (n or 0) + 1
            if b is None or b - a >= timedelta(minutes=5):
                want.append((u, first, a + timedelta(minutes=5), n))
                first = n = None
    assert sorted(map(tuple, got)) == want
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == 300
