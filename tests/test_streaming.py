"""Streams, run to their end over files, against the same work on tables."""

import shutil

from pyspark.sql import functions as F

from quarry.streaming import jobs as J


def stream(spark, sf, folder):
    folder.mkdir()
    shutil.copy(f"{sf}/events.parquet", folder / "a.parquet")
    return J.read_events(spark, str(folder), spark.read.parquet(str(folder)).schema)


def finished(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {(r.w.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = {(r.start, r.event_type): r.n for r in finished(J.window_counts(stream(spark, sf, tmp_path / "in")), "windows")}
    last = max(w for w, _ in want)
    assert got and all(want[k] == n for k, n in got.items()) and {k for k in want if k[0] < last} <= {*got, *(k for k in want if (last - k[0]).total_seconds() <= 6 * 3600)}


def test_once_and_maintain(spark, sf, tmp_path):
    events = stream(spark, sf, tmp_path / "in")
    n = spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()
    assert len(finished(J.once(events.union(events), ["event_id"]), "once")) == n
    step = J.maintain(str(tmp_path / "table"))
    for number, rows in enumerate([[("a", 1), ("b", 1)], [("b", 2), ("c", 2)], [("b", 2), ("c", 2)]]):
        step(spark.createDataFrame(rows, "id string, x int"), min(number, 1))  # the last batch runs again
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table/1")).collect())) == [("a", 1), ("b", 2), ("c", 2)]
