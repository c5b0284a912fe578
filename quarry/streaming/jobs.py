"""The library's stateful steps over streams. Each takes a streaming (or batch) DataFrame with an event time `ts`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.state import upsert


def read_events(spark, folder: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, length: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) for each tumbling window, once it can't change; what comes later is dropped."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the time that state is kept."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n): runs of events without an idle gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def maintain(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps a table under path/<batch>, each batch upserted into the last; a batch that runs again gives the same."""

    def step(batch: DataFrame, number: int) -> None:
        changed = batch.dropDuplicates([key])
        if number:
            old = batch.sparkSession.read.parquet(f"{path}/{number - 1}")
            changed = upsert(old, changed, changed.select(key).limit(0), key)
        changed.write.mode("overwrite").parquet(f"{path}/{number}")

    return step
